"""Coverage of lines and conditions, united over the reports of several test projects by bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_bitmaps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of valid and of covered lines for each key and bucket of 32,768 lines: 4 KB whatever the number of rows, and they unite by OR."""
    covered = F.col("hits") > 0
    rows = lines.where("line > 0").select(*keys, "line", covered.alias("covered"))
    bit, bucket = F.bitmap_bit_position("line"), F.bitmap_bucket_number("line").alias("bucket")
    valid = rows.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(bit).alias("valid"))
    hit = rows.where("covered").groupBy(*keys, bucket).agg(F.bitmap_construct_agg(bit).alias("hit"))
    return valid.join(hit, [*keys, "bucket"], "left")


def united(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """One pair of bitmaps for each of ``keys`` (fewer than those of ``line_bitmaps``) and bucket: lines that any report has, or covers."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("valid").alias("valid"), F.bitmap_or_agg("hit").alias("hit"))


def line_rates(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """lines_valid, lines_covered and line_rate of each key."""
    rows = bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("valid")).alias("lines_valid"), F.sum(F.coalesce(F.bitmap_count("hit"), F.lit(0))).alias("lines_covered"))
    return rows.withColumn("line_rate", F.round(F.col("lines_covered").cast("double") / F.col("lines_valid"), 9))


def condition_rates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """conditions, conditions_met of each key: a line that several reports have counts once, with the most that one report met."""
    each = lines.where("conditions > 0").groupBy(*keys, "line").agg(F.max("conditions").alias("n"), F.max("conditions_met").alias("met"))
    return each.groupBy(*keys).agg(F.sum("n").alias("conditions"), F.sum("met").alias("conditions_met"))
