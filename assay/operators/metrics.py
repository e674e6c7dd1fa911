"""Aggregations: mutation score, existence flags, attempts, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a mutant, in any case, that count as found out and as not found out. Others, and static mutants, don't count.
DETECTED, UNDETECTED = ("killed", "timeout", "compileerrors"), ("survived", "nocoverage")


def mutation_score(mutants: DataFrame, file_col: str = "source_file_id") -> DataFrame:
    """Per file: counts by status, and detected / (detected + undetected) * 100; 0 where nothing counts."""
    live, status = ~F.col("static"), F.lower("status")
    n = lambda *kinds: F.count_if(live & status.isin(*kinds))
    counts = mutants.groupBy(file_col).agg(
        n("killed").alias("killed"), n("timeout").alias("timeout"), n("compileerrors").alias("compile_errors"), n("survived").alias("survived"), n("nocoverage").alias("no_coverage"),
        F.count_if(status == "ignored").alias("ignored"), n(*DETECTED).alias("detected"), n(*UNDETECTED).alias("undetected"),
    )
    valid = F.col("detected") + F.col("undetected")
    return counts.withColumn("mutation_score", F.when(valid > 0, F.round(F.col("detected").cast("double") / valid * 100, 9)).otherwise(0.0))


def exists(df: DataFrame, condition: Column | None = None, name: str = "found") -> DataFrame:
    """One row: whether any row meets the condition; false for an empty table."""
    return df.agg(F.coalesce(F.bool_or(F.lit(True) if condition is None else condition), F.lit(False)).alias(name))


def validation_row(flags: dict[str, DataFrame]) -> DataFrame:
    """The flags (one row each) side by side."""
    out = None
    for name, df in flags.items():
        row = df.toDF(name)
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def attempts_until_passed(attempts: DataFrame, key: list[str], order: str, passed: Column, most: int) -> DataFrame:
    """Attempts up to the first that passes, ``most`` at most."""
    w = Window.partitionBy(*key).orderBy(order)
    before = F.sum(F.when(passed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return attempts.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= most).withColumn("_before", F.coalesce(before, F.lit(0))).where("_before = 0").drop("_before")


def random_sample(df: DataFrame, keys: list[str], k: int = 3, seed: int = 7) -> DataFrame:
    """k rows at random (all, if there are no more): those whose first key has the smallest hash, then by the keys, whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(keys[0]).cast("string"))), *keys).limit(k)


def one_per_name(files: DataFrame, path: str) -> DataFrame:
    """Of files with the same name, the one whose path comes first."""
    return files.withColumn("base_name", F.substring_index(path, "/", -1)).groupBy("base_name").agg(F.min(path).alias(path))


def smell_counts(smells: DataFrame, group: str, smell: str, status: str, names: list[str]) -> DataFrame:
    """A row for each group, a column with the number found of each smell, and the total."""
    found = smells.where(F.col(status) == "Found")
    return found.groupBy(group).pivot(smell, names).count().na.fill(0).withColumn("total", sum((F.col(f"`{n}`") for n in names), F.lit(0)).cast("long")) if names else found.groupBy(group).count()


def _next(a: Column, g: Column) -> Column:
    j = F.when(a["g"] == g, a["j"] + 1).otherwise(1)
    return F.struct(g.alias("g"), j.alias("j"), (a["sum"] + 2 * j - 1).cast("long").alias("sum"))


def cohesion(bodies: DataFrame, group: str, body: str, row_id: str, k: int = 3, least: float = 0.6, each: int = 5000) -> DataFrame:
    """Per group: mean cosine similarity of the shingle profiles over ordered pairs of bodies, and whether 1 - mean >= ``least``.

    The sum over all pairs is that of the summed unit vectors with themselves, less each vector's product
    with itself: sum over pairs i != j of u_i u_j = |sum u|^2 - n. No pair is made. Fewer than two
    bodies: not lacking. Bodies shorter than k have no shingles; they count as bodies and are similar to none.

    A body's profile is made in its row; bodies are dealt out to tasks of some ``each``, since a body becomes as many rows as it has shingles.
    """
    clean = bodies.select(group, F.regexp_replace(body, r"\s+", " ").alias("_text")).repartition(max(1, -(-bodies.count() // each)))
    grams = F.transform(F.sequence(F.lit(1), F.length("_text") - (k - 1)), lambda i: F.substring(F.col("_text"), i, F.lit(k)))
    profile = clean.select(group, F.when(F.length("_text") >= k, F.array_sort(grams)).alias("_grams"))
    counts = profile.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count("_grams").alias("_full"))
    # Equal shingles stand together: with j the place among equals, the squares of the counts are the sum of 2j - 1.
    runs = F.aggregate("_grams", F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("sum")), lambda a, g: _next(a, g))
    shingles = profile.where("_grams is not null").select(group, F.sqrt(runs["sum"]).alias("_norm"), F.explode("_grams").alias("_gram"))
    units = shingles.groupBy(group, "_gram").agg(F.sum(1 / F.col("_norm")).alias("_s"))
    square = units.groupBy(group).agg(F.sum(F.col("_s") * F.col("_s")).alias("_square"))
    rows = counts.join(square, group, "left")
    mean = (F.coalesce(F.col("_square"), F.lit(0.0)) - F.col("_full")) / (F.col("_n") * (F.col("_n") - 1))
    rows = rows.withColumn("mean_similarity", F.when(F.col("_n") > 1, F.round(mean, 6) + F.lit(0.0)))
    return rows.select(group, F.col("_n").alias("bodies"), "mean_similarity", F.coalesce(1 - F.col("mean_similarity") >= least, F.lit(False)).alias("lacks_cohesion"))
