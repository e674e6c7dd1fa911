"""Incremental ingest with Structured Streaming: batches of report rows are added to a table, new keys only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.operators.resolve import insert_if_absent


def insert_new(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's rows with new keys to the Parquet table, the first of each key.

    A batch that is run again after a failure adds nothing twice: its rows are written to a folder of
    their own (``batch=n``), which the rerun overwrites, and are compared with the other batches only.
    """
    schema = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        if number:
            try:
                stored = spark.read.schema(stored.schema).option("basePath", table).parquet(table)
            except Exception as e:  # the first batches had no rows
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new = insert_if_absent(batch, stored.where(F.col("batch") != number), keys, order)
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes_by_window(results: DataFrame, time: str = "ts", outcome: str = "test_outcome", length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of outcomes in windows of time; rows later than the watermark are left out, so the state stays bounded."""
    return results.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), outcome).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), outcome, "n")


def publish(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the counts so far of all windows, each batch over the last; for results that are small beside their input."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_files(spark: SparkSession, root: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Append (name, path) of files that are new to ``table``: of those with one name in the folders below ``root`` the first that a run sees.

    The names seen are the keys of the stream's state, the files seen are in its log: another run over the grown folder adds new names only. No content is read.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    names = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("path")).dropDuplicates(["name"])
    return names.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
