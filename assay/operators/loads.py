"""Loads of report rows: what a lookup binds is stored, what it doesn't is stored with the reason, and both are counted on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from assay.sources.sinks import shared_path


@dataclass(frozen=True)
class Load:
    """A finished load: its rows by fate, and the numbers that its one pass observed."""

    bound: DataFrame
    rejects: DataFrame
    read: int
    rejected: int


def load(rows: DataFrame, found: str, reason: str) -> Load:
    """Write ``rows`` (looked up: ``found`` is null where nothing was) to one folder, split by whether they are bound, in one pass."""
    seen = Observation()
    lost = F.col(found).isNull()
    split = rows.withColumns({"rejected": lost, "reason": F.when(lost, reason)}).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(lost).alias("rejected"))
    path = shared_path(rows.sparkSession, "load")
    split.write.partitionBy("rejected").parquet(path)
    stored = rows.sparkSession.read.schema(split.schema).parquet(path)
    return Load(stored.where("not rejected").drop("rejected", "reason"), stored.where("rejected").drop("rejected", found), seen.get["read"], seen.get["rejected"])
