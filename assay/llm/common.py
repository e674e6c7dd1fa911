"""What the operators share: table access, Arrow batches of bounded size, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than these (space and U+0009 to U+000D).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Rows that a function gets at a time. Spark bounds the batches that cross to Python (10,000 rows and
#: 64 MB unless the session says otherwise); whole texts become Python objects, so these are cut once more.
BATCH_ROWS = 512


#: What a Python worker remembers for an operator, and how to forget it.
_CACHES: dict[str, Callable[[], None]] = {}


def cache_of(owner: str, forget: Callable[[], None]) -> None:
    _CACHES[owner] = forget


def claim(owner: str | None = None) -> None:
    """A worker that turns to another operator forgets what it kept for the last one."""
    for name, forget in _CACHES.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, owner: str | None = None) -> DataFrame:
    """``fn`` over Arrow batches of ``BATCH_ROWS`` rows at most. It may return None for nothing; an empty frame gives an empty frame. ``owner``: whose cache ``fn`` uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in short(batches):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; where that is unset, a temporary one for a local master, and an error for others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="assay-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: executors can be lost without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def offsets(lengths: list[int]) -> pa.Array:
    import numpy as np

    return pa.array(np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int32))
