"""Writes: appends, CSV reports, split outputs, the smell report's JSON tree, the schema's seed."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; where that is unset, in a temporary one for a local master, and an error for others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="assay-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is run here drops its shuffle files when it has ended, so that of steps that read what others wrote only the present one's stand on the disks; otherwise they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: used more than once."""
    path = shared_path(rows.sparkSession, name)
    with freed(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of frames that ``staged`` returned, once nothing reads them any more; others stay."""
    for table in tables:
        if path := vars(table).pop("_staged", None):
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def write_files(files: DataFrame, root: str) -> int:
    """One file for each row (path under ``root``, content; null: empty), written by the tasks that hold the rows; how many there were. A file is written under a hidden name and then moved, so that a task that is tried again leaves each file whole. ``root`` lies in a store that pyarrow opens (local, HDFS, S3, GCS); of rows with one path the last to come stays."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    uri = re.sub(r"^file:/+", "file:///", folder.getFileSystem(conf).makeQualified(folder).toString())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                below, _, name = f"{base}/{path}".rpartition("/")
                store.create_dir(below, recursive=True)
                hidden = f"{below}/_{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content or b"")
                store.move(hidden, f"{below}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select("path", F.encode("content", "UTF-8").alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def append(df: DataFrame, path: str, partition: str | None = "repo_id") -> None:
    """Append Parquet files; the job's commit makes all rows visible or none."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV report, without quotes: its header stands once, in ``header``, written with the first rows; rows go to ``rows`` by as many tasks as hold them. ``header/*`` and ``rows/*`` one after another are the report."""
    df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.mode("ignore").text(f"{path}/header")
    df.select(F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))).write.mode("append").text(f"{path}/rows")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A report's rows; the names come from its header, the types from ``schema``."""
    names = spark.read.text(f"{path}/header").first()[0].split(",")
    return spark.read.schema(StructType([schema[n] for n in names])).option("quote", "").csv(f"{path}/rows")


def split_by(df: DataFrame, path: str, flag: str = "has_tests") -> None:
    df.write.mode("append").partitionBy(flag).parquet(path)


def smell_report(smells: DataFrame) -> DataFrame:
    """class, report: a JSON tree of each class's methods and their smells, in order of name."""
    methods = smells.groupBy("class", "method").agg(F.sort_array(F.collect_list(F.struct(F.col("smell").alias("Name"), F.col("status").alias("Status")))).alias("Smells"))
    classes = methods.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.col("method").alias("Name"), "Smells"))).alias("Methods"))
    return classes.select("class", F.to_json(F.struct(F.col("class").alias("Name"), "Methods")).alias("report"))
