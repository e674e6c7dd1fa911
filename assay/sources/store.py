"""The warehouse's tables in a shared folder: grown by batches, told apart by repository, updated on read.

A table is a folder ``batch=<n>/repo_id=<r>``. A batch is one Spark job, whose commit ends with the ``_SUCCESS`` file;
readers take the batches that have one, so a batch that failed shows no rows, and running it
again writes its folder anew: each row is there once. Updates of stored rows are batches of a table
of their own (``<table>.updates``): the last update of a row is merged when it is read, and ``fold`` writes
it into the partitions that it touches by dynamic partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assay.operators.resolve import latest_state
from assay.sources.sinks import freed, staged

SCOPE, BATCH = "repo_id", "batch"


class Store:
    scope = (SCOPE,)

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType]):
        """``schemas``: of each table without ``batch``; every one has ``repo_id``."""
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def __getattr__(self, table: str) -> DataFrame:
        """A table's rows, as the views take them."""
        if table.startswith("_") or table not in self.schemas:
            raise AttributeError(table)
        return self.read(table).drop(BATCH)

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(conf)

    def append(self, table: str, batch: int, rows: DataFrame) -> None:
        """Write a batch; one that is run again replaces what it wrote before."""
        names = [f.name for f in self._schema(table).fields if f.name != BATCH]
        with freed(self.spark):
            rows.select(*names).write.mode("overwrite").option("compression", "zstd").partitionBy(SCOPE).parquet(f"{self.root}/{table}/{BATCH}={batch}")

    def batches(self, table: str) -> list[int]:
        """The batches whose job was committed."""
        path, fs = self._files()
        done = fs.globStatus(path(f"{self.root}/{table}/{BATCH}=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)

    def _schema(self, table: str) -> StructType:
        fields = list(self.schemas[table].fields)
        return StructType([*fields, StructField(BATCH, LongType())])

    def read(self, table: str, without: int | None = None) -> DataFrame:
        """Committed rows with their ``batch``; ``without``: leave a batch out (one about to be written again)."""
        paths = [f"{self.root}/{table}/{BATCH}={b}" for b in self.batches(table) if b != without]
        schema = self._schema(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)

    def of_repos(self, repos: DataFrame) -> Store:
        """The store with the rows of some repositories (a frame of repo_id): partitions of others are pruned when a query runs."""
        return _Some(self, repos)

    def update(self, table: str, batch: int, rows: DataFrame) -> None:
        """Set columns of stored rows: ``rows`` has repo_id, id, seq (of several updates the highest counts) and the columns."""
        name = f"{table}.updates"
        self.schemas.setdefault(name, StructType([StructField(f.name, f.dataType) for f in rows.schema.fields]))
        self.append(name, batch, rows)

    def current(self, table: str) -> DataFrame:
        """Committed rows with their last updates."""
        rows, name = self.read(table), f"{table}.updates"
        if name not in self.schemas or not self.batches(name):
            return rows
        updates = self.read(name).drop(BATCH)
        changed = [c for c in updates.columns if c not in (SCOPE, "id", "seq")]
        last = latest_state(updates.withColumn("_key", F.struct(SCOPE, "id")).select("_key", "seq", *changed), "_key", "seq")
        last = last.select(F.col(f"_key.{SCOPE}").alias(SCOPE), F.col("_key.id").alias("id"), F.struct(*changed).alias("_new"))
        merged = rows.join(last, [SCOPE, "id"], "left").withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in changed})
        return merged.select(*rows.columns)

    def fold(self, table: str) -> None:
        """Write the updates into the rows' partitions and drop them. Until they are dropped they only say again what the rows hold, so a fold may be lost at any point."""
        name = f"{table}.updates"
        if name not in self.schemas or not (old := self.batches(name)):
            return
        touched = self.read(name).select(SCOPE).distinct()
        rows = staged(self.current(table).join(F.broadcast(touched), SCOPE, "left_semi"), "fold")  # one row a repository
        rows = rows.repartition(BATCH, SCOPE, F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").option("compression", "zstd")
        with freed(self.spark):
            rows.option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, SCOPE).parquet(f"{self.root}/{table}")
        path, fs = self._files()
        for batch in old:
            fs.delete(path(f"{self.root}/{name}/{BATCH}={batch}"), True)


class _Some:
    """A store's tables joined to the repositories asked for."""

    scope = (SCOPE,)

    def __init__(self, store: Store, repos: DataFrame):
        self._store, self._repos = store, repos.groupBy(SCOPE).count().where("count > 0").select(SCOPE)  # a filter, without which Spark doesn't take pruning for worth it

    def __getattr__(self, table: str) -> DataFrame:
        return getattr(self._store, table).join(F.broadcast(self._repos), SCOPE, "left_semi")
