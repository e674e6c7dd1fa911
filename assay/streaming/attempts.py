"""Attempts to generate a test, followed as a stream: which of them are made before one of two stop rules, or the number allowed, ends them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: Attempts allowed by strategy.
MOST = {"pass@1": 1, "pass@5": 5}
_OUT = "method_id long, strategy string, seq long, attempt int, stopped boolean"


def stops(passed: Column, failures: Column, coverage: Column, baseline: Column) -> Column:
    """A test that passed, or a run without failures whose coverage is the baseline's at least."""
    return F.coalesce(passed, F.lit(False)) | F.coalesce((failures == 0) & (coverage >= baseline), F.lit(False))


def allowed(strategy: str = "strategy") -> Column:
    return F.coalesce(*(F.when(F.col(strategy) == name, n) for name, n in MOST.items()), F.lit(1))


def until_stopped(attempts: DataFrame) -> DataFrame:
    """The same over a table: method_id, strategy, seq, attempt (from 1), stopped; ``attempts`` has method_id, strategy, seq, stop."""
    w = Window.partitionBy("method_id", "strategy").orderBy("seq")
    before = F.coalesce(F.max(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = attempts.withColumns({"attempt": F.row_number().over(w), "before": before})
    return rows.where((F.col("before") == 0) & (F.col("attempt") <= allowed())).select("method_id", "strategy", "seq", "attempt", F.col("stop").alias("stopped"))


class Attempts(StatefulProcessor):
    """Per (method, strategy) how many attempts were made and whether they have ended. Of a batch only as many as are still allowed are held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", StructType([StructField("made", IntegerType()), StructField("ended", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the API
        made, ended = self.state.get() if self.state.exists() else (0, False)
        most = MOST.get(key[1], 1)
        first: list[tuple[int, bool]] = []
        for frame in rows:
            if not ended and made < most:
                first = heapq.nsmallest(most - made, [*first, *zip(frame["seq"].tolist(), frame["stop"].tolist())])
        out = []
        for seq, stop in first:
            if not ended:
                made, ended = made + 1, bool(stop)
                out.append((key[0], key[1], seq, made, ended))
        self.state.update((made, ended))
        yield pd.DataFrame(out, columns=["method_id", "strategy", "seq", "attempt", "stopped"])

    def close(self) -> None:
        pass


def followed(attempts: DataFrame) -> DataFrame:
    """A stream of attempts (method_id, strategy, seq, stop; those of one batch in any order, batches in order of seq) -> those made."""
    return attempts.groupBy("method_id", "strategy").transformWithStateInPandas(statefulProcessor=Attempts(), outputStructType=_OUT, outputMode="Append", timeMode="None")


def session(spark: SparkSession) -> SparkSession:
    """A session of its own whose state store can hold such states; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
