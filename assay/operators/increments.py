"""Views kept by increments: a batch of new rows changes the keys it touches and reads nothing of the others but their keys.

Means are kept as sums and counts, which merge. Kept tables grow by a batch of the touched keys' new states;
a key's state is that of its last batch, so a batch that is run again, or lost, leaves the ones before it as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from assay.plans import views as V
from assay.sources.store import BATCH, SCOPE, Store

MEASURES = ("line_rate", "branch_rate", "complexity")


def partials(rows: DataFrame, keys: list[str], measures: tuple[str, ...]) -> DataFrame:
    """Largest value, sum and count of each measure by key."""
    return rows.groupBy(*keys).agg(*(f(m).alias(f"{n}_{m}") for m in measures for n, f in (("max", F.max), ("sum", F.sum), ("n", F.count))))


def merged(parts: DataFrame, keys: list[str], measures: tuple[str, ...]) -> DataFrame:
    return parts.groupBy(*keys).agg(*(f(f"{n}_{m}").alias(f"{n}_{m}") for m in measures for n, f in (("max", F.max), ("sum", F.sum), ("n", F.sum))))


def mean(measure: str):
    return F.when(F.col(f"n_{measure}") > 0, F.col(f"sum_{measure}") / F.col(f"n_{measure}"))


class Kept:
    """A table of a store with one state for each key, that of the key's last batch."""

    def __init__(self, store: Store, name: str, keys: list[str]):
        self.store, self.name, self.keys = store, name, keys

    def _rows(self, before: int | None) -> DataFrame | None:
        if self.name not in self.store.schemas:
            return None
        rows = self.store.read(self.name)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def put(self, batch: int, rows: DataFrame) -> None:
        self.store.schemas.setdefault(self.name, StructType([StructField(f.name, f.dataType) for f in rows.schema.fields]))
        self.store.append(self.name, batch, rows)

    def current(self, of: DataFrame | None = None, before: int | None = None) -> DataFrame | None:
        """The states, of the keys in ``of`` only, as they were before a batch; None if nothing was ever kept."""
        rows = self._rows(before)
        if rows is None:
            return None
        if of is not None:
            rows = rows.join(of.select(*self.keys).distinct(), self.keys, "left_semi")
        values = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), BATCH).alias("_state")).select(*self.keys, *(F.col(f"_state.{c}").alias(c) for c in values))

    def add(self, batch: int, delta: DataFrame, measures: tuple[str, ...]) -> None:
        """Merge a batch's partial sums with the states of the keys they touch."""
        old = self.current(delta, before=batch)
        self.put(batch, delta if old is None else merged(delta.unionByName(old), self.keys, measures))


def new_rows(store: Store, table: str, batch: int) -> DataFrame:
    return store.read(table).where(F.col(BATCH) == batch).drop(BATCH)


class MethodCoverage:
    """``v_method_coverage_agg`` of a store."""

    def __init__(self, store: Store):
        self.store, self.kept = store, Kept(store, "kept_method_coverage", [SCOPE, "method_id"])

    def refresh(self, batch: int) -> None:
        self.kept.add(batch, partials(new_rows(self.store, "method_coverage", batch), self.kept.keys, MEASURES[:2]), MEASURES[:2])

    def view(self) -> DataFrame:
        rows = self.kept.current()
        means = [(F.round(mean(m), 9) + F.lit(0.0)).alias(f"avg_{m}") for m in MEASURES[:2]]
        return rows.select(*self.kept.keys, *(F.col(f"max_{m}").alias(f"max_{m}") for m in MEASURES[:2]), *means)


class TestAgg:
    """``v_test_agg`` of a store. A batch changes a report's rates by method, the outcomes of a (method, run) and generated tests;
    a newer baseline report changes the methods that it or the one before covers. Only generated tests that meet a change are joined anew.
    A kept row is a test with its rates; its outcomes, which multiply it, are joined when the view is read.
    Methods, classes and what reports consist of are there before the rows that name them."""

    __test__ = False

    def __init__(self, store: Store):
        self.store = store
        self.rates = Kept(store, "kept_report_rates", [SCOPE, "report_id", "method_id"])
        self.baseline = Kept(store, "kept_baseline", [SCOPE])
        self.last = Kept(store, "kept_test_batches", [SCOPE, "generated_test_id"])
        self.rows = "kept_test_agg"

    def refresh(self, batch: int) -> None:
        store = self.store
        packages = store.package_coverage.selectExpr(SCOPE, "id package_id", "coverage_report_id report_id")
        classes = store.class_coverage.selectExpr(SCOPE, "id class_coverage_id", "package_coverage_id package_id")
        home = classes.join(packages, [SCOPE, "package_id"]).drop("package_id")
        fresh = new_rows(store, "method_coverage", batch).select(SCOPE, "class_coverage_id", "method_id", *MEASURES).join(home, [SCOPE, "class_coverage_id"])
        self.rates.add(batch, partials(fresh, self.rates.keys, MEASURES), MEASURES)
        rates = self.rates.current()
        touched = new_rows(store, self.rates.name, batch).select(*self.rates.keys)
        # Reports that arrive after their rates make those count from now on.
        touched = touched.unionByName(rates.join(new_rows(store, "coverage_reports", batch).selectExpr(SCOPE, "id report_id"), [SCOPE, "report_id"], "left_semi").select(*self.rates.keys)).distinct()
        runs = store.test_runs.selectExpr(SCOPE, "id test_run_id", "run_id")
        reports = store.coverage_reports.selectExpr(SCOPE, "id report_id", "test_run_id run_id").join(runs, [SCOPE, "run_id"]).drop("run_id")

        now = V.baseline_report(store).selectExpr(SCOPE, "id report_id")
        was = self.baseline.current(before=batch)
        self.baseline.put(batch, now)
        both = now.join(touched, [SCOPE, "report_id"]).select(SCOPE, "method_id")
        moved = now if was is None else now.join(was.selectExpr(SCOPE, "report_id was"), SCOPE, "left").where("was is null or was <> report_id").select(SCOPE, "report_id")
        if was is not None:
            moved = moved.unionByName(was.join(moved.select(SCOPE), SCOPE, "left_semi"))
        before_of = both.unionByName(rates.join(moved, [SCOPE, "report_id"], "left_semi").select(SCOPE, "method_id")).distinct()
        after_of = touched.join(reports, [SCOPE, "report_id"]).select(SCOPE, "method_id", "test_run_id").distinct()
        heard = V.latest_test_outcome(_Batch(store, batch)).selectExpr(SCOPE, "test_run_db_id test_run_id", "test_method_id gen_test_method_id").distinct()

        tests = store.read("generated_tests")
        mine = tests.where(F.col(BATCH) == batch)
        key = tests.withColumnRenamed("original_method_id", "method_id")
        changed = [key.join(before_of, [SCOPE, "method_id"], "left_semi"), key.join(after_of, [SCOPE, "method_id", "test_run_id"], "left_semi"), key.join(heard, [SCOPE, "gen_test_method_id", "test_run_id"], "left_semi")]
        affected = mine.select(SCOPE, "id")
        for rows in changed:
            affected = affected.unionByName(rows.select(SCOPE, "id"))
        self.last.put(batch, affected.distinct().select(SCOPE, F.col("id").alias("generated_test_id"), F.lit(batch).cast("long").alias("last")))
        affected = new_rows(store, self.last.name, batch).select(SCOPE, F.col("generated_test_id").alias("id"))
        tests = tests.drop(BATCH).join(affected, [SCOPE, "id"], "left_semi")

        methods = tests.select(SCOPE, F.col("original_method_id").alias("method_id"), "test_run_id").distinct()
        near = rates.join(methods.select(SCOPE, "method_id").distinct(), [SCOPE, "method_id"], "left_semi")
        means = lambda rows, keys, who: merged(rows, keys, MEASURES).select(*keys, *(mean(m).alias(f"{who}_{m}") for m in MEASURES))
        before = means(near.join(now, [SCOPE, "report_id"], "left_semi"), [SCOPE, "method_id"], "baseline")
        after = means(near.join(reports, [SCOPE, "report_id"]).join(methods, [SCOPE, "method_id", "test_run_id"], "left_semi"), [SCOPE, "method_id", "test_run_id"], "generated")
        Kept(store, self.rows, []).put(batch, V.rated_tests(store, tests, before, after))

    def view(self) -> DataFrame:
        """A test's state is that of its last batch; it is told where its rows meet its outcomes, so that they are shuffled once."""
        meets = [SCOPE, "gen_test_method_id", "test_run_id"]
        rows = self.store.read(self.rows).repartition(*meets)
        last = F.max(BATCH).over(Window.partitionBy(*meets, "generated_test_id"))
        rows = rows.withColumn("_last", last).where(F.col(BATCH) == F.col("_last")).drop(BATCH, "_last")
        return V.with_outcomes(self.store, rows, V.distinct_outcomes(self.store), V.RATES)


class _Batch:
    """A store whose results are those of one batch."""

    def __init__(self, store: Store, batch: int):
        self.scope, self.test_runs, self.test_results = store.scope, store.test_runs, new_rows(store, "test_results", batch)
