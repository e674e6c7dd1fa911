"""Stored tables: batches that fail, updates and folding, ids of ingested entities, call resolution, pruned repositories."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assay.operators import entities as E
from assay.operators import resolve as R
from assay.plans import store_queries as Q
from assay.plans import views as V
from assay.sources import schema
from assay.sources.adapters import REPOS, RepoTables
from assay.sources.store import Store

SF = "/root/testdata/sf0.001"


def store_of(spark, path, ddl="repo_id string, id long, value string"):
    return Store(spark, str(path), {"t": StructType.fromDDL(ddl)})


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_failed_batch_is_invisible_and_its_retry_counts_once(spark, tmp_path):
    store, marker = store_of(spark, tmp_path / "w"), str(tmp_path / "fail")
    store.append("t", 1, spark.createDataFrame([("a", 1, "x")], store.schemas["t"]))

    def late(batches):
        for batch in batches:
            yield batch
            if os.path.exists(marker) and 400 in batch.column(1).to_pylist():
                raise RuntimeError("task lost")

    new = spark.range(2, 402).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("repo_id"), "id", F.lit("new").alias("value"))
    frame = new.repartition(4).mapInArrow(late, "repo_id string, id long, value string")
    open(marker, "w").close()
    with pytest.raises(Exception, match="task lost"):
        store.append("t", 2, frame)
    assert store.batches("t") == [1] and rows_of(store.read("t")) == [("a", 1, "x", 1)]
    os.remove(marker)
    for _ in range(2):  # a batch written twice is there once
        store.append("t", 2, frame)
        assert store.batches("t") == [1, 2] and store.read("t").count() == 401 and store.read("t").select("id").distinct().count() == 401
    assert rows_of(store.read("t", without=2)) == [("a", 1, "x", 1)]


def test_updates_merge_on_read_and_fold(spark, tmp_path):
    store = store_of(spark, tmp_path / "w")
    store.append("t", 1, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], store.schemas["t"]))
    store.append("t", 2, spark.createDataFrame([("b", 2, None), ("c", 1, "k")], store.schemas["t"]))
    assert rows_of(store.current("t").na.fill("?")) == rows_of(store.read("t").na.fill("?"))
    kind = "repo_id string, id long, seq long, value string"
    store.update("t", 1, spark.createDataFrame([("a", 1, 5, "late"), ("b", 2, 1, "set"), ("z", 9, 1, "nobody")], kind))
    store.update("t", 2, spark.createDataFrame([("a", 1, 4, "early"), ("b", 1, 2, None)], kind))
    want = [("a", 1, "late", 1), ("a", 2, "y", 1), ("b", 1, "?", 1), ("b", 2, "set", 2), ("c", 1, "k", 2)]
    assert rows_of(store.current("t").na.fill("?")) == want
    untouched = {f for f in os.listdir(tmp_path / "w/t/batch=2/repo_id=c") if f.endswith("parquet")}
    store.fold("t")
    assert store.batches("t.updates") == [] and rows_of(store.read("t").na.fill("?")) == want == rows_of(store.current("t").na.fill("?"))
    assert untouched == {f for f in os.listdir(tmp_path / "w/t/batch=2/repo_id=c") if f.endswith("parquet")}
    store.update("t", 3, spark.createDataFrame([("c", 1, 1, "again")], kind))
    assert ("c", 1, "again", 2) in rows_of(store.current("t").na.fill("?"))


def test_views_of_chosen_repositories_prune_partitions(spark):
    t = RepoTables(spark, SF)
    store = Q.stored(t, ["method_coverage"])
    repos = t.test_runs.select("repo_id", "run_id").where("run_id like 'run_africa'")
    view = V.method_coverage_agg(store.of_repos(repos))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dynamicpruning" in plan
    assert [r.repo_id for r in view.select("repo_id").distinct().collect()] == ["repo_4"]


def ingested(spark, store, batch, classes, methods):
    frame = lambda rows, more: spark.createDataFrame(rows, f"repo_id string, guid string, {more}")
    given = frame(classes, "name string, content_hash string, file_id long")
    below = frame(methods, "parent string, name string, content_hash string")
    return E.ingest(store, batch, [E.Entity("classes", given), E.Entity("methods", below, ("classes", "class_id"))])


def test_ingest_keeps_ids(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"), {n: schema.schema_of(n) for n in ("classes", "methods")})
    classes = [(r, f"c{i}", f"C{i}", f"h{i % 7}", 1) for r in ("a", "b") for i in range(9)]
    methods = [(r, f"m{i}", f"c{i % 9}", f"M{i}", f"k{i}") for r in ("a", "b") for i in range(40)]
    first = {k: rows_of(v) for k, v in ingested(spark, store, 1, classes[:7] + classes[9:], [m for m in methods if m[2] != "c8"][:50]).items()}
    before = {n: rows_of(store.read(n).select("repo_id", "id", "content_hash")) for n in ("classes", "methods")}
    # Of classes with one content the first is stored, and children of the others belong to it.
    assert len([x for x in before["classes"] if x[0] == "b"]) == 7 and dict(((r, g), i) for r, g, i in first["classes"])["b", "c8"] == dict(((r, g), i) for r, g, i in first["classes"])["b", "c1"]
    more = [*methods, ("a", "orphan", "nothing", "X", "kx"), ("a", "m0-again", "c0", "M", "k0"), ("a", "later", "c3", "M", "k-new")]
    for _ in range(2):  # the second time as after a failure
        second = {k: rows_of(v) for k, v in ingested(spark, store, 2, [c for c in classes if c[1] != "c3"], more).items()}
        for table in ("classes", "methods"):
            stored = rows_of(store.read(table).select("repo_id", "id", "content_hash"))
            assert set(before[table]) <= set(stored)
            for repo in ("a", "b"):
                ids = sorted(i for r, i, _ in stored if r == repo)
                assert ids == list(range(1, len(ids) + 1))
    ids = {(r, g): i for r, g, i in second["methods"]}
    assert ids["a", "m0-again"] == ids["a", "m0"] and ("a", "orphan") not in ids and ids["a", "later"]
    kept = {(r, g): i for r, g, i in first["methods"]}
    assert all(ids[k] == i for k, i in kept.items()) and len(set(ids)) == 82
    placed = store.read("methods").join(store.read("classes").selectExpr("repo_id", "id class_id", "content_hash h"), ["repo_id", "class_id"]).select("repo_id", "guid", "h")
    want = {(r, g): f"h{int(p[1:]) % 7}" for r, g, p, _, _ in [*methods, ("a", "later", "c3", "", "")]}
    assert {(r, g): h for r, g, h in rows_of(placed)} == want


def test_ingest_of_many_rows_keeps_ids(spark, tmp_path, monkeypatch):
    """Rows too many for a filter, those that nothing refers to not staged: the same ids. Rows are sorted by a hash of their key, not by the few repositories."""
    plans, write = {}, E.staged

    def noted(rows, name):
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return write(rows, name)

    monkeypatch.setattr(E, "MOST", 0)
    monkeypatch.setattr(E, "staged", noted)
    test_ingest_keeps_ids(spark, tmp_path)
    assert "rows-classes" in plans and not {n for n in plans if n.startswith("filter") or n == "rows-methods"}
    sorts = [x for n in ("first-classes", "first-methods") for x in plans[n].split("Sort [")[1:]]
    assert sorts and all(x.startswith(("_key#", "_up#")) for x in sorts)


def test_ingest_asks_for_methods_and_calls_once(spark):
    """Calls are merged and joined to their methods' files for all batches together."""
    asked = []

    class Noted(RepoTables):
        def __getattr__(self, name):
            asked.append(name)
            return super().__getattr__(name)

    Q.ingested(Noted(spark, SF))
    assert asked.count("methods") == asked.count("invocations") == asked.count("classes") == 1


def test_key_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    stored = spark.range(100_000).select("id", F.xxhash64("id").alias("k"))
    left = [r.id for r in E.maybe_in(stored, "k", E.key_filter(keys, "k")).select("id").collect()]
    assert set(range(5000)) <= set(left) and len(left) < 5100
    assert E.maybe_in(stored, "k", E.key_filter(keys.limit(0), "k")).count() == 0


def test_calls_resolve_as_by_a_loop(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab(%_)") for _ in range(n))
    calls = [(f, i, text(rng.choice([0, 1, 2, 3, 4, 5, 6]))) for i, f in enumerate(rng.choices("xxxyz", k=60))] + [("x", 99, None)]
    expressions = [(f, i, text(rng.randrange(14)), rng.choice("mno"), rng.choice("pq")) for i, f in enumerate(rng.choices("xxxyw", k=150))]
    defined = {("m", "p"): 4, ("m", "q"): 2, ("n", "p"): 9}
    methods = [(i, *k) for k, i in defined.items()] + [(7, "n", "p"), (10, "n", "p")]
    defined["n", "p"] = 7
    want = []
    for file, i, part in calls:
        met = [(seq, defined[n, p]) for f, seq, t, n, p in expressions if f == file and part is not None and part in t and (n, p) in defined]
        want += [(i, *max(met))] if met else []
    frame = spark.createDataFrame
    got = R.resolve_calls(frame(calls, "file string, id long, full_string string"), frame(expressions, "file string, seq long, text string, name string, path string"), frame(methods, "id long, name string, path string"), ["file"], [])
    assert rows_of(got) == sorted(want) and len(want) > 20


def test_increment_touches_its_own_keys_only(spark):
    """A batch with one result: only the tests with that generated method and run are joined anew; a repeated refresh changes nothing."""
    from assay.operators.increments import TestAgg

    t = RepoTables(spark, SF)
    few = lambda name: getattr(t, name).where("repo_id in ('repo_1', 'repo_4')")
    store = Store(spark, Q.sinks.shared_path(spark, "w"), {n: StructType(list(getattr(t, n).schema.fields)) for n in Q._OF_TEST_AGG})
    view = TestAgg(store)
    results = few("test_results")
    asked = few("generated_tests").join(few("test_runs").selectExpr("repo_id", "id test_run_id", "run_id"), ["repo_id", "test_run_id"]).selectExpr("repo_id", "gen_test_method_id method_id", "run_id")
    one = results.join(asked, ["repo_id", "method_id", "run_id"], "left_semi").orderBy("repo_id", "id").limit(1)
    picked = one.first()
    for batch in (1, 2):
        for name in Q._OF_TEST_AGG:
            rows = few(name)
            if name == "test_results":
                here = (F.col("id") == picked.id) & (F.col("repo_id") == picked.repo_id)
                rows = rows.where(~here if batch == 1 else here)
            store.append(name, batch, rows if batch == 1 or name == "test_results" else rows.limit(0))
        view.refresh(batch)
    view.refresh(2)
    again = store.read(view.rows).where("batch = 2").select("repo_id", "generated_test_id").distinct()
    want = few("generated_tests").where((F.col("repo_id") == picked.repo_id) & (F.col("gen_test_method_id") == picked.method_id))
    want = want.join(few("test_runs").where(F.col("run_id") == picked.run_id).selectExpr("repo_id", "id test_run_id"), ["repo_id", "test_run_id"], "left_semi")
    assert rows_of(again) == rows_of(want.select("repo_id", "id")) and 0 < again.count() < 50
    full = V.test_agg(store)
    assert rows_of(view.view().select(*map(F.col, full.columns)).na.fill("")) == rows_of(full.na.fill(""))


def test_kept_tests_are_not_multiplied_by_outcomes(spark):
    from assay.operators.increments import TestAgg

    t = RepoTables(spark, SF)
    store = Q.stored(t, Q._OF_TEST_AGG)
    view = TestAgg(store)
    view.refresh(1)
    assert store.read(view.rows).count() == t.generated_tests.count() < view.view().count()


def test_shared_tables_are_taken_for_the_size_of_all_repositories(spark):
    """Rows of every repository that Spark takes for one repository's are broadcast through the driver."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    t = RepoTables(spark, SF)
    for name in ("class_coverage", "classes", "methods", "source_files"):
        assert size(getattr(t, name).drop("repo_id")) >= REPOS * size(getattr(t.one, name)), name
        assert getattr(t, name).count() == REPOS * getattr(t.one, name).count()


def _shuffle_files(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_steps_drop_their_shuffle_files(spark, tmp_path):
    """Steps that write tables leave no shuffle files behind; the session's setting is as before, and later runs of the same frame work."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(500).selectExpr("concat('r', id % 3) repo_id", "id", "'x' value").repartition(4, "id").groupBy("repo_id", "id").agg(F.first("value").alias("value"))
    store, before, setting = store_of(spark, tmp_path / "w"), _shuffle_files(spark), spark.conf.get(name, None)
    store.append("t", 1, rows)
    store.update("t", 1, rows.selectExpr("repo_id", "id", "1L seq", "'y' value"))
    store.fold("t")
    copy = E.staged(rows, "copy")
    assert _shuffle_files(spark) <= before and spark.conf.get(name, None) == setting
    assert rows.count() == copy.count() == 500 and {r.value for r in store.read("t").collect()} == {"y"}


def test_ingest_leaves_only_the_store(spark, monkeypatch):
    """What is staged for a table goes before the next table's turn, but for ids; in the end only small tables that nothing refers to are left. Hashes are staged as bytes, stored as digits."""
    written, kinds, write = {}, {}, E.staged

    def noted(rows, name):
        there = [n for n, p in written.items() if os.path.exists(p) and n.split("-")[0] in ("first", "filter") and n.split("-")[1] != name.split("-")[1]]
        assert not there, (name, there)
        out = write(rows, name)
        written[name], kinds[name] = out.inputFiles()[0].removeprefix("file:").removeprefix("//").rpartition("/")[0], dict(out.dtypes)
        return out

    monkeypatch.setattr(E, "staged", noted)
    monkeypatch.setattr(Q.sinks, "staged", noted)
    store = Q.ingested(RepoTables(spark, SF))
    assert {"parsed-methods", "parsed-calls", "rows-methods", "first-methods", "ids-methods", "first-invocations"} <= written.keys()
    assert {n for n, p in written.items() if os.path.exists(p)} <= {"rows-properties", "rows-invocations"}
    assert kinds["first-invocations"]["content_hash"] == "binary"
    calls = store.read("invocations")
    assert calls.where("content_hash <> sha2(full_string, 256)").count() == 0 < calls.count()


def test_kept_tests_are_shuffled_once_when_read(spark):
    """The view tells a test's last state where it meets its outcomes: one exchange of the kept rows."""
    from assay.operators.increments import TestAgg

    store = Q.in_batches(t := RepoTables(spark, SF), Q._OF_TEST_AGG)
    view = TestAgg(store)
    Q._append(t, store, 1)
    view.refresh(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = view.view()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = plan.split("FileScan")[0]  # from the top down to the kept rows
    assert kept.count("Exchange hashpartitioning") == 1
