"""Reports read in splits, united coverage, loads with rejects, attempts and files followed as streams."""

import random

from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.operators import coverage as V
from assay.operators import loads
from assay.operators import resolve as R
from assay.sources import elements as E
from assay.sources import sinks
from assay.streaming import attempts as A
from assay.streaming import ingest


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def in_splits(spark, size="16k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def whole(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_report_in_splits(spark, tmp_path):
    """Elements over split borders, broken ones, nested ones, self-closing ones, names that begin alike."""
    (tmp_path / "in" / "a").mkdir(parents=True)
    item = lambda i: f'<UnitTestResult testName="S.T{i}"{" outcome=" if i % 100 == 7 else " outcome=" + chr(34) + "Passed" + chr(34)}>\n<Output><ErrorInfo><Message>m {i} &lt;é</Message></ErrorInfo></Output></UnitTestResult>\n'
    text = '<?xml version="1.0"?><TestRun xmlns="http://x/y"><Results>\n' + "".join(map(item, range(3000)))
    text += '<UnitTestResult testName="a > b" duration="00:00:01"/><UnitTestResultList x="1"/><UnitTestResult testName="outer"><InnerResults><UnitTestResult testName="inner" outcome="Failed"></UnitTestResult></InnerResults></UnitTestResult></Results></TestRun>'
    (tmp_path / "in" / "a" / "big.trx").write_text(text, encoding="utf-8")
    (tmp_path / "in" / "none.trx").write_text(" \n<?xml version='1.0'?><TestRun/>")
    (tmp_path / "in" / "cut.trx").write_text('<TestRun><UnitTestResult testName="cut off')
    in_splits(spark)
    try:
        found = E.elements(spark, str(tmp_path / "in"), "UnitTestResult", "*.trx")
        assert found.select(F.spark_partition_id()).distinct().count() > 10
        got, rejects = E.trx_results(spark, str(tmp_path / "in"), "*.trx")
        got, lost = rows_of(got.na.fill("-")), rejects.groupBy("path", "reason").count()
    finally:
        whole(spark)
    want = [("a/big.trx", f"S.T{i}", "Passed", "00:00:00", f"m {i} <é") for i in range(3000) if i % 100 != 7]
    want += [("a/big.trx", "a > b", "", "00:00:01", "-"), ("a/big.trx", "outer", "", "00:00:00", "-"), ("a/big.trx", "inner", "Failed", "00:00:00", "-")]
    assert got == sorted(want) and rows_of(lost) == [("a/big.trx", "not well-formed", 30), ("cut.trx", "not well-formed", 1)]


def test_message_on_any_line_of_a_large_log(spark, tmp_path):
    (tmp_path / "a_docker.log").write_text("x\n" * 50_000 + "now Code Coverage is currently supported only on Windows. end\n" + "y\n" * 50_000)
    (tmp_path / "b_docker.log").write_text("z\n" * 10)
    in_splits(spark)
    try:
        lines = E.log_lines(spark, str(tmp_path), "*.log")
        assert lines.select(F.spark_partition_id()).distinct().count() > 5 and lines.count() == 100_011
        got = rows_of(E.logs_with(lines, S.windows_only(F.col("line"))))
    finally:
        whole(spark)
    assert got == [("a_docker.log", True), ("b_docker.log", False)]


def test_united_lines(spark):
    """Against sets of lines, beyond one bitmap's 32,768 lines."""
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(3)}", rng.choice("ab"), rng.randrange(1, 100_000), rng.choice([0, 0, 2]), n, rng.randint(0, n)) for n in rng.choices([0, 2, 4], k=4000)] + [("r9", "c", 5, 0, 0, 0), ("r9", "c", 0, 1, 0, 0)]
    lines = spark.createDataFrame(rows, "path string, file string, line int, hits long, conditions int, conditions_met int")
    got = rows_of(V.line_rates(V.united(V.line_bitmaps(lines, ["path", "file"]), ["file"]), ["file"]))
    want = []
    for f in "abc":
        valid, hit = {x[2] for x in rows if x[1] == f and x[2]}, {x[2] for x in rows if x[1] == f and x[2] and x[3]}
        want.append((f, len(valid), len(hit), round(len(hit) / len(valid), 9)))
    assert got == want
    one = spark.createDataFrame([("p", "a", 1, 1, 4, 1), ("q", "a", 1, 1, 4, 3), ("q", "a", 2, 1, 2, 2)], lines.schema)
    assert rows_of(V.condition_rates(one, ["file"])) == [("a", 6, 5)]


def test_load_counts(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(100)], "id long, k long")
    known = spark.createDataFrame([(0,), (3,)], "k long").withColumn("eid", F.col("k") * 10)
    done = loads.load(R.lookup(rows, known, ["k"], "eid", "found"), "found", "no entity")
    assert (done.read, done.rejected, done.bound.count(), done.rejects.count()) == (100, 60, 40, 60)
    assert {r.reason for r in done.rejects.collect()} == {"no entity"} and {(r.k, r.found) for r in done.bound.collect()} == {(0, 0), (3, 30)}
    none = loads.load(R.lookup(rows.limit(0), known, ["k"], "eid", "found"), "found", "x")
    assert (none.read, none.rejected, none.bound.count()) == (0, 0, 0)


def test_attempts_over_batches(spark, tmp_path):
    """The stream's state goes on from batch to batch and from run to run; it equals the table's answer."""
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.choice(["pass@1", "pass@5", "other"]), seq, rng.random() < 0.2) for seq in range(300)]
    schema = "method_id long, strategy string, seq long, stop boolean"
    own, table, source = A.session(spark), str(tmp_path / "out"), str(tmp_path / "in")
    for batch in range(3):
        part = rows[batch * 100 : batch * 100 + 100]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(source)
        made = A.followed(own.readStream.schema(schema).parquet(source))
        made.writeStream.format("parquet").option("path", table).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(table)) == rows_of(A.until_stopped(spark.createDataFrame(rows, schema)))
    rules = spark.createDataFrame([(True, 5, 0.1, 0.9), (False, 0, 0.9, 0.9), (False, 0, 0.8, 0.9), (False, 1, 1.0, 0.9), (None, None, None, None)], "p boolean, f int, c double, b double")
    assert [r.s for r in rules.select(A.stops(F.col("p"), F.col("f"), F.col("c"), F.col("b")).alias("s")).collect()] == [True, True, False, False, False]


def test_files_are_seen_once(spark, tmp_path):
    root, table = str(tmp_path / "reports"), str(tmp_path / "seen")
    for run, names in enumerate((["a/x.xml", "b/y.xml", "b/x.xml", "b/log.txt"], ["c/y.xml", "c/z.xml"], [])):
        if names:
            sinks.write_files(spark.createDataFrame([(n, "<r/>") for n in names], "path string, content string"), root)
        ingest.report_files(spark, root, table, f"{table}-at", "*.xml").awaitTermination()
        assert [r.name for r in spark.read.parquet(table).orderBy("name").collect()] == (["x.xml", "y.xml"] if run == 0 else ["x.xml", "y.xml", "z.xml"])
