"""Queries over report files that Spark wrote from the tables, read back in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.operators import coverage as V
from assay.operators import loads
from assay.operators import resolve as R
from assay.plans.operator_queries import _LOG, over_tables
from assay.sources import elements as E
from assay.sources import reports as P
from assay.sources import sinks
from assay.sources.adapters import Tables
from assay.streaming import attempts as A
from assay.streaming import ingest

C, L = F.col, F.lit


def reports_of(t: Tables, rows: DataFrame, report: Column, text: Column, before: str, after: str, name: str) -> str:
    """A folder of reports ``report=<r>``, written by tasks: each file has its head, its items and its end."""
    root = sinks.shared_path(t.spark, name)
    items = rows.select(report.alias("report"), L(1).alias("place"), text.alias("value"))
    ends = items.select("report").distinct()
    parts = items.unionByName(ends.select("report", L(0).alias("place"), L(before).alias("value"))).unionByName(ends.select("report", L(2).alias("place"), L(after).alias("value")))
    parts.repartition("report").sortWithinPartitions("report", "place").select("report", "value").write.partitionBy("report").text(root)
    return root


def _report(column: str = "path") -> Column:
    return F.regexp_extract(column, r"report=([^/]+)/", 1)


_BROKEN = "event_id % 10 = 7"


@over_tables("scan_trx_splits", f"SELECT (event_id % 8)::VARCHAR AS report, count(*) FILTER (WHERE NOT {_BROKEN}) AS results, count(*) FILTER (WHERE event_type = 'error' AND NOT {_BROKEN}) AS with_message, count(*) FILTER (WHERE {_BROKEN}) AS rejected FROM events GROUP BY 1")
def scan_trx_splits(t: Tables) -> DataFrame:
    """Results of each report file, read element by element; a tenth of them are broken and are counted as rejects, with no loss around them."""
    attribute = F.when(F.expr(_BROKEN), L(" outcome=")).otherwise(F.format_string(' outcome="%s"', "event_type"))
    error = F.when(C("event_type") == "error", L("<Output><ErrorInfo><Message>a &lt; b</Message></ErrorInfo></Output>")).otherwise("")
    item = F.concat(F.format_string('<UnitTestResult testName="S.T%d"', "event_id"), attribute, L(">\n"), error, L("</UnitTestResult>"))
    root = reports_of(t, t.raw("events"), C("event_id") % 8, item, '<?xml version="1.0"?>\n<TestRun xmlns="http://x/y"><Results>', "</Results></TestRun>", "trx")
    rows, rejects = E.trx_results(t.spark, root)
    counts = rows.groupBy(_report().alias("report")).agg(F.count(L(1)).alias("results"), F.count("error_message").alias("with_message"))
    lost = rejects.groupBy(_report().alias("report")).agg(F.count(L(1)).alias("rejected"))
    return counts.join(lost, "report", "left").select("report", "results", "with_message", F.coalesce("rejected", L(0)).alias("rejected"))


#: Lines of a source file in the reports of eight test projects.
_LINES = "SELECT l_orderkey % 8 AS report, l_suppkey AS file, l_quantity::INT AS line, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS hits, CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 0 END AS conditions, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 5 ELSE 0 END AS met FROM lineitem"


def _coverage_folder(t: Tables) -> str:
    rows = t.raw("lineitem").selectExpr("l_orderkey % 8 report", "l_suppkey file", "cast(l_quantity as int) line", "if(l_returnflag = 'R', l_linenumber, 0) hits", "l_linenumber % 3 = 0 branch", "l_partkey % 5 met")
    condition = F.when(C("branch"), F.format_string(' branch="true" condition-coverage="%d%% (%d/4)"', C("met") * 25, "met")).otherwise("")
    line = F.concat(F.format_string('<line number="%d" hits="%d"', "line", "hits"), condition, L("/>"))
    classes = rows.groupBy("report", "file").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    item = F.concat(F.format_string('<class name="C%d" filename="src/F%d.cs"><methods><method name="M"><lines><line number="999" hits="1"/></lines></method></methods><lines>', "file", "file"), "lines", L("</lines></class>"))
    return reports_of(t, classes, C("report"), item, '<?xml version="1.0"?><coverage><packages><package name="P"><classes>', "</classes></package></packages></coverage>", "cobertura")


@over_tables("united_line_coverage", f"SELECT 'src/F' || file || '.cs' AS file, count(DISTINCT line) AS lines_valid, count(DISTINCT CASE WHEN hits > 0 THEN line END) AS lines_covered, round(count(DISTINCT CASE WHEN hits > 0 THEN line END)::DOUBLE / count(DISTINCT line), 9) AS line_rate FROM ({_LINES}) GROUP BY 1")
def united_line_coverage(t: Tables) -> DataFrame:
    """Each source file's lines that any report has or covers: reports of one file name are united, none is dropped."""
    lines, _ = E.coverage_lines(t.spark, _coverage_folder(t))
    return V.line_rates(V.united(V.line_bitmaps(lines, ["path", "file"]), ["file"]), ["file"])


@over_tables("united_condition_coverage", f"SELECT 'src/F' || file || '.cs' AS file, sum(n)::BIGINT AS conditions, sum(met)::BIGINT AS conditions_met FROM (SELECT file, line, max(conditions) AS n, max(met) AS met FROM ({_LINES}) WHERE conditions > 0 GROUP BY file, line) GROUP BY 1")
def united_condition_coverage(t: Tables) -> DataFrame:
    lines, _ = E.coverage_lines(t.spark, _coverage_folder(t))
    return V.condition_rates(lines, ["file"])


@over_tables("scan_log_lines", f"SELECT lang AS project, bool_or(({_LOG}) ILIKE '%Code coverage is currently supported only on Windows.%') IS TRUE AS windows_only FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def scan_log_lines(t: Tables) -> DataFrame:
    """Which projects' logs hold the message on any line; logs are read line by line in splits."""
    root = sinks.shared_path(t.spark, "logs")
    t.raw("documents").where("lang is not null").select("lang", F.coalesce(F.expr(_LOG), L("")).alias("value")).write.partitionBy("lang").text(root)
    found = E.logs_with(E.log_lines(t.spark, root), S.windows_only(C("line")), "windows_only")
    return found.groupBy(F.regexp_extract("path", r"lang=([^/]+)/", 1).alias("project")).agg(F.bool_or("windows_only").alias("windows_only"))


_ATTEMPTS = "SELECT user_id AS method_id, CASE WHEN user_id % 3 = 0 THEN 'pass@1' ELSE 'pass@5' END AS strategy, event_id AS seq, coalesce(event_type = 'purchase', false) OR coalesce(event_type <> 'error' AND value >= 80, false) AS stop FROM events"
_MADE = f"SELECT method_id, strategy, seq, attempt, stop AS stopped FROM (SELECT *, (row_number() OVER w)::INT AS attempt, coalesce(max(stop::INT) OVER (PARTITION BY method_id, strategy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_ATTEMPTS}) WINDOW w AS (PARTITION BY method_id, strategy ORDER BY seq)) WHERE before = 0 AND attempt <= CASE strategy WHEN 'pass@1' THEN 1 ELSE 5 END"


def _attempts(events: DataFrame) -> DataFrame:
    strategy = F.when(C("user_id") % 3 == 0, "pass@1").otherwise("pass@5")
    stop = A.stops(C("event_type") == "purchase", (C("event_type") == "error").cast("int"), C("value"), L(80))
    return events.select(C("user_id").alias("method_id"), strategy.alias("strategy"), C("event_id").alias("seq"), stop.alias("stop"))


@over_tables("attempts_two_rules", _MADE)
def attempts_two_rules(t: Tables) -> DataFrame:
    """Attempts up to the first that passes, or that fails nothing and covers as much as the baseline, within what the strategy allows."""
    return A.until_stopped(_attempts(t.raw("events")))


@over_tables("stream_attempts", _MADE)
def stream_attempts(t: Tables) -> DataFrame:
    """The same attempts followed as a stream."""
    own = A.session(t.spark)
    table = sinks.shared_path(t.spark, "attempts")
    rows = A.followed(_attempts(Tables(own, t.dir).stream("events")))
    rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", f"{table}-offsets").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(table)


#: Loads of report rows: their table, the column looked up, the entities that are known.
LOADS = {
    "test_results": ("test_results", "method_id", "methods", "id % 2 = 0"), "method_coverage": ("method_coverage", "method_id", "methods", "NOT is_test_method"), "class_coverage": ("class_coverage", "class_id", "classes", "NOT is_test_class"),
    "mutants": ("mutants", "source_file_id", "source_files", "id % 7 > 0"), "function_metrics": ("lizard_function_code_metrics", "method_id", "methods", "id % 5 > 0"), "file_metrics": ("source_files", "analysis_project_id", "analysis_projects", "id % 4 > 0"),
    "smells": ("method_test_smells", "method_id", "methods", "is_test_method"),
}


@over_tables(
    "report_rejects",
    " UNION ALL ".join(f"SELECT '{name}' AS load, count(*) AS n_read, count(e.id) AS bound, count(*) - count(e.id) AS rejected, count(*) AS observed FROM {table} r LEFT JOIN (SELECT id FROM {entity} WHERE {known}) e ON e.id = r.{key}" for name, (table, key, entity, known) in LOADS.items()),
)
def report_rejects(t: Tables) -> DataFrame:
    """Seven loads of report rows, each written in one pass as bound rows and rejects: counts of both read back, and what the pass itself observed."""
    out = None
    for name, (table, key, entity, known) in LOADS.items():
        entities = getattr(t, entity).where(known).select(C("id").alias(key))
        done = loads.load(R.lookup(getattr(t, table), entities.withColumn("known", C(key)), [key], "known", "found"), "found", f"no {entity}")
        counts = done.bound.select(L(1).alias("bound"), L(0).alias("rejected")).unionByName(done.rejects.select(L(0).alias("bound"), L(1).alias("rejected")))
        row = counts.agg(F.count(L(1)).alias("n_read"), F.coalesce(F.sum("bound"), L(0)).alias("bound"), F.coalesce(F.sum("rejected"), L(0)).alias("rejected"))
        row = row.select(L(name).alias("load"), "*", L(done.read).cast("long").alias("observed"))
        out = row if out is None else out.unionByName(row)
    return out


@over_tables("stream_report_files", "SELECT 'r' || n || '.xml' AS name, count(*) AS times FROM (SELECT unnest([1, 2]) AS run, n_nationkey AS n FROM nation) WHERE n % 2 = 0 OR run = 2 GROUP BY n HAVING count(*) > 0")
def stream_report_files(t: Tables) -> DataFrame:
    """Report files found in two runs over a folder that grows; how often the second run's folder holds each name, joined to the one row that the runs added for it."""
    root, table = (sinks.shared_path(t.spark, name) for name in ("reports", "seen"))
    nations = t.raw("nation").select("n_nationkey", F.format_string("r%d.xml", "n_nationkey").alias("name"))
    for run in (1, 2):
        rows = nations.where((C("n_nationkey") % 2 == 0) | L(run == 2)).select(F.concat(L(f"run{run}/"), "name").alias("path"), L("<coverage/>").alias("content"))
        sinks.write_files(rows, root)
        ingest.report_files(t.spark, root, table, f"{table}-offsets", "*.xml").awaitTermination()
    held = P.list_files(t.spark, root, "*.xml").select(F.substring_index("path", "/", -1).alias("name")).groupBy("name").agg(F.count(L(1)).alias("times"))
    return t.spark.read.schema("name string, path string").parquet(table).join(held, "name").select("name", "times")
