"""Queries for the report parsers: reports are written as text from the tables, read back by the parsers, and compared with the tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.functions.smells import detect
from assay.plans.operator_queries import _LOG, over_tables
from assay.sources import elements as E
from assay.sources import reports as P
from assay.sources import sinks
from assay.sources.adapters import SMELLS, Tables

C, L = F.col, F.lit


def _tag(text: str, *values: Column | str) -> Column:
    return F.format_string(text, *values)


def _files(rows: DataFrame, path: Column, item: Column, before: str, after: str) -> DataFrame:
    """One document for each path, with its items in any order."""
    return rows.groupBy(path.cast("string").alias("path")).agg(F.concat(L(before), F.array_join(F.collect_list(item), ""), L(after)).alias("content"))


@over_tables("scan_trx", "SELECT user_id::VARCHAR AS path, 'Suite.T' || event_id AS test_name, event_type AS outcome, CASE WHEN event_id % 3 = 0 THEN '00:00:00' ELSE '00:00:0' || event_id % 7 END AS duration, CASE WHEN event_type = 'error' THEN 'user ' || user_id || ' < & failed' END AS error_message FROM events")
def scan_trx(t: Tables) -> DataFrame:
    duration = F.when(C("event_id") % 3 == 0, L("")).otherwise(_tag(' duration="00:00:0%d"', C("event_id") % 7))
    error = F.when(C("event_type") == "error", _tag("<Output><ErrorInfo><Message>user %d &lt; &amp; failed</Message></ErrorInfo></Output>", C("user_id"))).otherwise("")
    item = F.concat(_tag('<UnitTestResult testName="Suite.T%d" outcome="%s"', C("event_id"), C("event_type")), duration, L(">"), error, L("</UnitTestResult>"))
    return P.trx(_files(t.raw("events"), C("user_id"), item, '<?xml version="1.0"?><TestRun xmlns="http://x/y"><Results>', "</Results></TestRun>"))


def _coverage_folder(t: Tables) -> str:
    """A folder ``report=<test run>`` for each report, its text in files that go on in the order of their names. Each tag is a row and rows are sorted over all tasks, so that no report is one value."""
    rate = lambda line, branch, comp: F.concat(L('line-rate="'), line.cast("string"), L('" branch-rate="'), branch.cast("string"), L('" complexity="'), comp.cast("string"), L('"'))
    place = ("at", "package", "in_package", "class", "in_class", "method")
    at = lambda *ids: [i.alias(n) for i, n in zip([*ids, *[L(0).cast("long")] * (len(place) - len(ids))], place)]
    n = lambda k: L(k).cast("long")
    reports = t.coverage_reports.withColumnRenamed("test_run_id", "report")
    head = F.concat(L('<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "c.dtd"><coverage '), rate(C("line_rate"), C("branch_rate"), C("complexity")), _tag(' lines-covered="%d" lines-valid="%d" branches-covered="%d" branches-valid="%d" timestamp="%d"><packages>', C("lines_covered"), C("lines_valid"), C("branches_covered"), C("branches_valid"), C("timestamp")))
    packages = t.package_coverage.selectExpr("id package", "name", "coverage_report_id id").join(reports.select("id", "report"), "id")
    classes = t.class_coverage.selectExpr("id class", "name", "package_coverage_id package").join(packages.select("package", "report"), "package")
    methods = t.method_coverage.withColumnRenamed("class_coverage_id", "class").join(classes.select("class", "package", "report"), "class")
    class_tag = _tag('<class name="%s" filename="%s.cs" line-rate="0" branch-rate="0" complexity="x"><methods>', C("name"), C("name"))
    method_tag = F.concat(_tag('<method name="M%d" signature="()" ', C("method_id")), rate(C("line_rate"), C("branch_rate"), C("complexity")), L("/>"))
    parts = [
        reports.select("report", *at(n(0)), head.alias("value")),
        reports.select("report", *at(n(2)), L("</packages></coverage>").alias("value")),
        packages.select("report", *at(n(1), C("package")), _tag('<package name="%s" line-rate="1" branch-rate="1" complexity="0"><classes>', C("name")).alias("value")),
        packages.select("report", *at(n(1), C("package"), n(2)), L("</classes></package>").alias("value")),
        classes.select("report", *at(n(1), C("package"), n(1), C("class")), class_tag.alias("value")),
        classes.select("report", *at(n(1), C("package"), n(1), C("class"), n(2)), L("</methods></class>").alias("value")),
        methods.select("report", *at(n(1), C("package"), n(1), C("class"), n(1), C("id")), method_tag.alias("value")),
    ]
    root = sinks.shared_path(t.spark, "cobertura")
    rows = reduce(DataFrame.unionByName, parts)
    rows.repartitionByRange("report", *place).sortWithinPartitions("report", *place).select("report", "value").write.partitionBy("report").text(root)
    return root


def _cobertura(t: Tables) -> dict[str, DataFrame]:
    name = F.regexp_extract("file", r"report=([^/]+)/", 1)
    return E.cobertura(t.spark, _coverage_folder(t), report=F.url_decode(F.replace(name, L("+"), L("%2B"))))


@over_tables("scan_cobertura", "SELECT r.test_run_id AS path, p.name AS package, c.name AS class, 'M' || m.method_id AS name, '()' AS signature, m.line_rate, m.branch_rate, m.complexity FROM coverage_reports r JOIN package_coverage p ON p.coverage_report_id = r.id JOIN class_coverage c ON c.package_coverage_id = p.id JOIN method_coverage m ON m.class_coverage_id = c.id")
def scan_cobertura(t: Tables) -> DataFrame:
    return _cobertura(t)["methods"]


@over_tables("scan_cobertura_reports", "SELECT test_run_id AS path, line_rate, branch_rate, complexity, lines_covered, lines_valid, branches_covered, branches_valid, timestamp FROM coverage_reports")
def scan_cobertura_reports(t: Tables) -> DataFrame:
    return _cobertura(t)["reports"]


def _mutation_files(t: Tables) -> DataFrame:
    rows = t.mutants.join(t.lines.select("id", "pk"), "id")
    point = F.struct(C("start_line").cast("int").alias("line"), L(1).alias("column"))
    mutant = F.struct(C("id").cast("string").alias("id"), L("m").alias("mutatorName"), L("x").alias("replacement"), F.struct(point.alias("start"), point.alias("end")).alias("location"), "status", "static", F.array(C("pk").cast("string"), L("unknown")).alias("coveredBy"), F.when(C("status") == "Killed", F.array(C("pk").cast("string"))).alias("killedBy"))
    per_file = rows.groupBy("source_file_id").agg(F.collect_list(mutant).alias("mutants"), F.collect_set("pk").alias("tests"))
    files = F.create_map(_tag("F%d.cs", C("source_file_id")), F.struct(L("cs").alias("language"), L("").alias("source"), "mutants"))
    tests = F.create_map(L("T"), F.struct(F.transform("tests", lambda k: F.struct(k.cast("string").alias("id"), F.concat(L("Suite.P"), k.cast("string")).alias("name"))).alias("tests")))
    return per_file.select(C("source_file_id").cast("string").alias("path"), F.to_json(F.struct(L("1").alias("schemaVersion"), files.alias("files"), tests.alias("testFiles"))).alias("content"))


@over_tables("scan_mutation", "SELECT source_file_id::VARCHAR AS path, 'F' || source_file_id || '.cs' AS file, id::VARCHAR AS mutant_id, start_line::INT AS start_line, status, static FROM mutants")
def scan_mutation(t: Tables) -> DataFrame:
    return P.mutation(_mutation_files(t))["mutants"].select("path", "file", "mutant_id", "start_line", "status", "static")


@over_tables("mutant_test_map", "SELECT m.source_file_id::VARCHAR AS path, 'F' || m.source_file_id || '.cs' AS file, m.id::VARCHAR AS mutant_id, 'Suite.P' || l.pk AS test_name, unnest(CASE WHEN m.status = 'Killed' THEN ['CoveredBy', 'KilledBy'] ELSE ['CoveredBy'] END) AS interaction_type FROM mutants m JOIN li l ON l.id = m.id")
def mutant_test_map(t: Tables) -> DataFrame:
    return P.mutation(_mutation_files(t))["coverage"]


@over_tables("scan_lizard_functions", "SELECT p_brand AS path, p_name || ' at once( int a )' AS function, 'C:/src/' || p_partkey || '.cs' AS file, p_size AS line, (p_size % 12)::INT AS ncss, (p_partkey % 5)::INT AS ccn FROM part WHERE p_size % 10 > 0")
def scan_lizard_functions(t: Tables) -> DataFrame:
    """Items with a size divisible by ten have two values only and are skipped."""
    values = F.when(C("p_size") % 10 > 0, _tag("<value>1</value><value>%d</value><value>%d</value>", C("p_size") % 12, C("p_partkey") % 5)).otherwise("<value>1</value><value>2</value>")
    item = F.concat(_tag('<item name="%s at once( int a ) at C:/src/%d.cs:%d">', C("p_name"), C("p_partkey"), C("p_size")), values, L("</item>"))
    return P.lizard_functions(_files(t.raw("part"), C("p_brand"), item, '<?xml version="1.0"?><cppncss><measure type="Function">', '</measure><measure type="Function"><item name="x at y:1"><value>1</value><value>1</value><value>1</value></item></measure></cppncss>'))


@over_tables("scan_lizard_files", "SELECT s_nationkey::VARCHAR AS path, s_name AS file, (s_suppkey % 100)::INT AS ncss, (s_suppkey % 9)::INT AS ccn, (s_suppkey % 7)::INT AS function_count FROM supplier")
def scan_lizard_files(t: Tables) -> DataFrame:
    item = _tag('<item name="%s"><value>1</value><value>%d</value><value>%d</value><value>%d</value></item>', C("s_name"), C("s_suppkey") % 100, C("s_suppkey") % 9, C("s_suppkey") % 7)
    return P.lizard_files(_files(t.raw("supplier"), C("s_nationkey"), item, '<cppncss><measure type="File">', "</measure></cppncss>"))


_NAMED = "SELECT 'C' || m.class_id AS class, 'M' || x.method_id AS method, s.name AS smell, x.status FROM method_test_smells x JOIN test_smells s ON s.id = x.test_smell_id JOIN methods m ON m.id = x.method_id"


def _named_smells(t: Tables) -> DataFrame:
    rows = t.method_test_smells.join(t.test_smells.withColumnRenamed("id", "test_smell_id"), "test_smell_id").join(t.methods.selectExpr("id method_id", "class_id"), "method_id")
    return rows.select(_tag("C%d", C("class_id")).alias("class"), _tag("M%d", C("method_id")).alias("method"), C("name").alias("smell"), "status")


@over_tables("scan_smell_json", f"SELECT class AS path, * FROM ({_NAMED})")
def scan_smell_json(t: Tables) -> DataFrame:
    """The smell report written as JSON trees and read back."""
    return P.smell_json(sinks.smell_report(_named_smells(t)).select(C("class").alias("path"), F.concat(L("["), "report", L("]")).alias("content")))


@over_tables("json_smell_report", f"SELECT class, count(DISTINCT method) AS methods, count(*) AS smells FROM ({_NAMED}) GROUP BY class")
def json_smell_report(t: Tables) -> DataFrame:
    shape = "Name string, Methods array<struct<Name:string,Smells:array<struct<Name:string,Status:string>>>>"
    rows = sinks.smell_report(_named_smells(t)).select("class", F.from_json("report", shape).alias("r"))
    return rows.select("class", F.size("r.Methods").cast("bigint").alias("methods"), F.aggregate("r.Methods", L(0).cast("bigint"), lambda a, m: a + F.size(m["Smells"])).alias("smells"))


@over_tables("scan_targets", "SELECT 'https://host.example/' || s_suppkey || '/' || s_nationkey AS url, s_suppkey::VARCHAR AS owner, s_nationkey::VARCHAR AS repo FROM supplier")
def scan_targets(t: Tables) -> DataFrame:
    return P.targets(t.raw("supplier").select(_tag(" https://host.example/%d/%d ", C("s_suppkey"), C("s_nationkey")).alias("value")))


@over_tables("scan_global_sdk", "SELECT '8.0.' || min_by(n_nationkey, n_name) AS version FROM nation WHERE n_nationkey % 2 = 1")
def scan_global_sdk(t: Tables) -> DataFrame:
    content = F.when(C("n_nationkey") % 2 == 1, _tag('{"sdk": {"version": "8.0.%d"}}', C("n_nationkey"))).otherwise('{"sdk": {}}')
    return P.global_sdk(t.raw("nation").select(C("n_name").alias("path"), content.alias("content")))


@over_tables("scan_target_framework", "SELECT p_partkey::VARCHAR AS path, CASE p_size % 3 WHEN 0 THEN 'net' || p_size WHEN 1 THEN 'net6.0' ELSE '' END AS target_framework FROM part")
def scan_target_framework(t: Tables) -> DataFrame:
    body = F.when(C("p_size") % 3 == 0, _tag("<TargetFramework>net%d</TargetFramework>", C("p_size"))).when(C("p_size") % 3 == 1, "<TargetFrameworks>net6.0;net8.0</TargetFrameworks>").otherwise("")
    return P.target_frameworks(t.raw("part").select(C("p_partkey").cast("string").alias("path"), F.concat(L("<Project><PropertyGroup>"), body, L("</PropertyGroup></Project>")).alias("content")))


@over_tables("scan_project_refs", "SELECT DISTINCT 'src/P' || p_size || '.csproj' AS path FROM part WHERE p_size % 2 = 0")
def scan_project_refs(t: Tables) -> DataFrame:
    there = t.raw("part").where("p_size % 2 = 0").select(_tag("src/P%d.csproj", C("p_size")).alias("path"))
    return P.project_references(t.raw("part").select(_tag("  - out/side\\src/P%d.csproj", C("p_size")).alias("value")), there)


# --- files: each nation is a repository with a solution, sources and a log, written to the shared folder and found there

_MESSAGE = "code COVERAGE is currently supported only on Windows."
_ENDS = (".sln", ".cs", ".g.cs", "AssemblyInfo.cs", "Test.cs", "x.AssemblyAttributes.cs")
#: Every file of every repository: its name by a number from 0 to 6, of which the last is a log, and its text.
_TREE = f"""
  SELECT n_nationkey AS k, i, 'r' || n_nationkey AS repo,
    CASE WHEN i = 6 THEN 'logs/R' || n_nationkey || (CASE WHEN n_nationkey % 3 = 0 THEN '_build' ELSE '_DOCKER' END) || '.log'
         ELSE 'r' || n_nationkey || (CASE WHEN i = 0 THEN '/' ELSE '/src/' END) || 'F' || n_nationkey || [{', '.join(f"'{e}'" for e in _ENDS)}][i + 1] END AS path,
    CASE WHEN i < 6 THEN 'using System; namespace ' || n_name || i || ';' WHEN n_nationkey % 4 = 1 THEN '{_MESSAGE}' ELSE 'done' END AS content
  FROM nation, (SELECT unnest(range(7)) AS i) WHERE i <> 4 OR n_nationkey % 2 = 0
"""


def _tree(t: Tables) -> str:
    """The folder with the files of ``_TREE``; odd nations have no test."""
    k, i = C("n_nationkey").cast("string"), C("i")
    rows = t.raw("nation").select("n_nationkey", "n_name", F.explode(F.sequence(L(0), L(6))).alias("i")).where((i != 4) | (C("n_nationkey") % 2 == 0))
    source = F.concat(L("r"), k, F.when(i == 0, "/").otherwise("/src/"), L("F"), k, F.get(F.array(*map(L, _ENDS)), i))
    log = F.concat(L("logs/R"), k, F.when(C("n_nationkey") % 3 == 0, "_build").otherwise("_DOCKER"), L(".log"))
    text = F.when(i < 6, F.concat(L("using System; namespace "), "n_name", i.cast("string"), L(";"))).when(C("n_nationkey") % 4 == 1, _MESSAGE).otherwise("done")
    root = sinks.shared_path(t.spark, "tree")
    sinks.write_files(rows.select(F.when(i == 6, log).otherwise(source).alias("path"), text.alias("content")), root)
    return root


def _found(t: Tables, glob: str) -> DataFrame:
    root = _tree(t)
    files = P.read_files(t.spark, root, glob).withColumn("path", P.below(C("path"), root))
    return files.select(F.split("path", "/")[0].alias("repo"), "path", "content")


@over_tables("scan_source_files", f"SELECT repo, path, content FROM ({_TREE}) WHERE i IN (1, 4)")
def scan_source_files(t: Tables) -> DataFrame:
    return P.source_files(_found(t, "*.cs"))


@over_tables("scan_solutions", f"SELECT repo, path FROM ({_TREE}) WHERE i = 0")
def scan_solutions(t: Tables) -> DataFrame:
    return P.list_files(t.spark, _tree(t), "*.sln").select(F.split("path", "/")[0].alias("repo"), "path")


@over_tables("scan_repo_tree", f"SELECT repo, bool_or(path ILIKE '%test%') AS has_tests FROM ({_TREE}) WHERE i < 6 GROUP BY repo")
def scan_repo_tree(t: Tables) -> DataFrame:
    return P.likely_tested(P.list_files(t.spark, _tree(t), "*.{sln,cs}").select(F.split("path", "/")[0].alias("repo"), "path"))


@over_tables("scan_logs", f"SELECT path, content ILIKE '%{_MESSAGE}%' AS windows_only FROM ({_TREE}) WHERE i = 6 AND path ILIKE '%docker%' AND path ILIKE '%r1%'")
def scan_logs(t: Tables) -> DataFrame:
    """Of the logs of r1, r10, r11, …: which hold the message."""
    return P.logs_of(_found(t, "*.log"), "r1").select("path", S.windows_only(C("content")).alias("windows_only"))


@over_tables("csv_windows", f'SELECT source AS "ProjectName", bool_or(({_LOG}) ILIKE \'%Code coverage is currently supported only on Windows.%\') IS TRUE AS "WindowsOnly" FROM documents WHERE source IS NOT NULL GROUP BY source')
def csv_windows(t: Tables) -> DataFrame:
    """A row for each project whose logs were searched, appended to a CSV report in two goes and read back."""
    log = t.raw("documents").where("source is not null").select(C("source").alias("ProjectName"), F.expr(_LOG).alias("content"))
    found = log.groupBy("ProjectName").agg(F.coalesce(F.bool_or(S.windows_only(C("content"))), L(False)).alias("WindowsOnly"))
    path = sinks.shared_path(t.spark, "csv-windows")
    for k in (0, 1):
        sinks.append_csv(found.where(F.pmod(F.crc32("ProjectName"), L(2)) == k), path)
    return sinks.read_csv(t.spark, path, found.schema)


# --- smells: bodies made so that a part's number says which rules they break

_LINES = (
    ("if (a) {{ F(); }}", 2), ("Assert.Same(x, x);", 3), ("Console.WriteLine(1);", 5), ("Thread.Sleep(1);", 7), ("Assert.Equal(7, y{0});", 11), ("Assert.True(a{0} == b);", 13), ("Assert.Equal(true, z{0});", 17), ("o.One(); o.Two();", 19),
    ("if (c) {{ }} " * 10, 29), ("Twice(); Twice();", 37), ("Assert.Equal(s, t.ToString());", 41), (" ".join(f"var v{i} = w;" for i in range(11)), 43),
    ("class Inner {{ public Inner() {{ }} }}", 47),
)


def _bodies(t: Tables) -> DataFrame:
    k = C("p_partkey")
    lines = [F.when(k % n == 0, line.format("").replace("{{", "{").replace("}}", "}")).otherwise("") for line, n in _LINES]
    return t.spread("part", "p_partkey").select(_tag("C%d", k).alias("class"), _tag("M%d", k).alias("name"), F.concat(L("{ "), F.concat_ws(" ", *lines), L(" }")).alias("body"), F.array(L("Fact"), F.when(k % 23 == 0, "Skip").otherwise("Trait"), F.when(k % 31 == 0, "ExpectedException").otherwise("Trait")).alias("attributes"))


_D = lambda n: f"(p_partkey % {n} = 0)"
_ANY = " OR ".join(_D(n) for _, n in _LINES)
_ASSERTS = f"({' + '.join(_D(n) + '::INT' for n in (3, 11, 13, 17, 41))})"
_RULES = {
    "EmptyTestSmell": f"NOT ({_ANY})", "ConditionalTestSmell": f"{_D(2)} OR {_D(29)}", "CyclomaticComplexityTestSmell": _D(29), "ExpectedExceptionTestSmell": _D(31), "AssertionRouletteTestSmell": f"{_ASSERTS} > 2", "UnknownTestSmell": f"{_ASSERTS} = 0", "RedundantPrintTestSmell": _D(5), "SleepyTestSmell": _D(7),
    "IgnoreTestSmell": _D(23), "RedundantAssertionTestSmell": _D(3), "DuplicateAssertionTestSmell": _D(37), "MagicNumberTestSmell": _D(11), "EagerTestSmell": _D(19), "BoolInAssertEqualSmell": _D(17), "EqualInAssertSmell": _D(13), "SensitiveEqualitySmell": _D(41), "ConstructorInitializationTestSmell": _D(47), "ObscureInLineSetUpSmell": _D(43),
}
_EXPECTED = " UNION ALL ".join(f"SELECT 'C' || p_partkey AS class, 'M' || p_partkey AS method, '{n}' AS smell, CASE WHEN {r} THEN 'Found' ELSE 'Not Found' END AS status FROM part" for n, r in _RULES.items())


def _smell_key(name: str) -> str:
    """Keys of the inventory."""
    words = re.sub(r"(TestSmell|Smell)$", "", name)
    own = {"CyclomaticComplexity": "cyclomatic", "BoolInAssertEqual": "bool_in_equal", "ConstructorInitialization": "constructor_init", "ObscureInLineSetUp": "obscure_setup"}
    return "smell_" + own.get(words, re.sub(r"(?<=.)(?=[A-Z])", "_", words).lower())


for _name in SMELLS:
    over_tables(_smell_key(_name), f"SELECT class, method, status FROM ({_EXPECTED}) WHERE smell = '{_name}'")(lambda t, n=_name: detect(_bodies(t), [n]).select("class", "method", "status"))


@over_tables("smell_all", f"SELECT class, method, smell, status FROM ({_EXPECTED})")
def smell_all(t: Tables) -> DataFrame:
    return detect(_bodies(t))


@over_tables("helper_prepass", "SELECT 'V' || p_partkey AS method, CASE WHEN p_partkey % 2 = 0 THEN 'Not Found' ELSE 'Found' END AS status FROM part")
def helper_prepass(t: Tables) -> DataFrame:
    """Tests that only call a helper: unknown unless the helper asserts."""
    k = C("p_partkey")
    helper = t.spread("part", "p_partkey").select(L("C").alias("class"), _tag("H%d", k).alias("name"), F.when(k % 2 == 0, "{ Assert.True(a); }").otherwise("{ F(); }").alias("body"), F.array().cast("array<string>").alias("attributes"))
    test = t.spread("part", "p_partkey").select(L("C").alias("class"), _tag("V%d", k).alias("name"), _tag("{ H%d(); }", k).alias("body"), F.array(L("Fact")).alias("attributes"))
    return detect(helper.unionByName(test), ["UnknownTestSmell"]).select("method", "status")
