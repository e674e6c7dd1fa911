"""Parsers over small documents, and the writes."""

import os

import pytest

from assay.sources import reports as P
from assay.sources import sinks

SF = "/root/testdata/sf0.001"


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_trx(spark):
    x = """<?xml version="1.0"?><TestRun xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010"><Results>
      <UnitTestResult testName="A.B.Ok" outcome="Passed" duration="00:00:01.5" />
      <UnitTestResult testName="A.B.Theory(x: 1.5)" outcome="Failed"><Output><ErrorInfo><Message>a &lt; b</Message></ErrorInfo></Output></UnitTestResult>
    </Results></TestRun>"""
    got = rows(P.trx(files(spark, x, "", "<nothing/>")), "test_name", "outcome", "duration", "error_message")
    assert got == [("A.B.Ok", "Passed", "00:00:01.5", None), ("A.B.Theory(x: 1.5)", "Failed", "00:00:00", "a < b")]


def test_a_broken_result_costs_only_itself(spark):
    x = '<R><UnitTestResult testName=" a " outcome="Passed"/><UnitTestResult testName="b" outcome=></UnitTestResult><UnitTestResult testName="c"><Output><ErrorInfo><Message> m </Message></ErrorInfo></Output></UnitTestResult></R>'
    got = P.trx(files(spark, x))
    assert rows(got, "test_name", "outcome", "duration", "error_message") == [(" a ", "Passed", "00:00:00", None), ("c", "", "00:00:00", " m ")]


def test_cobertura(spark):
    m = lambda n, c: f'<method name="{n}" signature="()" line-rate="0.5" branch-rate="1" complexity="{c}"><lines/></method>'
    c = lambda n, ms: f'<class name="{n}" filename="{n}.cs" line-rate="0.5" branch-rate="0" complexity="3"><methods>{ms}</methods></class>'
    x = f"""<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "x.dtd"><coverage line-rate="0.75" branch-rate="0.5" lines-covered="3" lines-valid="4" branches-covered="1" branches-valid="2" complexity="NaN-ish" timestamp="17">
      <packages><package name="P" line-rate="1" branch-rate="1" complexity="1"><classes>{c("A", m("Do", "2") + m("Do", "x"))}{c("B", m("widget", "1"))}</classes></package>
      <package name="Q" line-rate="0" branch-rate="0" complexity="0"><classes>{c("C", "")}</classes></package></packages></coverage>"""
    got = P.cobertura(files(spark, x))
    assert rows(got["reports"], "line_rate", "lines_valid", "complexity", "timestamp") == [(0.75, 4, 0.0, 17)]
    assert rows(got["packages"], "name", "line_rate") == [("P", 1.0), ("Q", 0.0)]
    assert rows(got["classes"], "package", "name") == [("P", "A"), ("P", "B"), ("Q", "C")]
    assert rows(got["methods"], "class", "name", "complexity") == [("A", "Do", 0.0), ("A", "Do", 2.0), ("B", "widget", 1.0)]


def test_mutation(spark):
    x = """{"schemaVersion":"1","projectRoot":"/r","files":{"a.cs":{"language":"cs","source":"","mutants":[
      {"id":"1","mutatorName":"m","replacement":"x","location":{"start":{"line":3,"column":1},"end":{"line":3,"column":9}},"status":"Killed","static":false,"coveredBy":["t1","nope"],"killedBy":["t1"]},
      {"id":"2","mutatorName":"m","replacement":"y","location":{"start":{"line":4,"column":1},"end":{"line":4,"column":2}},"status":"Ignored","static":true,"coveredBy":null}]},
      "empty.cs":{"language":"cs","source":"","mutants":[]}},
      "testFiles":{"T":{"tests":[{"id":"t1","name":"A.T1"},{"id":"t1","name":"B.T1"}]}}}"""
    got = P.mutation(files(spark, x, "not json"))
    assert rows(got["files"], "file", "n_mutants") == [("a.cs", 2), ("empty.cs", 0)]
    assert rows(got["mutants"], "mutant_id", "start_line", "status", "static") == [("1", 3, "Killed", False), ("2", 4, "Ignored", True)]
    assert rows(got["coverage"], "mutant_id", "test_name", "interaction_type") == [("1", "A.T1", "CoveredBy"), ("1", "A.T1", "KilledBy")]


def test_lizard(spark):
    item = lambda n, *v: f'<item name="{n}">{"".join(f"<value>{x}</value>" for x in v)}</item>'
    x = f"""<cppncss><measure type="Function"><labels/>{item("A::look at me( int a ) at C:/x/a.cs:14", 1, 5, 2)}{item("short at a.cs:2", 1, 2)}{item("no place", 1, 2, 3)}</measure>
      <measure type="File">{item("a.cs", 1, 20, 7, 3)}{item("b.cs", 1, 2, 3)}</measure></cppncss>"""
    assert rows(P.lizard_functions(files(spark, x)), "function", "file", "line", "ncss", "ccn") == [("A::look at me( int a )", "C:/x/a.cs", 14, 5, 2)]
    assert rows(P.lizard_files(files(spark, x)), "file", "ncss", "ccn", "function_count") == [("a.cs", 20, 7, 3)]


def test_smell_json_round_trip(spark):
    x = '[{"name":"C","Message":"","METHODS":[{"Name":"m","Body":"{}","Smells":[{"Name":"Empty Test","Status":"Found"},{"Name":"Empty Test","Status":"Not Found"},{"NAME":"Eager Test","status":"Not Found"}]}]}]'
    got = P.smell_json(files(spark, x))
    assert rows(got, "class", "method", "smell", "status") == [("C", "m", "Eager Test", "Not Found"), ("C", "m", "Empty Test", "Found")]
    tree = sinks.smell_report(got).first().report
    assert rows(P.smell_json(files(spark, f"[{tree}]")), "smell", "status") == [("Eager Test", "Not Found"), ("Empty Test", "Found")]


def test_projects_and_files(spark):
    one, many, none = "<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>", "<Project><TargetFrameworks>net6.0;net7.0</TargetFrameworks></Project>", "<Project/>"
    projects = files(spark, one, many, none)
    assert [r[1] for r in sorted(P.target_frameworks(projects).collect())] == ["net8.0", "net6.0", ""]
    sdk = P.global_sdk(files(spark, "{}", '{"sdk":{"version":"9.0.1"}}'))
    assert {r[1] for r in P.target_frameworks(projects, sdk).collect()} == {"9.0.1"}
    lines = spark.createDataFrame([("https://host.example/own/rep.git",), ("",), ("- out/side/src/A/A.csproj",)], "value string")
    assert rows(P.targets(lines.limit(1)), "owner", "repo") == [("own", "rep.git")]
    names = spark.createDataFrame([("src/A/A.csproj",), ("a/B.cs",), ("a/B.g.cs",), ("AssemblyInfo.cs",), ("x/Rep_Docker_1.log",)], "path string")
    assert rows(P.project_references(lines, names), "path") == [("src/A/A.csproj",)]
    assert rows(P.source_files(names), "path") == [("a/B.cs",)]
    assert rows(P.logs_of(names, "rep"), "path") == [("x/Rep_Docker_1.log",)]
    tree = spark.createDataFrame([("r", "src/Tests/a.cs"), ("s", "a.cs")], "repo string, path string")
    assert rows(P.likely_tested(tree), "repo", "has_tests") == [("r", True), ("s", False)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, True), ("r2", 2, False)], "repo_id string, x int, has_tests boolean")
    for _ in range(2):
        sinks.append(df, f"{tmp_path}/t")
        sinks.split_by(df, f"{tmp_path}/s")
    sinks.append_csv(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4 and spark.read.parquet(f"{tmp_path}/s").where("has_tests = 'true'").count() == 2
    sinks.append_csv(df.repartition(2), f"{tmp_path}/c")
    assert [r.value for r in spark.read.text(f"{tmp_path}/c/header").collect()] == ["repo_id,x,has_tests"]
    assert sorted(map(tuple, sinks.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == sorted(2 * list(map(tuple, df.collect())))
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "a.sln").write_text("é")
    assert [r.content for r in P.read_files(spark, f"{tmp_path}/src", "*.sln").collect()] == ["é"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_csv_reports_are_written(spark, monkeypatch):
    from assay.plans import registry

    written, append_csv = [], sinks.append_csv
    monkeypatch.setattr(sinks, "append_csv", lambda df, path: (written.append(path), append_csv(df, path)))
    q = registry.queries()
    got = {name: q[name](spark, SF) for name in ("csv_validation", "csv_windows")}
    assert got["csv_validation"].columns == ["URL", "Owner", "Repo", "HasXUnit", "HasCoverage", "HasPassingTests", "HasCandidateMethods", "HasMutationReports", "HasFileCodeMetrics", "HasFunctionCodeMetrics"]
    assert sorted(map(tuple, got["csv_validation"].collect())) == sorted(map(tuple, q["repo_validation_row"](spark, SF).drop("repo_id").collect()))
    assert sorted(r.ProjectName for r in got["csv_windows"].collect()) == sorted(r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().collect() if r.source)
    assert len(written) == 4 and len(set(written)) == 2


def test_cobertura_in_splits_is_what_the_whole_document_gives(spark, tmp_path):
    """Splits that begin inside a class or a package, prefixes, `>` in names, a broken tag, a report that goes on in a second file."""
    from pyspark.sql import functions as F

    from assay.sources import elements as E

    m = lambda n: f'<method name="{n}" signature="(a&lt;b>)" line-rate="0.5" branch-rate="1" complexity="2"><lines><line number="1" hits="2"/></lines></method>\n'
    c = lambda n, k: f'<x:class name="{n}" filename="{n}.cs" line-rate="0.5" branch-rate="0" complexity="x"><methods>{"".join(m(f"{n}.M{i}") for i in range(k))}</methods></x:class>'
    p = lambda n, *cs: f'<package name="{n}" line-rate="1" branch-rate="1" complexity="1"><classes>{"".join(cs)}</classes></package>'
    head = '<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "c.dtd"><coverage xmlns:x="http://x" line-rate="0.75" branch-rate="0.5" lines-covered="3" lines-valid="4" branches-covered="1" branches-valid="2" complexity="NaN-ish" timestamp="17"><packages>'
    whole = head + p("P", c("A", 200), c("B", 1)) + p("Q", c("C", 0), c("D", 300)) + "</packages></coverage>"
    (tmp_path / "r").mkdir()
    cut = whole.index('<method name="D.M150"')
    (tmp_path / "r" / "one-0.xml").write_text(whole[:cut])
    (tmp_path / "r" / "one-1.xml").write_text(whole[cut:])
    (tmp_path / "r" / "two-0.xml").write_text(whole.replace('name="D.M299"', 'name="D.M299" name="twice"'))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = E.cobertura(spark, str(tmp_path / "r"), report=F.substring_index("file", "-", 1))
        want = P.cobertura(files(spark, whole))
        names = ("package", "class", "name", "signature", "line_rate", "branch_rate", "complexity")
        assert rows(got["methods"].where("path = 'one'"), *names) == rows(want["methods"], *names)
        assert got["methods"].where("path = 'two'").count() == 500 and got["rejects"].select("path").collect() == [("two",)]
        counts = ("line_rate", "complexity", "lines_covered", "branches_valid", "timestamp")
        assert rows(got["reports"], *counts) == rows(want["reports"], *counts) * 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_report_of_a_scan_is_one_value(spark):
    from assay.plans import scan_queries as Q
    from assay.sources.adapters import Tables

    lines = spark.read.text(Q._coverage_folder(Tables(spark, SF)))
    assert lines.selectExpr("max(length(value))").first()[0] < 400 and lines.count() > 1500
