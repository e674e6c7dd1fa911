"""The scanner and the smell rules, each found once and not found once."""

import pytest

from assay.functions.csharp import scan_body
from assay.functions.smells import detect
from assay.sources.adapters import SMELLS


def test_statements_and_calls():
    b = scan_body(
        """{
        var x = new Calc(1, "a;b"); // c;
        int? y = 3;
        List<Dictionary<string, int>> z = Make<int>(x);
        x.Add(1).Times(2);
        await Assert.ThrowsAsync<Err>(() => { Foo(); });
        if (a) Bar(1, F(2, 3)); else { Baz(); }
        foreach (var q in z) { q.Go(); }
        do { Step(); } while (x.Ok());
        return;
    }"""
    )
    assert b.statements == 9 and b.locals == 3 and b.branches == 3
    assert b.expressions == ["x.Add(1).Times(2);", "await Assert.ThrowsAsync<Err>(() => { Foo(); });", "Bar(1, F(2, 3));", "Baz();", "q.Go();", "Step();"]
    assert b.invocations == [("x.Add(1).Times", ["2"]), ("Bar", ["1", "F(2, 3)"]), ("Baz", []), ("q.Go", []), ("Step", [])]
    assert sorted(b.callees) == sorted(["Make<int>", "x.Add", "x.Add(1).Times", "Assert.ThrowsAsync<Err>", "Foo", "Bar", "F", "Baz", "q.Go", "Step", "x.Ok"])


def test_local_functions_strings_and_switches():
    b = scan_body('{ int Twice(int v) { return v * 2; } string s = $"if ({Twice(2)}) x;"; var r = s switch { "a" => 1, _ => 2 }; switch (r) { case 1: Go(); break; default: break; } }')
    assert b.locals == 2 and b.branches == 1 and b.expressions == ["Go();"] and b.callees == ["Go"]
    assert scan_body("{ }").statements == 0 and scan_body("").statements == 0 and scan_body(None).statements == 0
    assert scan_body("{ Foo(").callees == ["Foo"]


FOUND = {
    "EmptyTestSmell": ("{ }", ["Fact"]),
    "ConditionalTestSmell": ("{ if (a) { Assert.True(b); } }", ["Fact"]),
    "CyclomaticComplexityTestSmell": ("{ " + "if (a) { F(); } " * 10 + "}", ["Fact"]),
    "ExpectedExceptionTestSmell": ("{ F(); }", ["Fact", "ExpectedException"]),
    "AssertionRouletteTestSmell": ("{ Assert.True(a); Assert.True(b); Assert.Null(c); }", ["Fact"]),
    "UnknownTestSmell": ("{ F(); }", ["Fact"]),
    "RedundantPrintTestSmell": ("{ Console.WriteLine(1); }", ["Fact"]),
    "SleepyTestSmell": ("{ Thread.Sleep(10); }", ["Fact"]),
    "IgnoreTestSmell": ("{ F(); }", ['Fact(Skip = "later")']),
    "RedundantAssertionTestSmell": ("{ Assert.Same(x, x); }", ["Fact"]),
    "DuplicateAssertionTestSmell": ("{ Foo.Go(); Foo.Go(); }", ["Fact"]),
    "MagicNumberTestSmell": ("{ Assert.Equal(5, x); }", ["Fact"]),
    "EagerTestSmell": ("{ a.One(); a.Two(); }", ["Fact"]),
    "BoolInAssertEqualSmell": ("{ Assert.Equal(true, x); }", ["Fact"]),
    "EqualInAssertSmell": ("{ Assert.True(x == y); }", ["Fact"]),
    "SensitiveEqualitySmell": ("{ Assert.Same(x.ToString(), y); }", ["Fact"]),
    "ConstructorInitializationTestSmell": ("{ class A { public A() { } } }", ["Fact"]),
    "ObscureInLineSetUpSmell": ("{ " + " ".join(f"var v{i} = {i};" for i in range(11)) + " }", ["Fact"]),
}
CLEAN = "{ var made = Make(); Assert.Same(made, other); }"


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("T", name, body, attributes) for name, (body, attributes) in FOUND.items()]
    rows += [("T", "clean", CLEAN, ["fact"]), ("T", "arrow", None, ["Fact"]), ("T", "checks", "{ Assert.True(a); }", []), ("T", "viaHelper", "{ checks(); }", ["Fact"]), ("T", "single", "{ Assert.Equal(x); }", ["Fact"])]
    df = spark.createDataFrame(rows, "class string, name string, body string, attributes array<string>")
    return {(r.method, r.smell): r.status for r in detect(df).collect()}


@pytest.mark.parametrize("smell", SMELLS)
def test_each_smell(judged, smell):
    assert judged[smell, smell] == "Found"
    assert judged["clean", smell] == "Not Found"


def test_helpers_and_safety(judged):
    assert judged["viaHelper", "UnknownTestSmell"] == "Not Found"  # its helper asserts
    assert judged["single", "BoolInAssertEqualSmell"] == "Not Found"  # one argument is no failure
    assert not [k for k in judged if k[0] in ("arrow", "checks")]


def test_a_small_file_is_parsed_by_many_tasks_and_once(spark, tmp_path):
    """A table that Spark reads as one split holds work by the row; classes and members take one parse of a file."""
    from assay.functions import csharp_file as P
    from assay.plans import scan_queries, source_queries
    from assay.sources.adapters import Tables

    spark.range(12_000).selectExpr("id p_partkey", "cast(id % 50 as int) p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    sources = source_queries._sources(t)
    assert sources.rdd.getNumPartitions() == 3 and scan_queries._bodies(t).rdd.getNumPartitions() == 3
    parsed = P.parse_files(sources)
    for rows in (P.classes_of(parsed), source_queries.extract_members(t)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_class_is_a_test_by_its_own_methods(spark):
    from assay.functions import csharp_file as P

    code = "using Xunit; class A { [Fact] void T() { } } class B { void M() { } class In { [Theory] void U() { } } }"
    got = P.classes_of(P.parse_files(spark.createDataFrame([("f", code)], "path string, content string")))
    assert {(r["class"], r.is_test_class) for r in got.collect()} == {("A", True), ("B", False), ("In", True)}
