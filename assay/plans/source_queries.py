"""Queries for the C# front end: sources are written from the tables, parsed, and compared with the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import csharp_file as P
from assay.plans.operator_queries import over_tables
from assay.sources.adapters import Tables

_CODE = """using System;
using Xunit;
namespace App.N%d;

/// <summary>Class %d</summary>
public sealed class C%d : Base<int>
{
    private readonly List<int> _f = new() { 1, 2 };
    public C%d() { _f.Clear(); }
    /// Checks it.
    [Fact, Trait("k", "v")]
    public async Task T%d()
    {
        Assert.Equal(%d, Make(1));
        _f.ForEach(x => Seen(x));
    }
    internal static int Make(int x) => x;
    public string P { get; set; } = "a;b";
}
"""


def _sources(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.spread("part", "p_partkey", "p_size").select(F.format_string("f%d.cs", k).alias("path"), F.format_string(_CODE, "p_size", k, k, k, k, "p_size").alias("content"))


@over_tables("extract_files", "SELECT 'f' || p_partkey || '.cs' AS path, 'App.N' || p_size AS namespace, 'using System;|using Xunit;' AS usings FROM part")
def extract_files(t: Tables) -> DataFrame:
    return P.parse_files(_sources(t)).select("path", "namespace", F.array_join("usings", "|").alias("usings"))


@over_tables("extract_classes", "SELECT 'f' || p_partkey || '.cs' AS path, 'C' || p_partkey AS class, 'public' AS visibility, 'public sealed' AS modifiers, '<summary>Class ' || p_partkey || '</summary>' AS doc_string, 'xUnit' AS testing_framework, true AS is_test_class, 5 AS start_line, 18 AS end_line FROM part")
def extract_classes(t: Tables) -> DataFrame:
    rows = P.classes_of(P.parse_files(_sources(t)))
    return rows.select("path", "class", "visibility", F.array_join("modifiers", " ").alias("modifiers"), "doc_string", "testing_framework", "is_test_class", "start_line", "end_line")


@over_tables("extract_methods", "SELECT 'f' || p_partkey || '.cs' AS path, 'C' || p_partkey AS class, unnest(['T' || p_partkey, 'Make']) AS name, unnest(['public', 'internal']) AS visibility, unnest(['Fact|Trait(\"k\", \"v\")', '']) AS attributes, unnest(['Checks it.', '']) AS doc_string, unnest(['xUnit', '']) AS testing_framework, unnest([true, false]) AS is_test_method, unnest([10, 16]) AS start_line, unnest([15, 16]) AS end_line FROM part")
def extract_methods(t: Tables) -> DataFrame:
    return P.methods_of(P.parse_files(_sources(t))).select("path", "class", "name", "visibility", F.array_join("attributes", "|").alias("attributes"), "doc_string", "testing_framework", "is_test_method", "start_line", "end_line")


@over_tables("extract_members", "SELECT 'f' || p_partkey || '.cs' AS path, unnest(['field', 'property']) AS kind, unnest(['_f', 'P']) AS name, unnest(['private readonly List<int> _f = new() { 1, 2 };', 'public string P { get; set; } = \"a;b\";']) AS full_string FROM part")
def extract_members(t: Tables) -> DataFrame:
    return P.members_of(P.parse_files(_sources(t))).select("path", "kind", "name", "full_string")


@over_tables("extract_invocations", "SELECT 'f' || p_partkey || '.cs' AS path, 'T' || p_partkey AS method, unnest(['Assert.Equal(' || p_size || ', Make(1))', 'Make(1)', '_f.ForEach(x => Seen(x))', 'Seen(x)']) AS invocation, unnest([true, false, false, false]) AS is_assertion FROM part")
def extract_invocations(t: Tables) -> DataFrame:
    return P.invocations_of(P.parse_files(_sources(t))).select("path", "method", "invocation", "is_assertion")


@over_tables("test_name_extract", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'T' || p_partkey END AS name FROM part")
def test_name_extract(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(F.col("p_size") % 3 == 0, F.format_string("[Fact]\npublic void T%d() { A(); }", k)).when(F.col("p_size") % 3 == 1, F.format_string("public class X { int y; [Fact] void T%d() => A(); }", k)).otherwise("nothing here")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([P.first_method_name(c) for c in batch.column(1).to_pylist()], pa.string())], names=["p_partkey", "name"])

    return t.spread("part", "p_partkey", "p_size").select("p_partkey", code.alias("code")).mapInArrow(run, "p_partkey long, name string")
