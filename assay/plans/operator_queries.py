"""Queries for the operators that aren't views: scalar functions, joins and lookups, aggregations, writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.functions.tokens import token_count as prompts_tokens
from assay.operators import generate as G
from assay.operators import metrics as M
from assay.operators import resolve as R
from assay.plans import views as V
from assay.plans.registry import query
from assay.sources import schema, sinks
from assay.sources.adapters import SMELLS, Tables, with_tables
from assay.streaming import ingest


#: Shingle counts of the methods' bodies.
_GRAMS = {"g": "SELECT class_id, id, g, count(*)::DOUBLE AS c FROM (SELECT class_id, id, unnest(list_transform(range(1, length(full_string) - 1), lambda i: substr(full_string, i, 3))) AS g FROM methods) GROUP BY ALL"}


#: Classes and methods whose names repeat within a file and over files.
_NAMESAKES = {"some_classes": "SELECT id, file_id, 'C' || id % 500 AS name FROM classes", "some_methods": "SELECT id, class_id, 'M' || id % 20 AS name FROM methods"}


def over_tables(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of ``Tables``; its SQL may name the warehouse's tables and views, and those of ``extra``."""

    def add(fn):
        query(name, None if sql is None else with_tables(sql, V.VIEW_SQL | _GRAMS | _NAMESAKES | (extra or {})))(lambda spark, sf_dir: fn(Tables(spark, sf_dir)))
        return fn

    return add


def scalar(name: str, table: str, keep: str, column, sql: str) -> None:
    """Register ``column`` (made when the query runs) as ``value`` beside the columns ``keep`` of a driver table."""
    query(name, f"SELECT {keep}, {sql} AS value FROM {table}")(lambda spark, sf_dir: Tables(spark, sf_dir).raw(table).select(*keep.split(", "), column().alias("value")))


C, L = F.col, F.lit
_DOTTED = lambda: F.concat(L("Suite.Part."), C("p_name"), L("(x: 1."), C("p_size").cast("string"), L(")"))
_DOTTED_SQL = "('Suite.Part.' || p_name || '(x: 1.' || p_size || ')')"
_MODS = lambda: F.array(F.concat(L(" "), F.upper("l_linestatus")), F.element_at(F.array(L("Public"), L("static"), L("private"), L("sealed"), L("internal"), L("async"), L("protected")), C("l_linenumber")), L("readonly"))
_WHERE_LI = "l_orderkey, l_linenumber, l_partkey"
_RATE = lambda: (C("l_quantity") - 1) / 50.0
_RESP = lambda: F.when(C("p_size") % 3 == 0, C("p_name")).when(C("p_size") % 3 == 1, F.concat(L("Here:\n```csharp\n"), C("p_name"), L("\n```\ndone"))).otherwise(F.concat(L("```\n "), C("p_type"), L(" csharp```x```y```")))
_RESP_SQL = "(CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN E'Here:\\n```csharp\\n' || p_name || E'\\n```\\ndone' ELSE E'```\\n ' || p_type || ' csharp```x```y```' END)"

scalar("like_pattern", "documents", "doc_id", lambda: F.coalesce(C("text").ilike("%LICENSE%"), L(False)), "coalesce(text ILIKE '%LICENSE%', false)")
scalar("in_list", "events", "event_id", lambda: C("event_type").isin("purchase", "signup"), "event_type IN ('purchase', 'signup')")
scalar("three_valued", "lineitem", _WHERE_LI, lambda: F.expr("(nullif(l_discount, 0D) is not null or nullif(l_tax, 0D) is not null) and (nullif(l_discount, 0D) != 0.1D or nullif(l_tax, 0D) != 0.08D)"), "(nullif(l_discount, 0) IS NOT NULL OR nullif(l_tax, 0) IS NOT NULL) AND (nullif(l_discount, 0) <> 0.1::DOUBLE OR nullif(l_tax, 0) <> 0.08::DOUBLE)")
scalar("guarded_ratio", "part", "p_partkey", lambda: F.when(C("p_size") % 5 > 0, F.round(C("p_size").cast("double") / (C("p_size") % 5), 9)), "CASE WHEN p_size % 5 > 0 THEN round(p_size::DOUBLE / (p_size % 5), 9) END")
scalar("arith_delta", "lineitem", _WHERE_LI, lambda: F.round(((C("l_tax") - C("l_discount")) + (C("l_quantity") - nullif_zero())) / 2, 9) + L(0.0), "round(((l_tax - l_discount) + (l_quantity - nullif(l_discount, 0))) / 2, 9) + 0.0::DOUBLE")
scalar("concat_op", "part", "p_partkey", lambda: F.concat(L("%"), C("p_name"), L("%")), "'%' || p_name || '%'")
scalar("sha256_hash", "documents", "doc_id", lambda: S.content_hash(C("text")), "sha256(text)")
scalar("simple_name", "part", "p_partkey", lambda: S.simple_name(_DOTTED()), f"list_extract(string_split({_DOTTED_SQL}, '.'), -1)")
scalar("lizard_name", "part", "p_partkey", lambda: S.complexity_name(F.concat(C("p_brand"), L("::"), C("p_name"), L("( int x )"))), "trim(string_split(list_extract(string_split(p_brand || '::' || p_name || '( int x )', '::'), -1), '(')[1])")
scalar("path_tail", "supplier", "s_suppkey", lambda: S.path_tail(F.concat(L("/app/project/src/"), C("s_name"), L(".cs"))), "s_name || '.cs'")
scalar("path_norm", "supplier", "s_suppkey", lambda: S.path_norm(F.concat(L("/x/app/project/y/app/project/src/"), C("s_name"), L(".cs"))), "'src/' || s_name || '.cs'")
scalar("visibility", "lineitem", _WHERE_LI, lambda: S.visibility(_MODS()), "CASE l_linenumber WHEN 1 THEN 'public' WHEN 3 THEN 'private' WHEN 7 THEN 'protected' ELSE 'internal' END")
scalar("framework_from_usings", "part", "p_partkey", lambda: S.framework_from_usings(F.array(L("using System;"), F.when(C("p_size") % 2 == 0, "using nunit.Framework;").otherwise("using A;"), F.when(C("p_size") % 3 == 0, "using XUNIT;").otherwise("using B;"))), "CASE WHEN p_size % 3 = 0 THEN 'xUnit' WHEN p_size % 2 = 0 THEN 'NUnit' ELSE '' END")
scalar("is_test_method", "part", "p_partkey", lambda: S.test_framework(F.array(L("Obsolete"), F.element_at(F.array(L("Theory"), L("Fact"), L("TestMethod"), L("fact")), (C("p_size") % 4 + 1).cast("int")))), "CASE p_size % 4 WHEN 0 THEN 'NUnit' WHEN 1 THEN 'xUnit' WHEN 2 THEN 'MSTest' END")
scalar("is_assertion", "documents", "doc_id", lambda: S.is_assertion(F.concat(C("source"), F.when(C("n_chars") % 2 == 0, ".Assert.True(x)").otherwise(".assert(x)"))), "n_chars % 2 = 0")
scalar("coverage_name_filter", "part", "p_partkey", lambda: S.coverage_name_kept(C("p_name")), "NOT (contains(p_name, 'get') OR contains(p_name, 'set') OR contains(p_name, '.ctor'))")
scalar("coverage_lookup_filter", "part", "p_partkey", lambda: S.coverage_lookup_kept(F.concat(F.when(C("p_size") % 2 == 0, "get_").otherwise("wid"), C("p_name"))), "p_size % 2 <> 0")
scalar("pct_truncate", "lineitem", _WHERE_LI, lambda: S.percent(_RATE()), "CAST(trunc(((l_quantity - 1) / 50.0::DOUBLE) * 100) AS INT)")
scalar("run_description", "lineitem", _WHERE_LI, lambda: S.run_description(S.percent(_RATE())), "CASE WHEN trunc(((l_quantity - 1) / 50.0::DOUBLE) * 100) > 0 THEN 'Success: Coverage Found' ELSE 'Failed: Zero Coverage Found' END")
scalar("run_id_tag", "nation", "n_nationkey", lambda: S.run_id_tag(F.md5("n_name"), C("n_regionkey") < 2), "CASE WHEN n_regionkey < 2 THEN 'baseline_' || md5(n_name) ELSE md5(n_name) END")
scalar("null_to_default", "events", "event_id", lambda: F.concat_ws("|", F.coalesce(F.when(C("event_type") == "error", C("props")), L("")), F.round(F.coalesce(F.when(C("user_id") % 2 == 0, C("value")), L(0.0)), 3).cast("decimal(18,3)").cast("string")), "coalesce(CASE WHEN event_type = 'error' THEN props END, '') || '|' || CAST(CAST(round(coalesce(CASE WHEN user_id % 2 = 0 THEN value END, 0), 3) AS DECIMAL(18,3)) AS VARCHAR)")
scalar("json_list", "part", "p_partkey", lambda: S.json_list(F.when(C("p_size") % 4 > 0, F.array("p_name", "p_brand"))), "CASE WHEN p_size % 4 > 0 THEN '[\"' || p_name || '\",\"' || p_brand || '\"]' ELSE 'null' END")
scalar("code_block_extract", "part", "p_partkey", lambda: S.code_block(_RESP()), f"trim(replace(CASE WHEN len(string_split({_RESP_SQL}, '```')) > 2 THEN string_split({_RESP_SQL}, '```')[2] ELSE {_RESP_SQL} END, 'csharp', ''), E' ')")
scalar("prompt_build", "part", "p_partkey", lambda: S.test_prompt(C("p_name"), C("p_type"), C("p_brand"), L("[]"), L("xUnit")), "'Write one xUnit test method for:' || chr(10) || p_name || chr(10) || 'An existing test:' || chr(10) || p_type || chr(10) || 'In the class:' || chr(10) || p_brand || chr(10) || 'Usings:' || chr(10) || '[]' || chr(10) || 'Give only the method, between two lines of ```.'")
scalar("prompt_repair", "part", "p_partkey", lambda: S.test_prompt(C("p_name"), C("p_type"), C("p_brand"), L("[]"), L("xUnit"), F.when(C("p_size") > 9, "boom")), "'Write one xUnit test method for:' || chr(10) || p_name || chr(10) || 'An existing test:' || chr(10) || p_type || chr(10) || 'In the class:' || chr(10) || p_brand || chr(10) || 'Usings:' || chr(10) || '[]' || chr(10) || 'Give only the method, between two lines of ```.' || chr(10) || 'The last attempt failed with:' || chr(10) || CASE WHEN p_size > 9 THEN 'boom' ELSE '' END")


def nullif_zero():
    return F.nullif(C("l_discount"), L(0.0))


@over_tables("case_category", "SELECT generated_test_id, test_outcome, evaluation_category FROM v_generated_test_evaluation")
def case_category(t: Tables) -> DataFrame:
    return V.generated_test_evaluation(t).select("generated_test_id", "test_outcome", "evaluation_category")


@over_tables("case_color", "SELECT evaluation_category, ui_color, count(*) AS n FROM v_generated_test_evaluation GROUP BY ALL")
def case_color(t: Tables) -> DataFrame:
    return V.generated_test_evaluation(t).groupBy("evaluation_category", "ui_color").agg(F.count(L(1)).alias("n"))


@over_tables("text_contains_test", "SELECT source, coalesce(bool_or(text ILIKE '%test%'), false) AS has_tests FROM documents GROUP BY source")
def text_contains_test(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("source").agg(F.coalesce(F.bool_or(C("text").ilike("%test%")), L(False)).alias("has_tests"))


#: Logs made of documents: some of one source and language end with the message, in any case.
_LOG = "CASE WHEN n_chars % 3 = 0 AND lang <> 'en' THEN coalesce(text, '') || ' >> code coverage is currently supported ONLY on windows. <<' ELSE text END"


@over_tables("windows_only", f"SELECT source, lang, coalesce(bool_or(({_LOG}) ILIKE '%Code coverage is currently supported only on Windows.%'), false) AS found FROM documents GROUP BY source, lang")
def windows_only(t: Tables) -> DataFrame:
    log = t.raw("documents").select("source", "lang", F.expr(_LOG).alias("content"))
    return log.groupBy("source", "lang").agg(F.coalesce(F.bool_or(S.windows_only(C("content"))), L(False)).alias("found"))


@over_tables("is_test_class", "SELECT class_id, bool_or(is_test_method) AS is_test_class FROM methods GROUP BY class_id")
def is_test_class(t: Tables) -> DataFrame:
    return t.methods.groupBy("class_id").agg(F.bool_or("is_test_method").alias("is_test_class"))


# --- writes and keys

@over_tables("upsert_by_hash", "SELECT d.doc_id AS id, m.surviving_id, d.doc_id = m.surviving_id AS inserted FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS surviving_id FROM documents GROUP BY 1) m ON sha256(d.text) = m.h")
def upsert_by_hash(t: Tables) -> DataFrame:
    """Every document with the id under which its content is stored; the first of equal ones is inserted."""
    rows = t.raw("documents").select(C("doc_id").alias("id"), S.content_hash(C("text")).alias("content_hash"))
    stored = R.first_of(rows, ["content_hash"], "id")
    return R.surviving_ids(rows, stored, ["content_hash"]).withColumn("inserted", C("id") == C("surviving_id"))


@over_tables("upsert_by_key", "SELECT p_name AS name, p_brand AS brand, min(p_partkey) AS id, arg_min(p_type, p_partkey) AS kind FROM part p WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_name = p.p_name) GROUP BY p_name, p_brand")
def upsert_by_key(t: Tables) -> DataFrame:
    """Parts by (name, brand), the first of each key, without names that exist (nations)."""
    rows = t.raw("part").selectExpr("p_name name", "p_brand brand", "p_partkey id", "p_type kind")
    return R.first_of(rows, ["name", "brand"], "id").join(t.raw("nation").selectExpr("n_name name"), "name", "left_anti")


@over_tables("append_rows", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS amount FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def append_rows(t: Tables) -> DataFrame:
    """Two tables appended to one, and that read back."""
    path = sinks.shared_path(t.spark, "append-rows")
    suppliers = t.raw("supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal amount")
    for rows in (suppliers, t.raw("customer").selectExpr("c_custkey id", "c_name name", "c_acctbal amount")):
        sinks.append(rows, path)
    return t.spark.read.schema(suppliers.schema).parquet(path)


@over_tables("append_rows_tx", "SELECT run_id, count(*) AS n FROM test_results GROUP BY run_id")
def append_rows_tx(t: Tables) -> DataFrame:
    """All results of a job become visible at once or not at all; counted after they were read back."""
    path = sinks.shared_path(t.spark, "append-rows-tx")
    sinks.append(t.test_results, path, partition=None)
    return t.spark.read.schema(t.test_results.schema).parquet(path).groupBy("run_id").agg(F.count(L(1)).alias("n"))


@over_tables("update_run_status", "SELECT user_id AS run, arg_max(event_type, event_id) AS result, arg_max(value, event_id) AS coverage, max(event_id) AS seq FROM events GROUP BY user_id")
def update_run_status(t: Tables) -> DataFrame:
    updates = t.raw("events").select(C("user_id").alias("run"), C("event_type").alias("result"), C("value").alias("coverage"), C("event_id").alias("seq"))
    return R.latest_state(updates, "run", "seq")


@over_tables("surrogate_ids", "SELECT o_orderkey, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY o_orderkey) AS surrogate_id FROM orders")
def surrogate_ids(t: Tables) -> DataFrame:
    last = t.raw("part").agg(F.max("p_partkey")).first()[0] or 0
    return R.surrogate_ids(t.raw("orders").select("o_orderkey"), "o_orderkey", last, width=1_000)


@over_tables("split_sink", "SELECT doc_id, source, coalesce(text ILIKE '%test%', false) AS has_tests FROM documents")
def split_sink(t: Tables) -> DataFrame:
    """Rows go to one of two folders, and are read back from both."""
    path = sinks.shared_path(t.spark, "split")
    rows = t.raw("documents").select("doc_id", "source", F.coalesce(C("text").ilike("%test%"), L(False)).alias("has_tests"))
    sinks.split_by(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


_SCHEMA_ROWS = [(name, i, *column.split()[:2], len(SMELLS) if name == "test_smells" else 0) for name in schema.COLUMNS for i, column in enumerate(schema.ddl(name).split(", "))]


@over_tables("create_schema", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {i}, '{c}', '{kind}', {n}::BIGINT)" for a, i, c, kind, n in _SCHEMA_ROWS) + ") v(table_name, position, column_name, data_type, n_rows)")
def create_schema(t: Tables) -> DataFrame:
    """The tables are made, and made again, which changes nothing; then each file's columns and rows."""
    root = sinks.shared_path(t.spark, "warehouse")
    schema.create(t.spark, root)
    schema.create(t.spark, root)
    parts = []
    for name in schema.COLUMNS:
        stored = t.spark.read.parquet(f"{root}/{name}")
        fields = F.array(*(F.struct(L(i).alias("position"), L(f.name).alias("column_name"), L(f.dataType.simpleString()).alias("data_type")) for i, f in enumerate(stored.schema.fields)))
        parts.append(stored.agg(F.count(L(1)).alias("n_rows")).select(L(name).alias("table_name"), F.explode(fields).alias("f"), "n_rows").select("table_name", "f.*", "n_rows"))
    return reduce(DataFrame.unionByName, parts)


@over_tables("token_count")
def token_count(t: Tables) -> DataFrame:
    """Tokens of the prompts made for parts; the library's file of ranks is a parameter."""
    import public_tokenizers

    prompt = S.test_prompt(C("p_name"), C("p_type"), C("p_brand"), L("[]"), L("xUnit"))
    return t.raw("part").select("p_partkey", prompts_tokens(prompt, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).alias("n_tokens"))


@over_tables("llm_generate", f"SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN {_RESP_SQL} END AS response FROM part")
def llm_generate(t: Tables) -> DataFrame:
    """Answers recorded for three quarters of the prompts, each twice; the first counts."""
    parts = t.raw("part").withColumn("prompt", F.concat(L("Test "), C("p_partkey").cast("string")))
    first = parts.where("p_size % 4 > 0").select(G.record_key(C("prompt")).alias("prompt_hash"), L(1).alias("seq"), _RESP().alias("response"))
    recorded = first.unionByName(first.select("prompt_hash", L(2).alias("seq"), L("again").alias("response")))
    return G.responses(parts.select("p_partkey", "prompt"), recorded).select("p_partkey", "response")


@over_tables("stream_insert_new", "SELECT sha256(text) AS content_hash, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stream_insert_new(t: Tables) -> DataFrame:
    """Documents as a stream into a table that takes new contents only."""
    table = sinks.shared_path(t.spark, "stream-table")
    rows = t.stream("documents").where("text is not null").select(C("doc_id").alias("id"), S.content_hash(C("text")).alias("content_hash"))
    ingest.insert_new(rows, table, ["content_hash"], "id", f"{table}-offsets").awaitTermination()
    return t.spark.read.option("basePath", table).parquet(table).select("content_hash", "id")


@over_tables("stream_outcomes", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_outcomes(t: Tables) -> DataFrame:
    """Events as a stream, counted by hour."""
    table = sinks.shared_path(t.spark, "stream-windows")
    rows = t.stream("events").withColumn("ts", C("ts").cast("timestamp"))
    counts = ingest.outcomes_by_window(rows, outcome="event_type")
    ingest.publish(counts, table, f"{table}-offsets").awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(table).withColumn("start", C("start").cast("timestamp_ntz"))


@over_tables("scan_tables", "SELECT coalesce(COLUMNS('(_id|_rate|_start|_end)$'), 0), coalesce(COLUMNS('(_name|_body|_status|_framework|_path|_dependencies|_namespace)$'), '') FROM v_baseline_uncovered_tested_methods")
def scan_tables(t: Tables) -> DataFrame:
    """The view of candidates stored, opened again and read with defaults for nulls."""
    view = V.baseline_uncovered_tested_methods(t)
    path = sinks.shared_path(t.spark, "scan-tables")
    sinks.append(view, path, partition=None)
    return R.with_defaults(t.spark.read.schema(view.schema).parquet(path))


# --- lookups

_CALLED = "SELECT g.id, 'Suite.' || m.name AS test_name FROM generated_tests g JOIN methods m ON m.id = g.original_method_id"


def _called(t: Tables) -> DataFrame:
    return t.generated_tests.select("id", C("original_method_id").alias("m")).join(t.methods.select(C("id").alias("m"), F.concat(L("Suite."), "name").alias("test_name")), "m").drop("m")


@over_tables("lookup_exact", f"SELECT c.id, c.test_name, f.found_id FROM ({_CALLED}) c LEFT JOIN (SELECT name, min(id) AS found_id FROM methods GROUP BY name) f ON f.name = list_extract(string_split(c.test_name, '.'), -1)")
def lookup_exact(t: Tables) -> DataFrame:
    return R.lookup(_called(t).withColumn("name", S.simple_name(C("test_name"))), t.methods, ["name"]).drop("name")


@over_tables("lookup_name_class", "SELECT i.id, f.found_id FROM invocations i JOIN methods m ON m.id = i.target_method_id LEFT JOIN (SELECT name, class_id, min(id) AS found_id FROM methods GROUP BY ALL) f ON f.name = m.name AND f.class_id = m.class_id")
def lookup_name_class(t: Tables) -> DataFrame:
    rows = t.invocations.select(C("id"), C("target_method_id").alias("m")).join(t.methods.selectExpr("id m", "name", "class_id"), "m")
    return R.lookup(rows, t.methods, ["name", "class_id"]).select("id", "found_id")


@over_tables("lookup_name_path", "SELECT i.id, f.found_id FROM invocations i JOIN methods m ON m.id = i.target_method_id JOIN classes c ON c.id = m.class_id JOIN source_files s ON s.id = c.file_id LEFT JOIN (SELECT m.name, s.path, min(m.id) AS found_id FROM methods m JOIN classes c ON c.id = m.class_id JOIN source_files s ON s.id = c.file_id GROUP BY ALL) f ON f.name = m.name AND f.path = s.path")
def lookup_name_path(t: Tables) -> DataFrame:
    placed = t.methods.select("id", "name", "class_id").join(t.classes.selectExpr("id class_id", "file_id"), "class_id").join(t.source_files.selectExpr("id file_id", "path"), "file_id").select("id", "name", "path")
    rows = t.invocations.select("id", C("target_method_id").alias("m")).join(placed.withColumnRenamed("id", "m"), "m")
    return R.lookup(rows, placed, ["name", "path"]).select("id", "found_id")


@over_tables("lookup_contains", "SELECT m.id, f.found_id FROM methods m LEFT JOIN (SELECT x.full_string, min(n.id) AS found_id FROM (SELECT DISTINCT full_string FROM methods) x JOIN (SELECT name, min(id) AS id FROM methods WHERE is_test_method GROUP BY name) n ON lower(x.full_string) LIKE '%' || lower(n.name) || '%' GROUP BY x.full_string) f USING (full_string)")
def lookup_contains(t: Tables) -> DataFrame:
    tests = t.methods.where("is_test_method").select("id", "name")
    return R.lookup_contained(t.methods.select("id", "full_string"), "full_string", tests, "name").select("id", "found_id")


@over_tables("lookup_file", "SELECT m.id, f.found_id FROM mutants m JOIN supplier s ON s.s_suppkey = m.source_file_id LEFT JOIN (SELECT x.s_name, min(f.id) AS found_id FROM supplier x JOIN source_files f ON lower(f.path) LIKE '%' || lower(x.s_name) || '%' GROUP BY x.s_name) f ON f.s_name = s.s_name")
def lookup_file(t: Tables) -> DataFrame:
    """The first of the files whose path holds the reported name."""
    names, files = t.raw("supplier").selectExpr("s_suppkey source_file_id", "s_name"), t.source_files.groupBy("path").agg(F.min("id").alias("_id"))
    found = R.containing(files, "path", names, "s_name").join(files, "path").groupBy("s_name").agg(F.min("_id").alias("found_id"))
    return t.mutants.select("id", "source_file_id").join(names, "source_file_id").join(found, "s_name", "left").select("id", "found_id")


_LOCATED = "SELECT u.id, min(m.id) AS found_id FROM mutants u JOIN classes c ON c.file_id = u.source_file_id JOIN methods m ON m.class_id = c.id AND u.start_line BETWEEN m.start_line AND m.end_line GROUP BY u.id"


def _located(t: Tables) -> DataFrame:
    spans = t.methods.select("id", "class_id", "start_line", "end_line").join(t.classes.selectExpr("id class_id", "file_id source_file_id"), "class_id")
    points = t.mutants.select(C("id").alias("mutant"), "source_file_id", C("start_line").alias("line"))
    return R.lookup_in_range(points, spans, "source_file_id", "line", "start_line", "end_line", "mutant").withColumnRenamed("mutant", "id")


over_tables("lookup_location", _LOCATED)(_located)


@over_tables("semi_drop_unmatched", f"SELECT id, source_file_id, start_line FROM mutants WHERE id NOT IN (SELECT id FROM ({_LOCATED}))")
def semi_drop_unmatched(t: Tables) -> DataFrame:
    return R.rejects(t.mutants.select("id", "source_file_id", "start_line"), _located(t), "id")


@over_tables("lookup_class", "SELECT c.id, f.found_id FROM class_coverage c LEFT JOIN (SELECT name, min(id) AS found_id FROM classes GROUP BY name) f ON f.name = list_extract(string_split('App.' || c.name, '.'), -1)")
def lookup_class(t: Tables) -> DataFrame:
    return R.lookup(t.class_coverage.select("id", S.simple_name(F.concat(L("App."), "name")).alias("name")), t.classes, ["name"]).drop("name")


@over_tables("lookup_smell", "SELECT m.method_id, m.test_smell_id, s.name, coalesce(f.id, 0) AS found_id FROM method_test_smells m JOIN test_smells s ON s.id = m.test_smell_id LEFT JOIN test_smells f ON f.name = s.name")
def lookup_smell(t: Tables) -> DataFrame:
    rows = t.method_test_smells.join(t.test_smells.withColumnRenamed("id", "test_smell_id"), "test_smell_id").select("method_id", "test_smell_id", "name")
    return R.lookup(rows, t.test_smells, ["name"]).withColumn("found_id", F.coalesce("found_id", L(0).cast("long")))


@over_tables("lookup_run", "SELECT r.id, t.id AS found_id FROM test_results r LEFT JOIN test_runs t USING (run_id)")
def lookup_run(t: Tables) -> DataFrame:
    return R.lookup(t.test_results.select("id", "run_id"), t.test_runs, ["run_id"]).drop("run_id")


@over_tables("map_lookup", "SELECT u.id, x.k, m.name FROM (SELECT l.l_orderkey * 10 + l.l_linenumber AS id, unnest([l.pk, l.sk]) AS k FROM li l) x JOIN mutants u ON u.id = x.id JOIN methods m ON m.id = x.k")
def map_lookup(t: Tables) -> DataFrame:
    """Ids in the mutants' coveredBy lists (part and supplier key) with their names."""
    covered = t.lines.select("id", F.explode(F.array("pk", "sk")).alias("k"))
    return covered.join(t.methods.selectExpr("id k", "name"), "k").select("id", "k", "name")


@over_tables("join_unresolved", "SELECT i.id AS invocation_id, i.full_string AS invocation, m.id AS method_id, m.name AS method_name, c.id AS class_id, c.name AS class_name, f.path, p.project_path, s.solution_path FROM invocations i JOIN methods m ON m.id = i.target_method_id JOIN classes c ON c.id = m.class_id JOIN source_files f ON f.id = c.file_id JOIN analysis_projects p ON p.id = f.analysis_project_id JOIN analysis_solutions s ON s.id = p.solution_id WHERE i.source_method_id = 0")
def join_unresolved(t: Tables) -> DataFrame:
    calls = t.invocations.where("source_method_id = 0").selectExpr("id invocation_id", "full_string invocation", "target_method_id method_id")
    rows = calls.join(t.methods.selectExpr("id method_id", "name method_name", "class_id"), "method_id").join(t.classes.selectExpr("id class_id", "name class_name", "file_id"), "class_id")
    rows = rows.join(t.source_files.selectExpr("id file_id", "path", "analysis_project_id"), "file_id").join(t.analysis_projects.selectExpr("id analysis_project_id", "project_path", "solution_id"), "analysis_project_id")
    return rows.join(t.analysis_solutions.selectExpr("id solution_id", "solution_path"), "solution_id").drop("file_id", "analysis_project_id", "solution_id")


# --- aggregations

@over_tables("count_candidates", "SELECT count(*) > 0 AS found FROM v_baseline_uncovered_tested_methods")
def count_candidates(t: Tables) -> DataFrame:
    return M.exists(V.baseline_uncovered_tested_methods(t).limit(1))


#: The framework of each test method.
_FRAMEWORK = "CASE WHEN id % 3 = 0 THEN 'XUnit' WHEN id % 3 = 1 THEN 'NUnit' END"
_FLAGS = {
    "coverage_reports": (lambda t: M.exists(t.coverage_reports, C("id") > 0), "SELECT coalesce(bool_or(id > 0), false) AS found FROM coverage_reports"),
    "mutation_reports": (lambda t: M.exists(t.mutants, C("id") > 0), "SELECT coalesce(bool_or(id > 0), false) AS found FROM mutants"),
    "file_metrics": (lambda t: M.exists(t.source_files, C("id") > 0), "SELECT coalesce(bool_or(id > 0), false) AS found FROM source_files"),
    "function_metrics": (lambda t: M.exists(t.lizard_function_code_metrics, C("method_id") > 0), "SELECT coalesce(bool_or(method_id > 0), false) AS found FROM lizard_function_code_metrics"),
    "xunit_tests": (lambda t: M.exists(t.methods.where("is_test_method"), F.lower(F.expr(_FRAMEWORK)) == "xunit"), f"SELECT coalesce(bool_or(lower({_FRAMEWORK}) = 'xunit'), false) AS found FROM methods WHERE is_test_method"),
    "passing_tests": (lambda t: M.exists(t.test_results, F.lower("test_outcome") == "passed"), "SELECT coalesce(bool_or(lower(test_outcome) = 'passed'), false) AS found FROM test_results"),
}
for _flag, (_fn, _sql) in _FLAGS.items():
    over_tables(f"exists_{_flag}", _sql)(_fn)


@over_tables("validation_row", "SELECT * FROM " + ", ".join(f"(SELECT found AS {n} FROM ({s}))" for n, (_, s) in _FLAGS.items()) + ", (SELECT count(*) > 0 AS candidates FROM v_baseline_uncovered_tested_methods)")
def validation_row(t: Tables) -> DataFrame:
    return M.validation_row({n: fn(t) for n, (fn, _) in _FLAGS.items()} | {"candidates": M.exists(V.baseline_uncovered_tested_methods(t).limit(1))})


@over_tables("random_sample_k", "SELECT * FROM v_candidate_covered_methods ORDER BY md5('7:' || method_id), method_id, line_rate NULLS FIRST, branch_rate NULLS FIRST LIMIT 3")
def random_sample_k(t: Tables) -> DataFrame:
    return M.random_sample(V.candidate_covered_methods(t), ["method_id", "line_rate", "branch_rate"], 3)


_KINDS = "count(*) FILTER (WHERE NOT static AND lower(status) = '{}') AS {}"
_SCORE = f"SELECT source_file_id, {', '.join(_KINDS.format(a, b) for a, b in (('killed', 'killed'), ('timeout', 'timeout'), ('compileerrors', 'compile_errors'), ('survived', 'survived'), ('nocoverage', 'no_coverage')))}, count(*) FILTER (WHERE lower(status) = 'ignored') AS ignored FROM mutants GROUP BY source_file_id"


@over_tables("mutation_score", f"SELECT *, killed + timeout + compile_errors AS detected, survived + no_coverage AS undetected, CASE WHEN killed + timeout + compile_errors + survived + no_coverage > 0 THEN round((killed + timeout + compile_errors)::DOUBLE / (killed + timeout + compile_errors + survived + no_coverage) * 100, 9) ELSE 0 END AS mutation_score FROM ({_SCORE})")
def mutation_score(t: Tables) -> DataFrame:
    """Some reports write their statuses in lower case."""
    return M.mutation_score(t.mutants.withColumn("status", F.when(C("id") % 3 == 0, F.lower("status")).otherwise(C("status"))))


@over_tables("smell_pivot", "SELECT c.id AS class_id, " + ", ".join(f"count(*) FILTER (WHERE s.name = '{n}') AS \"{n}\"" for n in SMELLS) + ", count(*) AS total FROM method_test_smells x JOIN test_smells s ON s.id = x.test_smell_id JOIN methods m ON m.id = x.method_id JOIN classes c ON c.id = m.class_id WHERE x.status = 'Found' GROUP BY c.id")
def smell_pivot(t: Tables) -> DataFrame:
    rows = t.method_test_smells.join(t.test_smells.selectExpr("id test_smell_id", "name"), "test_smell_id").join(t.methods.selectExpr("id method_id", "class_id"), "method_id")
    return M.smell_counts(rows, "class_id", "name", "status", list(SMELLS))


@over_tables(
    "dedupe_smells",
    "SELECT w.id AS method_id, x.test_smell_id, arg_min(x.status, c.id * 1000000000000 + x.method_id) AS status, count(*) AS n FROM method_test_smells x JOIN some_methods m ON m.id = x.method_id JOIN some_classes o ON o.id = m.class_id JOIN some_classes c ON c.file_id = o.file_id JOIN (SELECT name, min(id) AS id FROM some_classes GROUP BY name) l ON l.name = c.name JOIN (SELECT name, class_id, min(id) AS id FROM some_methods GROUP BY ALL) w ON w.name = m.name AND w.class_id = l.id GROUP BY w.id, x.test_smell_id",
)
def dedupe_smells(t: Tables) -> DataFrame:
    """A report that has a file's methods under each of its classes, bound by (class, method) name."""
    return R.bind_smells(t.method_test_smells, t.methods.selectExpr("id", "class_id", "concat('M', id % 20) name"), t.classes.selectExpr("id", "file_id", "concat('C', id % 500) name"))


@over_tables("dup_cov_files", "SELECT list_extract(string_split(path, '/'), -1) AS base_name, min(path) AS path FROM (SELECT lang || '/' || source || '.xml' AS path FROM documents) GROUP BY 1")
def dup_cov_files(t: Tables) -> DataFrame:
    return M.one_per_name(t.raw("documents").select(F.concat("lang", L("/"), "source", L(".xml")).alias("path")), "path")


@over_tables("first_attempt_stop", "SELECT user_id, event_id, attempt FROM (SELECT user_id, event_id, event_type, row_number() OVER w AS attempt, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE attempt <= 5 AND before = 0")
def first_attempt_stop(t: Tables) -> DataFrame:
    return M.attempts_until_passed(t.raw("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", C("event_type") == "purchase", 5).select("user_id", "event_id", "attempt")


@over_tables("class_cohesion", """SELECT class_id, count(*) AS bodies, CASE WHEN count(*) > 1 THEN any_value(mean) END AS mean_similarity, coalesce(count(*) > 1 AND 1 - any_value(mean) >= 0.6::DOUBLE, false) AS lacks_cohesion FROM (
  SELECT m.class_id, m.id, p.mean FROM methods m LEFT JOIN (
    SELECT class_id, round(2 * sum(dot) / (any_value(n) * (any_value(n) - 1)), 6) + 0.0::DOUBLE AS mean FROM (
      SELECT a.class_id, a.id, b.id AS other, sum(a.c * b.c) / (sqrt(any_value(na.norm)) * sqrt(any_value(nb.norm))) AS dot, any_value(k.n) AS n
      FROM g a JOIN g b ON a.class_id = b.class_id AND a.g = b.g AND a.id < b.id
      JOIN (SELECT id, sum(c * c) AS norm FROM g GROUP BY id) na ON na.id = a.id JOIN (SELECT id, sum(c * c) AS norm FROM g GROUP BY id) nb ON nb.id = b.id
      JOIN (SELECT class_id, count(*) AS n FROM methods GROUP BY class_id) k ON k.class_id = a.class_id GROUP BY a.class_id, a.id, b.id)
    GROUP BY class_id) p ON p.class_id = m.class_id) GROUP BY class_id""")  # fmt: skip
def class_cohesion(t: Tables) -> DataFrame:
    return M.cohesion(t.methods, "class_id", "full_string", "id")
