"""The warehouse's tables, derived from the driver's star schema (see FIXTURES.md), with the same in DuckDB SQL.

Ids are BIGINT, rates DOUBLE, flags BOOLEAN. ``Tables`` reads lazily: a query touches only
the columns of the tables that it asks for.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of smell, in the order of their ids.
SMELLS = (
    "EmptyTestSmell", "ConditionalTestSmell", "CyclomaticComplexityTestSmell", "ExpectedExceptionTestSmell", "AssertionRouletteTestSmell", "UnknownTestSmell", "RedundantPrintTestSmell", "SleepyTestSmell", "IgnoreTestSmell",
    "RedundantAssertionTestSmell", "DuplicateAssertionTestSmell", "MagicNumberTestSmell", "EagerTestSmell", "BoolInAssertEqualSmell", "EqualInAssertSmell", "SensitiveEqualitySmell", "ConstructorInitializationTestSmell", "ObscureInLineSetUpSmell",
)


class Tables:
    #: The columns that tell repositories apart; the tables hold one here.
    scope: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str, *columns: str, each: int = 5000) -> DataFrame:
        """Columns of a table dealt out to tasks of some ``each`` rows, for work that is done row by row: Spark splits files by bytes, and a small one holds much of it. Rows are counted in the files' footers."""
        rows = self.raw(name).select(*columns)
        return rows.repartition(max(1, -(-rows.count() // each)))

    def stream(self, name: str) -> DataFrame:
        """A table's files as a stream; the pattern stands for a single file or a folder, which a plain path wouldn't."""
        return self.spark.readStream.schema(self.raw(name).schema).parquet(f"{self.dir}/{name}.[p]arquet")

    @cached_property
    def n_part(self) -> int:
        return self.raw("part").count()

    @cached_property
    def n_customer(self) -> int:
        return self.raw("customer").count()

    @cached_property
    def n_supplier(self) -> int:
        return self.raw("supplier").count()

    @cached_property
    def test_runs(self) -> DataFrame:
        return self.raw("region").selectExpr("cast(r_regionkey as bigint) id", "concat(if(r_regionkey < 2, 'baseline_', 'run_'), lower(r_name)) run_id")

    @cached_property
    def coverage_reports(self) -> DataFrame:
        return self.test_runs.selectExpr(
            "id", "run_id test_run_id", "1700000000 + id * 100 timestamp", "(id + 3) / 10D line_rate", "(id + 2) / 10D branch_rate", "100 * id + 300 lines_covered", "cast(1000 as bigint) lines_valid",
            "50 * id + 100 branches_covered", "cast(500 as bigint) branches_valid", "id * 2.0D complexity",
        )

    @cached_property
    def package_coverage(self) -> DataFrame:
        return self.raw("nation").selectExpr("cast(n_nationkey as bigint) id", "cast(n_regionkey as bigint) coverage_report_id", "n_name name")

    @cached_property
    def class_coverage(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey id", "cast(c_nationkey as bigint) package_coverage_id", "c_custkey class_id", "c_name name")

    @cached_property
    def method_coverage(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey id", "o_custkey class_coverage_id", f"o_orderkey % {self.n_part} method_id", "o_orderkey * 7 % 11 / 10D line_rate", "o_orderkey * 3 % 6 / 5D branch_rate", "double(o_orderkey % 9) complexity"
        )

    @cached_property
    def analysis_solutions(self) -> DataFrame:
        return self.raw("region").selectExpr("cast(r_regionkey as bigint) id", "r_name solution_path")

    @cached_property
    def analysis_projects(self) -> DataFrame:
        return self.raw("nation").selectExpr("cast(n_nationkey as bigint) id", "cast(n_regionkey as bigint) solution_id", "n_name project_path")

    @cached_property
    def source_files(self) -> DataFrame:
        path = "concat('/app/project/src/', s_name, '.cs')"
        return self.raw("supplier").selectExpr("s_suppkey id", "cast(s_nationkey as bigint) analysis_project_id", f"{path} name", f"{path} path", "'[]' usings", "s_name namespace")

    @cached_property
    def classes(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey id", f"c_custkey % {self.n_supplier} file_id", "c_name name", "c_custkey % 2 = 1 is_test_class", "c_mktsegment full_string", "c_mktsegment testing_framework",
            "c_custkey % 100 start_line", "cast(4 as bigint) body_start", "c_custkey % 100 + 50 end_line", "cast(5 as bigint) body_end",
        )

    @cached_property
    def methods(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey id", f"p_partkey % {self.n_customer} class_id", "p_name name", "p_partkey % 2 = 1 is_test_method", "cast(p_size as bigint) start_line", "cast(p_size + 20 as bigint) end_line",
            "concat(p_name, ' ', p_type, ' ', p_brand) full_string",
        )

    @cached_property
    def lines(self) -> DataFrame:
        """One row for each (l_orderkey, l_linenumber), which the driver's table repeats. Rows are dealt out first: merged before that, a task would sort all of its split in memory, as least texts go by sorting."""
        return (
            self.raw("lineitem")
            .repartition("l_orderkey", "l_linenumber")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_extendedprice").alias("price"))
            .selectExpr("l_orderkey", "l_linenumber", "l_orderkey * 10 + l_linenumber id", "pk", "sk", "cast(quantity as bigint) qty", "flag", "status", "price")
        )

    @cached_property
    def invocations(self) -> DataFrame:
        return self.lines.selectExpr("id", "pk - pk % 2 + 1 target_method_id", f"if(sk % 5 = 0, 0, sk * 2 % {self.n_part}) source_method_id", "concat('Call_', pk, '(', qty, ')') full_string")

    @cached_property
    def generated_tests(self) -> DataFrame:
        return self.lines.selectExpr(
            "id", "2 + sk % 3 test_run_id", "pk - pk % 2 original_method_id", "pk - pk % 2 + 1 test_method_id", "l_orderkey % 5003 gen_test_method_id", "flag provider", "status model",
            "if(l_linenumber % 2 = 1, 'pass@1', 'pass@5') strategy", "qty prompt_token_count", "price generation_duration",
        )

    @cached_property
    def test_results(self) -> DataFrame:
        outcome = "case event_type when 'purchase' then 'Passed' when 'signup' then 'pass' when 'error' then 'Failed' when 'click' then 'Passed' else 'NotExecuted' end"
        events = self.raw("events").selectExpr("event_id id", "user_id method_id", "2 + event_id % 3 run", f"{outcome} test_outcome", "value test_duration", "if(event_type = 'error', props, null) error_message")
        return events.join(self.test_runs.selectExpr("id run", "run_id"), "run").drop("run")

    @cached_property
    def lizard_function_code_metrics(self) -> DataFrame:
        runs = self.test_runs.select(F.collect_list("run_id").alias("runs"))  # one row
        return self.raw("part").crossJoin(F.broadcast(runs)).selectExpr("explode(runs) test_run_id", "p_partkey method_id", "cast(p_size % 12 as bigint) ncss", "p_partkey % 5 ccn")

    @cached_property
    def test_smells(self) -> DataFrame:
        return self.spark.createDataFrame([(i + 1, n) for i, n in enumerate(SMELLS)], "id long, name string")

    @cached_property
    def method_test_smells(self) -> DataFrame:
        return self.raw("events").groupBy(F.col("user_id").alias("method_id"), F.expr("1 + event_id % 18").alias("test_smell_id")).agg(F.expr("if(min(event_id) % 3 = 0, 'Found', 'Not Found')").alias("status"))

    @cached_property
    def mutants(self) -> DataFrame:
        other = "element_at(array('Timeout', 'NoCoverage', 'Ignored', 'CompileErrors'), cast(l_linenumber % 4 + 1 as int))"
        return self.lines.selectExpr("id", "sk source_file_id", "qty start_line", "l_linenumber % 7 = 0 static", f"case flag when 'R' then 'Killed' when 'A' then 'Survived' else {other} end status")


#: Repositories of ``RepoTables``; the last has no baseline run.
REPOS = 5
#: Fixed: tables whose rows exist in every repository, with values that differ ({r} is its number), and those whose rows are dealt out by a key.
SHARED = {
    "test_runs": {"run_id": "CASE WHEN {r} = 4 THEN replace(run_id, 'baseline_', 'run_') ELSE run_id END"},
    "coverage_reports": {
        "test_run_id": "CASE WHEN {r} = 4 THEN replace(test_run_id, 'baseline_', 'run_') ELSE test_run_id END", "timestamp": "timestamp + (id * 7 + {r} * 3) % 5 * 1000",
        "line_rate": "line_rate - {r} * 0.01", "lines_covered": "lines_covered + {r} * id",
    },
    "package_coverage": {"coverage_report_id": "(coverage_report_id + {r}) % 5"},
    "class_coverage": {"name": "concat(name, '@', {r})"},
    "analysis_solutions": {"solution_path": "concat(solution_path, '@', {r})"},
    "analysis_projects": {"project_path": "concat(project_path, '@', {r})"},
    "source_files": {"path": "concat('/', {r}, path)"},
    "classes": {"name": "concat(name, '@', {r})"},
    "methods": {"name": "concat(name, '@', {r})"},
}
DEALT = {"method_coverage": "id", "invocations": "id", "generated_tests": "id", "test_results": "id", "lizard_function_code_metrics": "method_id", "method_test_smells": "method_id", "mutants": "id"}


class RepoTables:
    """The same tables for several repositories, told apart by ``repo_id``.

    Ids repeat between repositories: each has the same classes, methods, files and reports by id, with values of its own, and a share of the
    rows that grow with runs.
    """

    scope = ("repo_id",)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.one = spark, Tables(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SHARED:
            # A join, so that Spark takes the rows for as many as they are: an exploded table is taken for the size of its file and broadcast through the driver.
            repos = self.spark.range(REPOS).select(F.col("id").cast("int").alias("_r"))
            rows = getattr(self.one, name).crossJoin(F.broadcast(repos))
            return rows.selectExpr("concat('repo_', _r) repo_id", *(f"{SHARED[name][c].format(r='_r')} {c}" if c in SHARED[name] else c for c in rows.columns if c != "_r"))
        if name in DEALT:
            return getattr(self.one, name).selectExpr(f"concat('repo_', {DEALT[name]} % {REPOS}) repo_id", "*")
        raise AttributeError(name)


_PATH = "'/app/project/src/' || s_name || '.cs'"
#: The same tables as DuckDB common table expressions, in an order in which each needs only earlier ones.
DUCKDB = {
    "test_runs": "SELECT r_regionkey::BIGINT AS id, (CASE WHEN r_regionkey < 2 THEN 'baseline_' ELSE 'run_' END) || lower(r_name) AS run_id FROM region",
    "coverage_reports": "SELECT id, run_id AS test_run_id, 1700000000 + id * 100 AS timestamp, (id + 3) / 10.0::DOUBLE AS line_rate, (id + 2) / 10.0::DOUBLE AS branch_rate, 100 * id + 300 AS lines_covered, 1000::BIGINT AS lines_valid, 50 * id + 100 AS branches_covered, 500::BIGINT AS branches_valid, id * 2.0::DOUBLE AS complexity FROM test_runs",
    "package_coverage": "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS coverage_report_id, n_name AS name FROM nation",
    "class_coverage": "SELECT c_custkey AS id, c_nationkey::BIGINT AS package_coverage_id, c_custkey AS class_id, c_name AS name FROM customer",
    "method_coverage": "SELECT o_orderkey AS id, o_custkey AS class_coverage_id, o_orderkey % (SELECT count(*) FROM part) AS method_id, (o_orderkey * 7 % 11) / 10.0::DOUBLE AS line_rate, (o_orderkey * 3 % 6) / 5.0::DOUBLE AS branch_rate, (o_orderkey % 9)::DOUBLE AS complexity FROM orders",
    "analysis_solutions": "SELECT r_regionkey::BIGINT AS id, r_name AS solution_path FROM region",
    "analysis_projects": "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS solution_id, n_name AS project_path FROM nation",
    "source_files": f"SELECT s_suppkey AS id, s_nationkey::BIGINT AS analysis_project_id, {_PATH} AS name, {_PATH} AS path, '[]' AS usings, s_name AS namespace FROM supplier",
    "classes": "SELECT c_custkey AS id, c_custkey % (SELECT count(*) FROM supplier) AS file_id, c_name AS name, c_custkey % 2 = 1 AS is_test_class, c_mktsegment AS full_string, c_mktsegment AS testing_framework, c_custkey % 100 AS start_line, 4::BIGINT AS body_start, c_custkey % 100 + 50 AS end_line, 5::BIGINT AS body_end FROM customer",
    "methods": "SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM customer) AS class_id, p_name AS name, p_partkey % 2 = 1 AS is_test_method, p_size::BIGINT AS start_line, (p_size + 20)::BIGINT AS end_line, p_name || ' ' || p_type || ' ' || p_brand AS full_string FROM part",
    "li": "SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS pk, min(l_suppkey) AS sk, trunc(min(l_quantity))::BIGINT AS qty, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "invocations": "SELECT id, pk - pk % 2 + 1 AS target_method_id, CASE WHEN sk % 5 = 0 THEN 0 ELSE sk * 2 % (SELECT count(*) FROM part) END AS source_method_id, 'Call_' || pk || '(' || qty || ')' AS full_string FROM li",
    "generated_tests": "SELECT id, 2 + sk % 3 AS test_run_id, pk - pk % 2 AS original_method_id, pk - pk % 2 + 1 AS test_method_id, l_orderkey % 5003 AS gen_test_method_id, flag AS provider, status AS model, CASE WHEN l_linenumber % 2 = 1 THEN 'pass@1' ELSE 'pass@5' END AS strategy, qty AS prompt_token_count, price AS generation_duration FROM li",
    "test_results": "SELECT event_id AS id, user_id AS method_id, run_id, CASE event_type WHEN 'purchase' THEN 'Passed' WHEN 'signup' THEN 'pass' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Passed' ELSE 'NotExecuted' END AS test_outcome, value AS test_duration, CASE WHEN event_type = 'error' THEN props END AS error_message FROM events JOIN test_runs t ON t.id = 2 + event_id % 3",
    "lizard_function_code_metrics": "SELECT run_id AS test_run_id, p_partkey AS method_id, (p_size % 12)::BIGINT AS ncss, p_partkey % 5 AS ccn FROM part, test_runs",
    "test_smells": "SELECT * FROM (VALUES " + ", ".join(f"({i + 1}::BIGINT, '{n}')" for i, n in enumerate(SMELLS)) + ") v(id, name)",
    "method_test_smells": "SELECT user_id AS method_id, 1 + event_id % 18 AS test_smell_id, CASE WHEN min(event_id) % 3 = 0 THEN 'Found' ELSE 'Not Found' END AS status FROM events GROUP BY 1, 2",
    "mutants": "SELECT id, sk AS source_file_id, qty AS start_line, l_linenumber % 7 = 0 AS static, CASE flag WHEN 'R' THEN 'Killed' WHEN 'A' THEN 'Survived' ELSE (['Timeout', 'NoCoverage', 'Ignored', 'CompileErrors'])[l_linenumber % 4 + 1] END AS status FROM li",
}


def _with(sql: str, known: dict[str, str]) -> str:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for word in set(re.findall(r"[a-z_]+", todo.pop())) & known.keys() - needed:
            needed.add(word)
            todo.append(known[word])
    ctes = [f"{name} AS ({known[name]})" for name in known if name in needed]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + sql


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the tables (and views ``extra``) that it names, directly or through others, put before it."""
    return _with(sql, DUCKDB | (extra or {}))


def with_repo_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` over the tables of one repository after another, each row with its repository: what a database for each would give."""
    one = {f"one_{name}": re.sub(rf"\b({'|'.join(DUCKDB)})\b", r"one_\1", text) for name, text in DUCKDB.items()}
    parts = []
    for r in range(REPOS):
        shared = {name: f"SELECT * REPLACE ({', '.join(f'{e.format(r=r)} AS {c}' for c, e in changed.items())}) FROM one_{name}" for name, changed in SHARED.items()}
        dealt = {name: f"SELECT * FROM one_{name} WHERE {key} % {REPOS} = {r}" for name, key in DEALT.items()}
        parts.append(f"SELECT 'repo_{r}' AS repo_id, x.* FROM ({_with(sql, one | shared | dealt | (extra or {}))}) x")
    return " UNION ALL ".join(parts)
