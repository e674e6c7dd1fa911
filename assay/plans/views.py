"""The 17 evaluation views as DataFrames over ``Tables``, and as DuckDB SQL for comparison.

The order is topological. One-row and dimension-like sides are left to Catalyst, which
broadcasts what is small enough when the plan runs. ``Tables.scope`` names the columns that tell
repositories apart (none for the tables of one): every join key and grouping holds them, every
view returns them, and each repository has a baseline report of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.plans.registry import query
from assay.sources.adapters import RepoTables, Tables, with_repo_tables, with_tables

PASSED, FAILED = ("Passed", "pass"), ("Failed", "fail", "Error")


def _r(name: str) -> Column:
    """Rounded where the order of summing could show; adding zero turns -0.0 into 0.0."""
    return (F.round(name, 9) + F.lit(0.0)).alias(name)


def baseline_report(t: Tables) -> DataFrame:
    """The latest report of a baseline run (0 or 1 row a repository); of equal times the highest id."""
    runs = t.coverage_reports.where("test_run_id ilike '%baseline%'").groupBy(*t.scope)
    return runs.agg(F.max_by("id", F.struct("timestamp", "id")).alias("id")).where("id is not null")


def _report_coverage(t: Tables, reports: DataFrame) -> DataFrame:
    """Method coverage of ``reports`` (id and more), with their columns but the id."""
    packages = t.package_coverage.selectExpr(*t.scope, "id package_id", "coverage_report_id id")
    classes = t.class_coverage.selectExpr(*t.scope, "id class_coverage_id", "package_coverage_id package_id")
    found = reports.join(packages, [*t.scope, "id"]).drop("id").join(classes, [*t.scope, "package_id"]).drop("package_id")
    return t.method_coverage.select(*t.scope, "class_coverage_id", "method_id", "line_rate", "branch_rate", "complexity").join(found, [*t.scope, "class_coverage_id"]).drop("class_coverage_id")


def method_coverage_agg(t: Tables) -> DataFrame:
    g = t.method_coverage.groupBy(*t.scope, "method_id")
    return g.agg(F.max("line_rate").alias("max_line_rate"), F.max("branch_rate").alias("max_branch_rate"), F.avg("line_rate").alias("avg_line_rate"), F.avg("branch_rate").alias("avg_branch_rate")).select(
        *t.scope, "method_id", "max_line_rate", "max_branch_rate", _r("avg_line_rate"), _r("avg_branch_rate")
    )


def method_coverage_baseline_agg(t: Tables) -> DataFrame:
    rows = _report_coverage(t, baseline_report(t))
    return rows.selectExpr(*t.scope, "method_id", "line_rate max_line_rate", "branch_rate max_branch_rate", "line_rate avg_line_rate", "branch_rate avg_branch_rate")


def _open_rates(t: Tables) -> DataFrame:
    """Rates of methods that aren't covered in full."""
    rates = method_coverage_baseline_agg(t).selectExpr(*t.scope, "method_id id", "max_line_rate line_rate", "max_branch_rate branch_rate")
    return rates.where("(line_rate is not null or branch_rate is not null) and (line_rate != 1 or branch_rate != 1)")


def candidate_covered_methods(t: Tables) -> DataFrame:
    return _with_methods(t, _open_rates(t))


def _with_methods(t: Tables, rates: DataFrame) -> DataFrame:
    classes = t.classes.selectExpr(*t.scope, "id class_id", "name class_name", "file_id")
    files = t.source_files.selectExpr(*t.scope, "id file_id", "analysis_project_id")
    methods = t.methods.selectExpr(*t.scope, "id", "class_id", "name method_name", "full_string method_body")
    rows = methods.join(rates, [*t.scope, "id"]).join(classes, [*t.scope, "class_id"]).join(files, [*t.scope, "file_id"])
    return rows.select(*t.scope, F.col("id").alias("method_id"), "method_name", "method_body", "line_rate", "branch_rate", "class_id", "class_name", "analysis_project_id")


def method_test_mapping(t: Tables) -> DataFrame:
    """Calls from tests (the target) to methods outside test classes (the source)."""
    return _with_tests(t, _test_calls(t))


def _test_calls(t: Tables) -> DataFrame:
    return t.invocations.where("source_method_id != 0").selectExpr(*t.scope, "source_method_id", "target_method_id test_method_id")


def _with_tests(t: Tables, calls: DataFrame) -> DataFrame:
    tests = t.methods.where("is_test_method").selectExpr(*t.scope, "id test_method_id", "name test_method_name", "full_string test_method_body", "class_id test_class_id")
    called = t.methods.selectExpr(*t.scope, "id source_method_id", "class_id callee_class")
    callee = t.classes.where("not is_test_class").selectExpr(*t.scope, "id callee_class")
    home = t.classes.selectExpr(
        *t.scope, "id test_class_id", "name test_class_name", "full_string test_class_body", "testing_framework", "start_line test_class_lin_start", "body_start test_class_body_start",
        "end_line test_class_lin_end", "body_end test_class_body_end", "file_id",
    )
    files = t.source_files.selectExpr(*t.scope, "id file_id", "path test_file_path", "usings test_dependencies", "namespace test_namespace")
    called = called.join(callee, [*t.scope, "callee_class"]).drop("callee_class")
    rows = calls.join(tests, [*t.scope, "test_method_id"]).join(called, [*t.scope, "source_method_id"])
    return rows.join(home, [*t.scope, "test_class_id"]).join(files, [*t.scope, "file_id"]).drop("file_id")


def baseline_uncovered_tested_methods(t: Tables) -> DataFrame:
    """Repeats are merged while rows hold ids and rates only (all else follows from the ids); bodies are joined to what is left."""
    projects = t.analysis_projects.selectExpr(*t.scope, "id analysis_project_id", "solution_id")
    solutions = t.analysis_solutions.selectExpr(*t.scope, "id solution_id", "solution_path solution_file_path")
    tests = _with_tests(t, _test_calls(t).distinct()).withColumnRenamed("source_method_id", "method_id")
    rows = _with_methods(t, _open_rates(t).distinct()).join(tests, [*t.scope, "method_id"])
    rows = rows.join(projects, [*t.scope, "analysis_project_id"], "left").join(solutions, [*t.scope, "solution_id"], "left").drop("analysis_project_id", "solution_id")
    return rows.withColumn("coverage_status", F.lit("Has tests covering method"))


def baseline_coverage(t: Tables) -> DataFrame:
    return _report_coverage(t, baseline_report(t)).selectExpr(*t.scope, "method_id", "line_rate baseline_line_rate", "branch_rate baseline_branch_rate", "complexity baseline_complexity")


def _run_coverage(t: Tables) -> DataFrame:
    """Method coverage of every run's reports."""
    runs = t.test_runs.selectExpr(*t.scope, "id test_run_db_id", "run_id")
    reports = t.coverage_reports.selectExpr(*t.scope, "id", "test_run_id run_id").join(runs, [*t.scope, "run_id"]).drop("run_id")
    return _report_coverage(t, reports)


def gen_test_coverage(t: Tables) -> DataFrame:
    rates = _run_coverage(t).selectExpr(*t.scope, "method_id", "test_run_db_id", "line_rate generated_line_rate", "branch_rate generated_branch_rate", "complexity generated_complexity")
    tests = t.generated_tests.selectExpr(*t.scope, "original_method_id method_id", "test_run_id test_run_db_id", "test_method_id", "gen_test_method_id")
    return tests.join(rates, [*t.scope, "method_id", "test_run_db_id"])


def latest_test_outcome(t: Tables) -> DataFrame:
    runs = t.test_runs.selectExpr(*t.scope, "id test_run_db_id", "run_id")
    return t.test_results.join(runs, [*t.scope, "run_id"]).selectExpr(*t.scope, "test_run_db_id", "method_id test_method_id", "test_outcome", "test_duration", "error_message")


#: The columns that tell the rows of v_test_agg apart.
TEST_KEYS = ("generated_test_id", "test_run_id", "provider", "model", "strategy", "prompt_token_count", "generation_duration", "method_id", "method_name", "class_name", "test_outcome", "test_duration", "error_message")
RATES = tuple(f"{who}_{what}" for what in ("line_rate", "branch_rate", "complexity") for who in ("baseline", "generated"))


def test_agg(t: Tables) -> DataFrame:
    return with_outcomes(t, _rated_tests(t), distinct_outcomes(t), RATES)


def _rated_tests(t: Tables) -> DataFrame:
    """Coverage is averaged by method (and run) before the joins: each row of a test meets the same rates, so the means
    are those of the full join, without its rows growing with the square of the repeats. Ids of tests, methods and classes
    are unique, so with distinct outcomes each group has one row and needs no grouping after the joins."""
    before = baseline_coverage(t).groupBy(*t.scope, "method_id").agg(*(F.avg(c).alias(c) for c in RATES[::2]))
    after = _run_coverage(t).groupBy(*t.scope, "method_id", F.col("test_run_db_id").alias("test_run_id"))
    after = after.agg(*(F.avg(s).alias(g) for s, g in zip(("line_rate", "branch_rate", "complexity"), RATES[1::2])))
    return rated_tests(t, t.generated_tests, before, after)


def distinct_outcomes(t: Tables) -> DataFrame:
    return latest_test_outcome(t).distinct().withColumnRenamed("test_run_db_id", "test_run_id").withColumnRenamed("test_method_id", "gen_test_method_id")


def rated_tests(t: Tables, tests: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Generated tests with their methods and mean rates (by method, and by method and run). Rates are rounded here, once for each mean: a test has as many rows as outcomes."""
    tests = tests.withColumnRenamed("id", "generated_test_id").withColumnRenamed("original_method_id", "method_id").drop("test_method_id")
    before = before.select(*t.scope, "method_id", *(_r(c) for c in RATES[::2]))
    after = after.select(*t.scope, "method_id", "test_run_id", *(_r(c) for c in RATES[1::2]))
    methods = t.methods.selectExpr(*t.scope, "id method_id", "name method_name", "class_id")
    methods = methods.join(t.classes.selectExpr(*t.scope, "id class_id", "name class_name"), [*t.scope, "class_id"]).drop("class_id")
    return tests.join(methods, [*t.scope, "method_id"]).join(before, [*t.scope, "method_id"], "left").join(after, [*t.scope, "method_id", "test_run_id"], "left")


def with_outcomes(t: Tables, rows: DataFrame, outcomes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Rated tests with their distinct outcomes, joined last as they multiply the rows."""
    return rows.join(outcomes, [*t.scope, "gen_test_method_id", "test_run_id"], "left").select(*t.scope, *TEST_KEYS, *values)


def coverage_category(outcome: Column, delta: Column) -> Column:
    passed, failed = outcome.isin(*PASSED), outcome.isin(*FAILED)
    return F.when(passed & (delta > 0), "Approved / Improved Test").when(passed & (delta == 0), "Benign Test").when(failed & (delta > 0), "Candidate Test").otherwise("Failed Test")


def category_color(outcome: Column, delta: Column) -> Column:
    passed, failed = outcome.isin(*PASSED), outcome.isin(*FAILED)
    return F.when(passed & (delta > 0), "green").when(passed & (delta == 0), "gray").when(failed & (delta > 0), "yellow").otherwise("red")


def generated_test_evaluation(t: Tables) -> DataFrame:
    """The delta is rounded before it is compared with zero: the order of summing must not decide. Half of nine digits has ten. A test's deltas are made before it meets its outcomes."""
    gain = lambda what: F.round(F.col(f"generated_{what}") - F.col(f"baseline_{what}"), 9) + F.lit(0.0)
    rows = _rated_tests(t).withColumns({"line_rate_delta": gain("line_rate"), "branch_rate_delta": gain("branch_rate")})
    rows = rows.withColumn("coverage_delta", F.round((F.col("line_rate_delta") + F.col("branch_rate_delta")) / 2, 10) + F.lit(0.0))
    rows = with_outcomes(t, rows, distinct_outcomes(t), (*RATES, "line_rate_delta", "branch_rate_delta", "coverage_delta"))
    judged = (F.col("test_outcome"), F.col("coverage_delta"))
    return rows.withColumns({"evaluation_category": coverage_category(*judged), "ui_color": category_color(*judged)})


def guarded_ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part).cast("double") / F.col(whole), 9))


def lizard_test_metric_comparison(t: Tables) -> DataFrame:
    """The run's name is joined first; repeated metrics of a (run, method) repeat the row, as in the report tables."""
    m = t.lizard_function_code_metrics
    side = lambda who: m.selectExpr(*t.scope, "test_run_id run_id", f"method_id {who}_test_method_id", f"ncss {who}_ncss", f"ccn {who}_ccn")
    rows = t.generated_tests.selectExpr(*t.scope, "id generated_test_id", "test_run_id", "test_method_id baseline_test_method_id", "gen_test_method_id generated_test_method_id")
    rows = rows.join(t.test_runs.selectExpr(*t.scope, "id test_run_id", "run_id"), [*t.scope, "test_run_id"], "left")
    rows = rows.join(side("baseline"), [*t.scope, "run_id", "baseline_test_method_id"], "left").join(side("generated"), [*t.scope, "run_id", "generated_test_method_id"], "left").drop("run_id")
    return rows.withColumns({f"{k}_delta": F.col(f"generated_{k}") - F.col(f"baseline_{k}") for k in ("ncss", "ccn")} | {f"{k}_ratio": guarded_ratio(f"generated_{k}", f"baseline_{k}") for k in ("ncss", "ccn")})


def test_smell_ratio(t: Tables) -> DataFrame:
    counts = t.method_test_smells.groupBy(*t.scope, "method_id").agg(F.count_if(F.col("status") == "Found").alias("smells_found"), F.count_if(F.col("status") == "Not Found").alias("smells_not_found"), F.count(F.lit(1)).alias("total_smells"))
    return counts.withColumn("smell_ratio", guarded_ratio("smells_found", "total_smells"))


def smell_comparison(t: Tables) -> DataFrame:
    side = lambda who: test_smell_ratio(t).selectExpr(*t.scope, f"method_id {who}_test_method_id", f"smells_found {who}_smells_found", f"total_smells {who}_total_smells", f"smell_ratio {who}_smell_ratio")
    rows = t.generated_tests.selectExpr(*t.scope, "id generated_test_id", "test_run_id", "test_method_id baseline_test_method_id", "gen_test_method_id generated_test_method_id")
    rows = rows.join(side("baseline"), [*t.scope, "baseline_test_method_id"], "left").join(side("generated"), [*t.scope, "generated_test_method_id"], "left")
    return rows.withColumn("smell_ratio_delta", F.round(F.col("generated_smell_ratio") - F.col("baseline_smell_ratio"), 9) + F.lit(0.0))


_COUNTS = ("lines_covered", "lines_valid", "branches_covered", "branches_valid")


def project_baseline_coverage(t: Tables) -> DataFrame:
    return t.coverage_reports.join(baseline_report(t), [*t.scope, "id"]).selectExpr(*t.scope, "id coverage_report_id", "test_run_id", "line_rate baseline_line_rate", "branch_rate baseline_branch_rate", *_COUNTS, "complexity baseline_complexity")


def project_generated_coverage(t: Tables) -> DataFrame:
    runs = t.test_runs.selectExpr(*t.scope, "id test_run_db_id", "run_id test_run_id")
    return t.coverage_reports.where("test_run_id not ilike '%baseline%'").join(runs, [*t.scope, "test_run_id"]).selectExpr(*t.scope, "id coverage_report_id", "test_run_db_id", "test_run_id", "line_rate generated_line_rate", "branch_rate generated_branch_rate", *_COUNTS, "complexity generated_complexity")


def project_coverage_comparison(t: Tables) -> DataFrame:
    """Each generated report against the repository's one baseline report; without a baseline there is nothing to compare."""
    base = project_baseline_coverage(t).selectExpr(*t.scope, "baseline_line_rate", "baseline_branch_rate", "baseline_complexity", "lines_covered base_lines", "branches_covered base_branches")
    rows = project_generated_coverage(t)
    rows = rows.join(base, list(t.scope)) if t.scope else rows.crossJoin(F.broadcast(base))  # one row at most
    deltas = {f"{k}_delta": F.round(F.col(f"generated_{k}") - F.col(f"baseline_{k}"), 9) + F.lit(0.0) for k in ("line_rate", "branch_rate", "complexity")}
    rows = rows.withColumns(deltas | {"lines_covered_delta": F.col("lines_covered") - F.col("base_lines"), "branches_covered_delta": F.col("branches_covered") - F.col("base_branches")})
    return rows.drop(*_COUNTS, "base_lines", "base_branches", "test_run_id")


def _cov(reports: str, keep: str = "") -> str:
    return f"FROM ({reports}) r JOIN package_coverage p ON p.coverage_report_id = r.id JOIN class_coverage c ON c.package_coverage_id = p.id JOIN method_coverage m ON m.class_coverage_id = c.id{keep}"


def _round(expr: str) -> str:
    return f"round({expr}, 9) + 0.0::DOUBLE"


_MEAN = ", ".join(f"{_round(f'avg({c})')} AS {c}" for c in RATES)
_DELTA = "round((line_rate_delta + branch_rate_delta) / 2, 10) + 0.0::DOUBLE"
_PASS, _FAIL = "test_outcome IN ('Passed', 'pass')", "test_outcome IN ('Failed', 'fail', 'Error')"
#: The views in DuckDB SQL, each written over the tables and views before it.
VIEW_SQL = {
    "v_baseline_report": "SELECT id FROM coverage_reports WHERE test_run_id ILIKE '%baseline%' ORDER BY timestamp DESC, id DESC LIMIT 1",
    "v_method_coverage_agg": f"SELECT method_id, max(line_rate) AS max_line_rate, max(branch_rate) AS max_branch_rate, {_round('avg(line_rate)')} AS avg_line_rate, {_round('avg(branch_rate)')} AS avg_branch_rate FROM method_coverage GROUP BY method_id",
    "v_method_coverage_baseline_agg": f"SELECT m.method_id, m.line_rate AS max_line_rate, m.branch_rate AS max_branch_rate, m.line_rate AS avg_line_rate, m.branch_rate AS avg_branch_rate {_cov('SELECT * FROM v_baseline_report')}",
    "v_candidate_covered_methods": "SELECT m.id AS method_id, m.name AS method_name, m.full_string AS method_body, a.max_line_rate AS line_rate, a.max_branch_rate AS branch_rate, c.id AS class_id, c.name AS class_name, f.analysis_project_id FROM v_method_coverage_baseline_agg a JOIN methods m ON m.id = a.method_id JOIN classes c ON c.id = m.class_id JOIN source_files f ON f.id = c.file_id WHERE (a.max_line_rate IS NOT NULL OR a.max_branch_rate IS NOT NULL) AND (a.max_line_rate <> 1 OR a.max_branch_rate <> 1)",
    "v_method_test_mapping": "SELECT i.source_method_id, t.id AS test_method_id, t.name AS test_method_name, t.full_string AS test_method_body, tc.id AS test_class_id, tc.name AS test_class_name, tc.full_string AS test_class_body, tc.testing_framework, tc.start_line AS test_class_lin_start, tc.body_start AS test_class_body_start, tc.end_line AS test_class_lin_end, tc.body_end AS test_class_body_end, f.path AS test_file_path, f.usings AS test_dependencies, f.namespace AS test_namespace FROM invocations i, methods t, methods s, classes tc, classes sc, source_files f WHERE i.source_method_id <> 0 AND t.id = i.target_method_id AND t.is_test_method AND s.id = i.source_method_id AND tc.id = t.class_id AND sc.id = s.class_id AND NOT sc.is_test_class AND f.id = tc.file_id",
    "v_baseline_uncovered_tested_methods": "SELECT DISTINCT c.* EXCLUDE (analysis_project_id), 'Has tests covering method' AS coverage_status, t.* EXCLUDE (source_method_id), s.solution_path AS solution_file_path FROM v_candidate_covered_methods c JOIN v_method_test_mapping t ON t.source_method_id = c.method_id LEFT JOIN analysis_projects p ON p.id = c.analysis_project_id LEFT JOIN analysis_solutions s ON s.id = p.solution_id",
    "v_baseline_coverage": f"SELECT m.method_id, m.line_rate AS baseline_line_rate, m.branch_rate AS baseline_branch_rate, m.complexity AS baseline_complexity {_cov('SELECT * FROM v_baseline_report')}",
    "v_gen_test_coverage": f"SELECT g.original_method_id AS method_id, g.test_method_id, g.gen_test_method_id, g.test_run_id AS test_run_db_id, x.line_rate AS generated_line_rate, x.branch_rate AS generated_branch_rate, x.complexity AS generated_complexity FROM generated_tests g JOIN (SELECT r.run, m.* {_cov('SELECT o.id, t.id AS run FROM coverage_reports o JOIN test_runs t ON t.run_id = o.test_run_id')}) x ON x.run = g.test_run_id AND x.method_id = g.original_method_id",
    "v_latest_test_outcome": "SELECT t.id AS test_run_db_id, r.method_id AS test_method_id, r.test_outcome, r.test_duration, r.error_message FROM test_results r JOIN test_runs t USING (run_id)",
    "v_test_agg": f"SELECT g.id AS generated_test_id, g.test_run_id, provider, model, strategy, prompt_token_count, generation_duration, m.id AS method_id, m.name AS method_name, c.name AS class_name, test_outcome, test_duration, error_message, {_MEAN} FROM generated_tests g JOIN methods m ON m.id = g.original_method_id JOIN classes c ON c.id = m.class_id LEFT JOIN v_baseline_coverage b ON b.method_id = m.id LEFT JOIN (SELECT DISTINCT method_id, test_run_db_id, generated_line_rate, generated_branch_rate, generated_complexity, k FROM (SELECT *, row_number() OVER (PARTITION BY method_id, test_run_db_id, test_method_id, gen_test_method_id, generated_line_rate, generated_branch_rate, generated_complexity) AS k FROM v_gen_test_coverage)) x ON x.method_id = m.id AND x.test_run_db_id = g.test_run_id LEFT JOIN v_latest_test_outcome o ON o.test_method_id = g.gen_test_method_id AND o.test_run_db_id = g.test_run_id GROUP BY ALL",
    "v_generated_test_evaluation": f"SELECT *, {_DELTA} AS coverage_delta, CASE WHEN {_PASS} AND {_DELTA} > 0 THEN 'Approved / Improved Test' WHEN {_PASS} AND {_DELTA} = 0 THEN 'Benign Test' WHEN {_FAIL} AND {_DELTA} > 0 THEN 'Candidate Test' ELSE 'Failed Test' END AS evaluation_category, CASE WHEN {_PASS} AND {_DELTA} > 0 THEN 'green' WHEN {_PASS} AND {_DELTA} = 0 THEN 'gray' WHEN {_FAIL} AND {_DELTA} > 0 THEN 'yellow' ELSE 'red' END AS ui_color FROM (SELECT *, {_round('generated_line_rate - baseline_line_rate')} AS line_rate_delta, {_round('generated_branch_rate - baseline_branch_rate')} AS branch_rate_delta FROM v_test_agg)",
    "v_lizard_test_metric_comparison": "SELECT g.id AS generated_test_id, g.test_run_id, g.test_method_id AS baseline_test_method_id, b.ncss AS baseline_ncss, b.ccn AS baseline_ccn, g.gen_test_method_id AS generated_test_method_id, n.ncss AS generated_ncss, n.ccn AS generated_ccn, n.ncss - b.ncss AS ncss_delta, n.ccn - b.ccn AS ccn_delta, CASE WHEN b.ncss > 0 THEN round(n.ncss::DOUBLE / b.ncss, 9) END AS ncss_ratio, CASE WHEN b.ccn > 0 THEN round(n.ccn::DOUBLE / b.ccn, 9) END AS ccn_ratio FROM generated_tests g LEFT JOIN test_runs t ON t.id = g.test_run_id LEFT JOIN lizard_function_code_metrics b ON b.method_id = g.test_method_id AND b.test_run_id = t.run_id LEFT JOIN lizard_function_code_metrics n ON n.method_id = g.gen_test_method_id AND n.test_run_id = t.run_id",
    "v_test_smell_ratio": "SELECT method_id, count(*) FILTER (WHERE status = 'Found') AS smells_found, count(*) FILTER (WHERE status = 'Not Found') AS smells_not_found, count(*) AS total_smells, round(count(*) FILTER (WHERE status = 'Found')::DOUBLE / count(*), 9) AS smell_ratio FROM method_test_smells GROUP BY method_id",
    "v_generated_vs_baseline_smell_comparison": f"SELECT g.id AS generated_test_id, g.test_run_id, g.test_method_id AS baseline_test_method_id, b.smells_found AS baseline_smells_found, b.total_smells AS baseline_total_smells, b.smell_ratio AS baseline_smell_ratio, g.gen_test_method_id AS generated_test_method_id, n.smells_found AS generated_smells_found, n.total_smells AS generated_total_smells, n.smell_ratio AS generated_smell_ratio, {_round('n.smell_ratio - b.smell_ratio')} AS smell_ratio_delta FROM generated_tests g LEFT JOIN v_test_smell_ratio b ON b.method_id = g.test_method_id LEFT JOIN v_test_smell_ratio n ON n.method_id = g.gen_test_method_id",
    "v_project_baseline_coverage": "SELECT r.id AS coverage_report_id, test_run_id, line_rate AS baseline_line_rate, branch_rate AS baseline_branch_rate, lines_covered, lines_valid, branches_covered, branches_valid, complexity AS baseline_complexity FROM coverage_reports r JOIN v_baseline_report b USING (id)",
    "v_project_generated_coverage": "SELECT r.id AS coverage_report_id, t.id AS test_run_db_id, r.test_run_id, line_rate AS generated_line_rate, branch_rate AS generated_branch_rate, lines_covered, lines_valid, branches_covered, branches_valid, complexity AS generated_complexity FROM coverage_reports r JOIN test_runs t ON t.run_id = r.test_run_id WHERE r.test_run_id NOT ILIKE '%baseline%'",
    "v_project_coverage_comparison": f"SELECT g.test_run_db_id, g.coverage_report_id, baseline_line_rate, baseline_branch_rate, baseline_complexity, generated_line_rate, generated_branch_rate, generated_complexity, {_round('generated_line_rate - baseline_line_rate')} AS line_rate_delta, {_round('generated_branch_rate - baseline_branch_rate')} AS branch_rate_delta, {_round('generated_complexity - baseline_complexity')} AS complexity_delta, g.lines_covered - b.lines_covered AS lines_covered_delta, g.branches_covered - b.branches_covered AS branches_covered_delta FROM v_project_generated_coverage g, v_project_baseline_coverage b",
}
VIEWS = {
    "v_baseline_report": baseline_report,
    "v_method_coverage_agg": method_coverage_agg,
    "v_method_coverage_baseline_agg": method_coverage_baseline_agg,
    "v_candidate_covered_methods": candidate_covered_methods,
    "v_method_test_mapping": method_test_mapping,
    "v_baseline_uncovered_tested_methods": baseline_uncovered_tested_methods,
    "v_baseline_coverage": baseline_coverage,
    "v_gen_test_coverage": gen_test_coverage,
    "v_latest_test_outcome": latest_test_outcome,
    "v_test_agg": test_agg,
    "v_generated_test_evaluation": generated_test_evaluation,
    "v_lizard_test_metric_comparison": lizard_test_metric_comparison,
    "v_test_smell_ratio": test_smell_ratio,
    "v_generated_vs_baseline_smell_comparison": smell_comparison,
    "v_project_baseline_coverage": project_baseline_coverage,
    "v_project_generated_coverage": project_generated_coverage,
    "v_project_coverage_comparison": project_coverage_comparison,
}

for _name, _view in VIEWS.items():
    query(_name, with_tables(f"SELECT * FROM {_name}", VIEW_SQL))(lambda spark, sf_dir, view=_view: view(Tables(spark, sf_dir)))
    query(f"repo_{_name}", with_repo_tables(f"SELECT * FROM {_name}", VIEW_SQL))(lambda spark, sf_dir, view=_view: view(RepoTables(spark, sf_dir)))
