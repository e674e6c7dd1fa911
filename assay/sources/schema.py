"""The warehouse's 24 tables: types, keys, references, and their creation with the seed rows.

Every table begins with ``repo_id`` (it stands in for one database a repository) and ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from assay.sources.adapters import SMELLS

_PLACE = "location_start_lin_no int, location_body_start int, location_body_end int, location_end_lin_no int"
_RATES = "line_rate double, branch_rate double, complexity int"

#: The columns after ``repo_id`` and ``id``.
COLUMNS = {
    "projects": "owner string not null, repo_name string not null, directory_path string not null, web_url string, database_path string, last_analyzed_commit string, content_hash string, created_at timestamp",
    "analysis_solutions": "project_id bigint not null, guid string not null, solution_path string not null, content_hash string",
    "analysis_projects": "solution_id bigint not null, guid string not null, project_path string not null, target_framework string, content_hash string",
    "source_files": "analysis_project_id bigint not null, guid string not null, namespace string, name string, language string, meta_data string, usings string, path string, content_hash string",
    "imports": "file_id bigint not null, guid string not null, import_name string not null, import_path string not null, full_string string, is_local boolean",
    "classes": f"file_id bigint not null, guid string not null, name string not null, visibility string, modifiers string, attributes string, full_string string, doc_string string, is_test_class boolean, testing_framework string, {_PLACE}, content_hash string",
    "methods": f"class_id bigint not null, guid string not null, name string not null, visibility string, modifiers string, attributes string, full_string string, doc_string string, is_test_method boolean, is_generated boolean, testing_framework string, test_type string, {_PLACE}, content_hash string",
    "invocations": f"target_method_id bigint not null, source_method_id bigint not null, guid string not null, is_assertion boolean, full_string string, content_hash string, {_PLACE}",
    "properties": f"class_id bigint not null, guid string not null, name string not null, visibility string, modifiers string, attributes string, full_string string, content_hash string, {_PLACE}",
    "test_runs": "run_id string, run_date string not null, result string not null, coverage int, log_path string, error string, report string",
    "test_results": "method_id bigint not null, run_id string, run_date string, test_name string, test_outcome string, test_duration string, error_message string",
    "generated_tests": "test_run_id bigint not null, original_method_id bigint not null, test_method_id bigint not null, gen_test_method_id bigint not null, filepath string, provider string, model string, strategy string, prompt_token_count int, generation_duration bigint",
    "coverage_reports": f"test_run_id string, timestamp bigint, {_RATES}, lines_covered int, lines_valid int, branches_covered int, branches_valid int, full_report_xml string",
    "mutation_reports": "test_run_id string, timestamp bigint, project_root string, schema_version string, full_report_json string",
    "file_mutation_result": "mutation_report_id bigint, source_file_id bigint, language string, mutation_score double",
    "mutants": "file_mutation_result_id bigint, method_id bigint, mutant_id string, mutator_name string, replacement string, start_line int, start_column int, end_line int, end_column int, status string, status_reason string, static_status string",
    "mutant_test_map": "mutant_id bigint not null, test_method_id bigint not null, interaction_type string not null",
    "lizard_file_code_metrics": "test_run_id string, file_id bigint, ncss int, ccn int, function_count int",
    "lizard_function_code_metrics": "test_run_id string, method_id bigint, ncss int, ccn int",
    "test_smells": "name string not null, description string",
    "method_test_smells": "method_id bigint not null, test_smell_id bigint not null, status string not null",
    "package_coverage": f"coverage_report_id bigint not null, name string not null, {_RATES}",
    "class_coverage": f"package_coverage_id bigint not null, class_id bigint not null, name string not null, {_RATES}",
    "method_coverage": f"class_coverage_id bigint not null, method_id bigint not null, name string not null, {_RATES}",
}

#: By which columns, beside ``repo_id``, a row counts as there already; tables not named only grow.
KEYS = {
    "projects": ["content_hash"], "analysis_solutions": ["content_hash"], "analysis_projects": ["content_hash"], "source_files": ["content_hash"], "imports": ["import_name", "import_path", "is_local"],
    "classes": ["content_hash"], "methods": ["content_hash"], "invocations": ["content_hash"], "properties": ["content_hash"], "coverage_reports": ["test_run_id"], "test_smells": ["name"],
    "method_test_smells": ["method_id", "test_smell_id"], "package_coverage": ["coverage_report_id", "name"], "class_coverage": ["package_coverage_id", "name"], "method_coverage": ["class_coverage_id", "name"],
}

#: The seed has no repository of its own.
ALL_REPOS = ""


def ddl(table: str) -> str:
    return f"repo_id string not null, id bigint not null, {COLUMNS[table]}"


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(ddl(table))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def create(spark: SparkSession, root: str) -> None:
    """Write the tables that aren't there yet, empty but for the kinds of smell; those that are stay as they are.

    A table counts as there once its first job was committed: what a lost driver left half written is written again.
    """
    for table in COLUMNS:
        if not _there(spark, f"{root}/{table}"):
            seed = [(ALL_REPOS, i + 1, name, None) for i, name in enumerate(SMELLS)] if table == "test_smells" else []
            spark.createDataFrame(seed, schema_of(table)).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schema_of(table)).parquet(f"{root}/{table}")
