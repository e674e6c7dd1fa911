"""Reports to rows: test results, coverage, mutation, complexity and smell reports, project files, logs.

Each function takes a frame with ``path`` and ``content`` (one row per file, see ``read_files``) and
returns typed rows; parsing is by Spark's own XML and JSON functions. Malformed files give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import scalars as S


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of every matching file under a folder, of any depth. Spark leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) of every matching file under a folder, of any depth, from the folder on; no content is read. Spark leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(below(F.col("path"), root).alias("path"))


def below(path, root: str):
    """The part of a file's path under ``root``, whose last name stands once in the path."""
    return F.substring_index(path, "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)


def without_namespaces(content):
    """XML text without namespace declarations, prefixes of tags, and document type."""
    text = F.regexp_replace(content, r"<!DOCTYPE[^>]*>", "")
    text = F.regexp_replace(text, r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(text, r"<(/?)\w+:", "<$1")


_TEXT = "array<string>"


def _elements(content, tag: str):
    """The texts of all elements of a name, self-closing ones included, wherever they stand."""
    return F.regexp_extract_all(content, F.lit(rf"(?s)(<{tag}\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*?/>|<{tag}\b.*?</{tag}\s*>)"), F.lit(1))


_RESULT = "_testName string, _outcome string, _duration string, ErrorInfo struct<Message:string>, Output struct<ErrorInfo:struct<Message:string>>"


def trx(files: DataFrame) -> DataFrame:
    """path, test_name, outcome, duration, error_message of every unit test result; missing attributes have defaults. A result is parsed once; those that aren't well-formed give no rows."""
    rows = files.select("path", F.explode(_elements(without_namespaces(F.col("content")), "UnitTestResult")).alias("x"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}
    rows = rows.select("path", F.from_xml("x", f"{_RESULT}, _corrupt_record string", options).alias("r")).where("r is not null and r._corrupt_record is null")
    get = lambda name: F.coalesce(f"r._{name}", F.lit(""))
    return rows.select(
        "path", get("testName").alias("test_name"), get("outcome").alias("outcome"), F.when(get("duration") == "", "00:00:00").otherwise(get("duration")).alias("duration"),
        F.nullif(F.coalesce("r.Output.ErrorInfo.Message", "r.ErrorInfo.Message"), F.lit("")).alias("error_message"),
    )


_RATES = "`_line-rate` string, `_branch-rate` string, `_complexity` string"
_METHOD = f"struct<_name:string,_signature:string,{_RATES.replace(' string', ':string')}>"
_CLASS = f"struct<_name:string,_filename:string,{_RATES.replace(' string', ':string')},methods:struct<method:array<{_METHOD}>>>"
_PACKAGE = f"struct<_name:string,{_RATES.replace(' string', ':string')},classes:struct<class:array<{_CLASS}>>>"
_COBERTURA = f"{_RATES}, `_lines-covered` long, `_lines-valid` long, `_branches-covered` long, `_branches-valid` long, _timestamp long, packages struct<package:array<{_PACKAGE}>>"


def _number(column):
    return S.complexity_value(column)


def cobertura(files: DataFrame) -> dict[str, DataFrame]:
    """Frames ``reports``, ``packages``, ``classes`` and ``methods``; numbers that can't be read are 0."""
    tree = files.select("path", F.from_xml(without_namespaces(F.col("content")), _COBERTURA).alias("r")).where("r is not null")
    rates = lambda p: [_number(F.col(f"{p}.`_{n}`")).alias(n.replace("-", "_")) for n in ("line-rate", "branch-rate", "complexity")]
    counts = [F.col(f"r.`_{n}`").alias(n.replace("-", "_")) for n in ("lines-covered", "lines-valid", "branches-covered", "branches-valid", "timestamp")]
    packages = tree.select("path", F.explode("r.packages.package").alias("p"))
    classes = packages.select("path", F.col("p._name").alias("package"), F.explode("p.classes.class").alias("c"))
    methods = classes.select("path", "package", F.col("c._name").alias("class"), F.explode("c.methods.method").alias("m"))
    return {
        "reports": tree.select("path", *rates("r"), *counts),
        "packages": packages.select("path", F.col("p._name").alias("name"), *rates("p")),
        "classes": classes.select("path", "package", F.col("c._name").alias("name"), F.col("c._filename").alias("filename"), *rates("c")),
        "methods": methods.select("path", "package", "class", F.col("m._name").alias("name"), F.col("m._signature").alias("signature"), *rates("m")),
    }


_POINT = "struct<line:int,column:int>"
_MUTANT = f"struct<id:string,mutatorName:string,replacement:string,location:struct<start:{_POINT},end:{_POINT}>,status:string,statusReason:string,static:boolean,coveredBy:array<string>,killedBy:array<string>>"
_MUTATION = f"schemaVersion string, projectRoot string, files map<string,struct<language:string,source:string,mutants:array<{_MUTANT}>>>, testFiles map<string,struct<tests:array<struct<id:string,name:string>>>>"


def mutation(files: DataFrame) -> dict[str, DataFrame]:
    """Frames ``files``, ``mutants`` and ``coverage`` (mutant, test name, interaction). Test ids without a name are left out; of repeated ids the first name in order counts."""
    tree = files.select("path", F.from_json("content", _MUTATION).alias("r")).where("r is not null")
    each = tree.select("path", F.explode("r.files").alias("file", "f"))
    mutants = each.select("path", "file", F.explode("f.mutants").alias("m"))
    tests = tree.select("path", F.explode("r.testFiles").alias("test_file", "t")).select("path", F.explode("t.tests").alias("t")).groupBy("path", F.col("t.id").alias("test_id")).agg(F.min("t.name").alias("test_name"))
    kinds = F.array(*(F.struct(F.lit(k).alias("interaction_type"), F.coalesce(F.col(f"m.{c}"), F.array().cast(_TEXT)).alias("ids")) for k, c in (("CoveredBy", "coveredBy"), ("KilledBy", "killedBy"))))
    met = mutants.select("path", "file", F.col("m.id").alias("mutant_id"), F.explode(kinds).alias("k")).select("path", "file", "mutant_id", "k.interaction_type", F.explode("k.ids").alias("test_id"))
    return {
        "files": each.select("path", "file", "f.language", F.coalesce(F.size("f.mutants"), F.lit(0)).alias("n_mutants")),
        "mutants": mutants.select(
            "path", "file", F.col("m.id").alias("mutant_id"), F.col("m.mutatorName").alias("mutator_name"), "m.replacement", F.col("m.location.start.line").alias("start_line"), F.col("m.location.start.column").alias("start_column"),
            F.col("m.location.end.line").alias("end_line"), F.col("m.location.end.column").alias("end_column"), "m.status", F.col("m.statusReason").alias("status_reason"), F.coalesce("m.static", F.lit(False)).alias("static"),
        ),
        "coverage": met.join(tests, ["path", "test_id"]).select("path", "file", "mutant_id", "test_name", "interaction_type"),
    }


def _items(files: DataFrame, kind: str) -> DataFrame:
    """Items of the first measure of a kind: name and whole-number values."""
    measures = F.filter(_elements(F.col("content"), "measure"), lambda m: F.regexp_like(m, F.lit(rf"^<measure\b[^>]*\btype\s*=\s*[\"']{kind}[\"']")))
    rows = files.select("path", F.explode(_elements(F.get(measures, F.lit(0)), "item")).alias("x"))
    values = F.transform(F.xpath("x", F.lit("/item/value/text()")), lambda v: F.trim(v).try_cast("int"))
    return rows.select("path", F.xpath_string("x", F.lit("/item/@name")).alias("name"), values.alias("v")).where("trim(name) <> ''")


def lizard_functions(files: DataFrame) -> DataFrame:
    """function, file, line, ncss, ccn: the name is cut at the last " at ", the place at its last colon."""
    where = F.regexp_extract("name", r"^.* at (.*):(\d+)$", 1)
    line = F.regexp_extract("name", r"^.* at (.*):(\d+)$", 2)
    rows = _items(files, "Function").where(F.size("v") >= 3).where(line != "")
    return rows.select("path", F.regexp_extract("name", r"^(.*) at .*:\d+$", 1).alias("function"), where.alias("file"), line.cast("int").alias("line"), F.get("v", F.lit(1)).alias("ncss"), F.get("v", F.lit(2)).alias("ccn"))


def lizard_files(files: DataFrame) -> DataFrame:
    return _items(files, "File").where(F.size("v") >= 4).select("path", F.col("name").alias("file"), F.get("v", F.lit(1)).alias("ncss"), F.get("v", F.lit(2)).alias("ccn"), F.get("v", F.lit(3)).alias("function_count"))


def smell_json(files: DataFrame) -> DataFrame:
    """class, method, smell, status, first of a (class, method, smell). Keys are read in any case."""
    lower = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r'(?i)"name"\s*:', '"name":'), r'(?i)"methods"\s*:', '"methods":'), r'(?i)"smells"\s*:', '"smells":'), r'(?i)"status"\s*:', '"status":'), r'(?i)"message"\s*:', '"message":')
    shape = "array<struct<name:string,message:string,methods:array<struct<name:string,smells:array<struct<name:string,status:string>>>>>>"
    rows = files.select("path", F.posexplode(F.from_json(lower, shape)).alias("i", "c")).select("path", "i", F.col("c.name").alias("class"), F.posexplode("c.methods").alias("j", "m"))
    rows = rows.select("path", "i", "j", "class", F.col("m.name").alias("method"), F.posexplode("m.smells").alias("k", "s"))
    return rows.groupBy("path", "class", "method", F.col("s.name").alias("smell")).agg(F.min_by("s.status", F.struct("i", "j", "k")).alias("status"))


def targets(lines: DataFrame) -> DataFrame:
    """url, owner, repo of a text file's lines (column value)."""
    path = F.split(F.parse_url(F.trim("value"), F.lit("PATH")), "/")
    return lines.where("trim(value) <> ''").select(F.trim("value").alias("url"), F.get(path, F.lit(1)).alias("owner"), F.get(path, F.lit(2)).alias("repo"))


def global_sdk(files: DataFrame) -> DataFrame:
    """One row: the SDK version of the first global.json (by path) that has one, or null."""
    rows = files.select("path", F.get_json_object("content", "$.sdk.version").alias("version")).where("coalesce(version, '') <> ''")
    return rows.agg(F.min_by("version", "path").alias("version"))


def target_frameworks(projects: DataFrame, sdk: DataFrame | None = None) -> DataFrame:
    """path, target_framework: the global SDK if there is one, else TargetFramework, else the first of TargetFrameworks."""
    clean = projects.select("path", without_namespaces(F.col("content")).alias("x"))
    own = F.coalesce(F.nullif(F.trim(F.regexp_extract("x", r"<TargetFramework>\s*([^<]*)<", 1)), F.lit("")), F.nullif(F.trim(F.split(F.regexp_extract("x", r"<TargetFrameworks>\s*([^<]*)<", 1), ";")[0]), F.lit("")), F.lit(""))
    rows = clean.select("path", own.alias("own"))
    if sdk is not None:
        return rows.crossJoin(sdk).select("path", F.coalesce("version", "own").alias("target_framework"))  # one row
    return rows.select("path", F.col("own").alias("target_framework"))


def project_references(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Projects named in a listing's lines (``- a/b/c.csproj``) without their first two segments, if such a file exists (``files``: path)."""
    rows = listing.select(F.regexp_extract("value", r"-\s+(.+\.csproj)", 1).alias("ref")).where("ref <> ''")
    parts = F.split(F.replace("ref", F.lit("\\"), F.lit("/")), "/")
    rows = rows.select(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/").alias("path")).distinct()
    return rows.join(files.select("path"), "path", "left_semi")


def source_files(files: DataFrame) -> DataFrame:
    """Sources without generated ones."""
    generated = F.lit(False)
    for end in (".g.cs", "AssemblyAttributes.cs", "AssemblyInfo.cs"):
        generated = generated | F.endswith("path", F.lit(end))
    return files.where(F.endswith("path", F.lit(".cs")) & ~generated)


def logs_of(files: DataFrame, repo: str) -> DataFrame:
    """Logs whose file name holds the repository's name and docker, in any case."""
    name = S.path_tail(F.col("path"))
    return files.where(F.contains(F.lower(name), F.lit(repo.lower())) & F.contains(F.lower(name), F.lit("docker")) & F.endswith(F.lower(name), F.lit(".log")))


def likely_tested(tree: DataFrame) -> DataFrame:
    """repo, has_tests: any path that contains test."""
    return tree.groupBy("repo").agg(F.coalesce(F.bool_or(F.col("path").ilike("%test%")), F.lit(False)).alias("has_tests"))
