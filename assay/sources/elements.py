"""Large report files read in splits: XML by its repeated element, logs by line. No file is one value.

A report is read as text whose record separator is the element's opening, which Spark splits like lines: a record is
one element and what follows it. Elements that can't be parsed are returned as rejects; those around
them aren't touched. Prefixed element names and elements named in comments aren't told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.sources.reports import below

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*"""


def elements(spark: SparkSession, root: str, tag: str, glob: str = "*") -> DataFrame:
    """path (under ``root``), element: the text of each element of a name in the files of a folder. An element around others of its name is its opening tag alone."""
    files = spark.read.option("lineSep", f"<{tag}").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    rows = files.select(below(F.col("_metadata.file_path"), root).alias("path"), "value").where(F.regexp_like("value", F.lit(r"^(\s+[\w:.\-]+\s*=|\s*/?>)")))
    alone = F.regexp_extract("value", rf"(?s)^({_ATTRIBUTES}/>)", 1)
    whole = F.regexp_extract("value", rf"(?s)^(.*?</{tag}\s*>)", 1)
    opening = F.regexp_replace(F.regexp_extract("value", rf"(?s)^({_ATTRIBUTES}>)", 1), r"/?>$", "/>")
    text = F.when(alone != "", alone).when(whole != "", whole).when(opening != "", opening).otherwise(F.col("value"))
    return rows.select("path", F.concat(F.lit(f"<{tag}"), text).alias("element"))


def parsed(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """``elements`` as (path, r: the columns of ``schema``), and the rejects: path, reason, element."""
    got = rows.select("path", "element", F.from_xml("element", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return got.where(~broken).select("path", F.col("r").dropFields("_corrupt_record").alias("r")), got.where(broken).select("path", F.lit("not well-formed").alias("reason"), "element")


def trx_results(spark: SparkSession, root: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """path, test_name, outcome, duration, error_message of the unit test results of all files, and the rejects."""
    rows, rejects = parsed(elements(spark, root, "UnitTestResult", glob), "_testName string, _outcome string, _duration string, Output struct<ErrorInfo:struct<Message:string>>")
    return rows.select(
        "path", F.coalesce("r._testName", F.lit("")).alias("test_name"), F.coalesce("r._outcome", F.lit("")).alias("outcome"), F.coalesce("r._duration", F.lit("00:00:00")).alias("duration"),
        F.nullif("r.Output.ErrorInfo.Message", F.lit("")).alias("error_message"),
    ), rejects


_LINE = "struct<_number:int,_hits:long,`_condition-coverage`:string>"


def coverage_lines(spark: SparkSession, root: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """path, file, line, hits, conditions, conditions_met of the lines of each class in coverage reports, and the rejects. A line without conditions has 0 of 0."""
    rows, rejects = parsed(elements(spark, root, "class", glob), f"_filename string, lines struct<line:array<{_LINE}>>")
    lines = rows.select("path", F.col("r._filename").alias("file"), F.explode("r.lines.line").alias("l"))
    of = lambda i: F.coalesce(F.regexp_extract("l.`_condition-coverage`", r"\((\d+)/(\d+)\)", i).try_cast("int"), F.lit(0))
    return lines.select("path", "file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"), of(2).alias("conditions"), of(1).alias("conditions_met")), rejects


_OPENING = r"""(?s)^[^\s/>]+((?:"[^"]*"|'[^']*'|[^'"<>]++)*+)>"""
_RATED = ("line-rate", "branch-rate", "complexity")
_COUNTED = ("lines-covered", "lines-valid", "branches-covered", "branches-valid", "timestamp")


def _tags(spark: SparkSession, root: str, names: tuple[str, ...], attributes: tuple[str, ...], glob: str) -> DataFrame:
    """file, block (the split's start), place (order in the split), kind, r (the attributes as text; null where not well-formed) of every opening tag of some names. No record is longer than a tag and the text after it."""
    files = spark.read.option("lineSep", "<").option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    kind = F.regexp_extract("value", rf"^(?:[\w.\-]+:)?({'|'.join(names)})(?=[\s/>])", 1)
    rows = files.select(below(F.col("_metadata.file_path"), root).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), kind.alias("kind"), "value").where("kind <> ''")
    plain = F.regexp_replace(F.regexp_extract("value", _OPENING, 1), r"""\s(?:xmlns|[\w.\-]+:[\w.\-]+)\s*=\s*("[^"]*"|'[^']*')|/\s*$""", "")
    tag = F.when(F.regexp_like("value", F.lit(_OPENING)), F.concat(F.lit("<"), "kind", plain, F.lit("/>")))
    shape = ", ".join(f"`_{a}` string" for a in attributes) + ", _corrupt_record string"
    read = rows.select("file", "block", "place", "kind", "value", F.from_xml(tag, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return read.withColumn("r", F.when(F.col("r._corrupt_record").isNull(), F.col("r")))


def cobertura(spark: SparkSession, root: str, glob: str = "*", report: Column | None = None) -> dict[str, DataFrame]:
    """Frames ``reports`` and ``methods`` as ``reports.cobertura`` gives them, of reports of any size, and ``rejects``: tags that can't be read.

    A method stands in the package and class that were opened last. Each split finds its own; what was open at its start comes from one row
    for each split before it. ``report``: a column over ``file`` that names the report; of several files of one report, those in the order of their names go on where the one before ended.
    """
    tagged = lambda *names: _tags(spark, root, names, ("name", "signature", *_RATED, *_COUNTED), glob).withColumn("path", F.col("file") if report is None else report)
    tags = tagged("package", "class", "method")
    good = tags.where("r is not null")
    rates = [S.complexity_value(F.col(f"r.`_{n}`")).alias(n.replace("-", "_")) for n in _RATED]
    named = lambda kind: F.when(F.col("kind") == kind, F.struct(F.col("r._name").alias("name")))
    so_far = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = good.withColumns({f"_{k}": F.last(named(k), ignorenulls=True).over(so_far) for k in ("package", "class")}).where("kind = 'method'")
    levels = tagged("package", "class").where("r is not null").groupBy("file", "block").agg(*(F.max_by(named(k), F.when(F.col("kind") == k, F.col("place"))).alias(f"_last_{k}") for k in ("package", "class")))
    blocks = tags.select("path", "file", "block").distinct().join(levels, ["file", "block"], "left")
    before = Window.partitionBy("path").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    opened = blocks.select("file", "block", *(F.last(f"_last_{k}", ignorenulls=True).over(before).alias(f"_open_{k}") for k in ("package", "class")))
    methods = inside.join(opened, ["file", "block"])
    within = [F.coalesce(f"_{k}", f"_open_{k}")["name"].alias(k) for k in ("package", "class")]
    return {
        "reports": tagged("coverage").where("r is not null").select("path", *rates, *(F.col(f"r.`_{n}`").try_cast("long").alias(n.replace("-", "_")) for n in _COUNTED)),
        "methods": methods.select("path", *within, F.col("r._name").alias("name"), F.col("r._signature").alias("signature"), *rates),
        "rejects": tagged("coverage", "package", "class", "method").where("r is null").select("path", F.lit("not well-formed").alias("reason"), F.concat(F.lit("<"), "value").alias("element")),
    }


def log_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, line of every line of the logs of a folder; large logs in several splits."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root).select(below(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("line"))


def logs_with(lines: DataFrame, found: Column, name: str = "found") -> DataFrame:
    """path, whether any line meets a condition; each task hands on one row a log."""
    return lines.groupBy("path").agg(F.coalesce(F.bool_or(found), F.lit(False)).alias(name))
