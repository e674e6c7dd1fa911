"""Binding report rows to entities: deduplication by hash or key, and lookups of which the lowest id wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from assay.operators.contained import matched


def first_of(df: DataFrame, keys: list[str], order: str, columns: list[str] | None = None) -> DataFrame:
    """For each key the row that comes first; partial aggregation, no sort of a key's rows."""
    rest = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def insert_if_absent(incoming: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``incoming`` whose key is new: the first of each key, without keys that exist."""
    return first_of(incoming, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def surviving_ids(incoming: DataFrame, stored: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Each incoming id with the stored row's id (the lowest) of its key."""
    least = stored.groupBy(*keys).agg(F.min(id_col).alias("surviving_id"))
    return incoming.select(id_col, *keys).join(least, keys).select(id_col, "surviving_id")


def surrogate_ids(df: DataFrame, key: str, after: Column | int = 0, width: int = 65_536, name: str = "surrogate_id") -> DataFrame:
    """Consecutive ids in the order of a whole-number key (then of the row), after the highest that exists.

    Keys are counted by ranges of ``width``; only the ranges' counts are ordered in one place.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = ranged.groupBy("_range").count()
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key, F.xxhash64(*df.columns)))
    after = after if isinstance(after, Column) else F.lit(after)
    return ranged.join(starts, "_range").withColumn(name, after + F.col("_start") + place).drop("_range", "_start")


def lookup(rows: DataFrame, entities: DataFrame, keys: list[str], id_col: str = "id", out: str = "found_id") -> DataFrame:
    """Left join to the lowest id of each key; null where there is none."""
    return rows.join(entities.groupBy(*keys).agg(F.min(id_col).alias(out)), keys, "left")


def like_any(text: Column, part: Column) -> Column:
    """text LIKE %part% without case; _ and % in the part are wildcards, a backslash is itself."""
    pattern = F.concat(F.lit("%"), F.replace(F.lower(part), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.call_function("like", F.lower(text), pattern)


#: Characters of the pieces by which texts and names are brought together.
GRAM = 4


def _grams(runs: Column) -> Column:
    pieces = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - (GRAM - 1)), lambda i: F.substring(r, i, F.lit(GRAM)))
    return F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: F.char_length(r) >= GRAM), pieces)))


def containing(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(text, name): distinct texts with the distinct names that they hold, see ``like_any``.

    A text that holds a name holds every piece of it between wildcards. Names are joined to texts by the one of
    their pieces of ``GRAM`` characters that the fewest texts hold, then compared whole; names with a piece that no
    text holds are gone before that. Names with no such piece, those shorter or all wildcards, are compared with all texts.
    """
    whole = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_key", F.xxhash64("_text"))
    parts = names.select(F.col(name).alias("_name")).where("_name is not null").distinct().withColumn("_grams", _grams(F.split(F.lower("_name"), "[_%]")))
    asked = parts.select("_name", F.explode("_grams").alias("_gram"))
    held = whole.select("_key", F.explode(_grams(F.array(F.lower("_text")))).alias("_gram")).join(asked.select("_gram").distinct(), "_gram", "left_semi")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = asked.join(often, "_gram", "left").groupBy("_name").agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    pairs = rarest.join(held, "_gram").select("_key", "_name").join(whole, "_key").where(like_any(F.col("_text"), F.col("_name")))
    short = parts.where(F.size("_grams") == 0).select("_name")
    pairs = pairs.select("_text", "_name").unionByName(whole.select("_text").join(short, like_any(F.col("_text"), F.col("_name"))))
    return pairs.select(F.col("_text").alias(text), F.col("_name").alias(name))


def lookup_contained(rows: DataFrame, text: str, entities: DataFrame, name: str, id_col: str = "id", out: str = "found_id") -> DataFrame:
    """The lowest id of the entities whose name the text contains."""
    names = entities.groupBy(F.col(name).alias("_named")).agg(F.min(id_col).alias("_id"))
    found = containing(rows.select(text), text, names, "_named").join(names, "_named").groupBy(text).agg(F.min("_id").alias(out))
    return rows.join(found, text, "left")


def lookup_in_range(rows: DataFrame, spans: DataFrame, group: str, point: str, start: str, end: str, row_id: str, id_col: str = "id", out: str = "found_id", bin_width: int = 64) -> DataFrame:
    """The lowest id of the spans of the same group that hold the point. Spans are dealt out to bins of lines, so that a huge group spreads."""
    binned = spans.select(group, start, end, F.col(id_col).alias("_id"), F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width))).alias("_bin"))
    points = rows.withColumn("_bin", F.floor(F.col(point) / bin_width))
    hits = points.join(binned, [group, "_bin"]).where(F.col(point).between(F.col(start), F.col(end)))
    return hits.groupBy(row_id).agg(F.min("_id").alias(out))


def rejects(rows: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """Rows that no lookup bound."""
    return rows.join(found.select(row_id), row_id, "left_anti")


def latest_state(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last update of each key: what UPDATE statements in that order would leave."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


#: Calls, and expressions, of a file up to which they are matched in one task; of fuller files each lot of calls meets each lot of expressions.
LOT = 262_144


def _matched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``matched`` of rows that stand together by ``keys`` in their partitions."""
    rows = rows.select(*keys, "id", "_text", "_source").sortWithinPartitions(*keys)
    kind = StructType([*rows.select(*keys, "id").schema.fields, StructField("seq", LongType()), StructField("source_method_id", LongType())])
    return rows.mapInArrow(lambda batches: matched(batches, keys), kind)


def last_matches(calls: DataFrame, expressions: DataFrame, file: list[str]) -> DataFrame:
    """The last expression of a call's file whose text holds the call's: file, id, seq, source_method_id.

    ``calls``: file, id, full_string. ``expressions``: file, seq, text, source_method_id; of equal seq the highest source. Calls and expressions are shuffled once, together, by file, and
    matched where they are (see ``contained``): pieces of texts, and pairs, of which there are many more, are never shuffled. Files with more than ``LOT`` of either are dealt out
    anew, so that a huge one spreads.
    """
    rows = calls.where("full_string is not null").select(*file, "id", F.col("full_string").alias("_text"), F.lit(None).cast("long").alias("_source"))
    rows = rows.unionByName(expressions.where("text is not null and source_method_id is not null").select(*file, F.col("seq").alias("id"), F.col("text").alias("_text"), F.col("source_method_id").alias("_source")))
    lots = lambda which: F.ceil(F.count_if(which).over(Window.partitionBy(*file)) / LOT)
    call, few = F.col("_source").isNull(), (F.col("_calls") == 1) & (F.col("_given") == 1)
    rows = rows.withColumns({"_calls": lots(call), "_given": lots(~call)}).where("_calls > 0 and _given > 0")
    one = lambda lots: F.pmod(F.xxhash64("id"), F.col(lots))
    each = lambda lots: F.explode(F.sequence(F.lit(0).cast("long"), F.col(lots) - 1))
    full = rows.where(~few)
    dealt = full.where(call).withColumns({"_calls": one("_calls"), "_given": each("_given")}).unionByName(full.where(~call).withColumns({"_calls": each("_calls"), "_given": one("_given")}))
    keys = [*file, "_calls", "_given"]
    last = _matched(dealt.repartition(*keys), keys).groupBy(*file, "id").agg(F.max("seq").alias("seq"), F.max_by("source_method_id", F.struct("seq", "source_method_id")).alias("source_method_id"))
    return _matched(rows.where(few), file).unionByName(last)


def resolve_calls(calls: DataFrame, expressions: DataFrame, definitions: DataFrame, file: list[str], scope: list[str]) -> DataFrame:
    """What stored calls without a source resolve to: id, seq (place of the match), source_method_id, with the columns of ``scope``.

    ``calls``: scope, file, id, full_string. ``expressions``, the call expressions of the files as the compiler front end bound them: scope, file, seq (place in the
    file), text, and name and path of the definition. ``definitions``: scope, id, name, path. Each expression of a call's file whose text holds the call's is
    looked up by name and path (the lowest id); of those found the last in the file wins.
    """
    bound = lookup(expressions, definitions, [*scope, "name", "path"], out="source_method_id")
    return last_matches(calls, bound, [*scope, *file]).select(*scope, "id", "seq", "source_method_id")


def bind_smells(smells: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """What a smell report comes to in the tables: method_id, test_smell_id, status, and n, the rows of the report that were bound to them.

    ``smells``: method_id, test_smell_id, status. The report has the methods of a file under every class of the file. A row is bound by the class's name (the
    lowest id anywhere) and the method's name in that class (the lowest id); rows without such a class or method are dropped, and of several statuses
    the first stays, in the order of the report's classes and methods. The rows of a file under one name are merged and meet only those of its classes whose namesake has
    such a method, so that classes times methods are never made.
    """
    placed = methods.select(F.col("id").alias("method_id"), "class_id", "name").join(classes.select(F.col("id").alias("class_id"), "file_id"), "class_id")
    seen = smells.join(placed, "method_id").groupBy("file_id", "name", "test_smell_id").agg(F.min_by("status", "method_id").alias("status"), F.min("method_id").alias("at"), F.count(F.lit(1)).alias("n"))
    least = methods.groupBy("class_id", "name").agg(F.min("id").alias("bound"))
    named = lookup(classes.select(F.col("id").alias("listed"), "file_id", F.col("name").alias("class")), classes.withColumnRenamed("name", "class"), ["class"], out="class_id")
    hits = seen.join(named.join(least, "class_id").select("listed", "file_id", "name", "bound"), ["file_id", "name"])
    first = hits.groupBy("bound", "test_smell_id").agg(F.min_by("status", F.struct("listed", "at")).alias("status"), F.sum("n").alias("n"))
    return first.withColumnRenamed("bound", "method_id")


def update_column(rows: DataFrame, updates: DataFrame, column: str, key: str = "id") -> DataFrame:
    """UPDATE of one column by key: rows that ``updates`` (key, column; one row a key) names take its value, others keep theirs."""
    new = updates.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows as a reader of objects takes them: nulls are 0, false or empty text."""
    zero = {"string": "", "boolean": False}
    return rows.select(*(F.coalesce(F.col(f"`{n}`"), F.lit(zero.get(t, 0)).cast(t)).alias(n) for n, t in rows.dtypes))
