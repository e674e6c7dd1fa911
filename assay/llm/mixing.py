"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is shared out by weight, stops at ``MOST`` times its size, and the
excess goes to the others (water filling). Of target / size, every document gets the whole part
as certain copies, and the rest is a fixed number of documents of each stratum: within a source,
documents of like size form a stratum, and its sample size carries on what larger strata took too
much or too little. Its documents are ranked by random odds divided by inclusion odds, of which the
first so many are taken (Pareto order sampling of fixed size). Inclusion odds are unequal: those of the
stratum's sampling fraction, times mean size over the document's own, so that the documents of a
stratum can expect to bring about as many words each, and a longer one doesn't bring more for its length.
The random numbers are hashes of id and text, so that reruns agree.

Ranks are compared with the stratum's threshold, found from histograms of the ranks, each within
one bin of the last, and the ranks of the one bin that is left: no stratum is sorted as a whole. Null texts have size
zero, a null source is a source of its own and sorts last. Rows with equal ids and texts rank alike; of those at a
threshold as many are taken as there is room for. Texts are only counted and hashed, whatever their length;
an empty table gives an empty mix, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import WORD_SQL, written

#: Fixed values of the mix: weights by position of the source, size of the mix, and copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bins of a histogram, and how many times a bin is looked into.
BINS, DEPTH = 128, 2


def size_class() -> Column:
    """Number of a size's octave and eighth of it: sizes of a class differ by less than an eighth.

    It can't be null, which Catalyst is told: a join on it then needs no filter that counts the words anew.
    """
    octave = F.length(F.bin("size"))
    return F.coalesce(F.when(F.col("size") > 0, octave * 16 + F.floor(F.col("size") * 16 / F.pow(F.lit(2.0), octave)).cast("int")), F.lit(0))


def chance(id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> Column:
    """A number between 0 and 1, from a hash of id and text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight and target; one row for each source, so one task orders them."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    total = F.lit(share) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("total", total).withColumn("full", F.col("cap") / F.col("weight") <= level)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / open_weight
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select("source", "source_size", "weight", "target")


def sample_sizes(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """For each (source, class): n rows, their words, whole copies, and take, the sample's size."""
    strata = sizes.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    joined = strata.join(goals.select(F.col("source").alias("of"), "whole", "part"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    gathered = joined.groupBy("source", "whole", "part").agg(F.sort_array(F.collect_list(F.struct("class", "n", "words")), asc=False).alias("strata"))
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("taken"), F.expr("cast(array() as array<struct<class:int,n:bigint,words:bigint,take:bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mean = x["words"] / x["n"]
        due = acc["due"] + F.col("part") * x["words"]
        want = F.when(mean > 0, (due - acc["taken"]) / mean).otherwise(F.col("part") * x["n"])
        take = F.least(x["n"], F.greatest(F.lit(0).cast("long"), F.floor(want + 0.5)))
        return F.struct(due.alias("due"), (acc["taken"] + take * mean).alias("taken"), F.concat(acc["out"], F.array(F.struct(x["class"].alias("class"), x["n"].alias("n"), x["words"].alias("words"), take.alias("take")))).alias("out"))

    folded = gathered.select("source", "whole", F.explode(F.aggregate("strata", start, step, lambda acc: acc["out"])).alias("s"))
    return folded.select("source", "whole", "s.class", "s.n", "s.words", "s.take")


def _on_stratum(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    named = right.withColumnRenamed("source", "_source").withColumnRenamed("class", "_class")
    return left.join(named, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")), how).drop("_source", "_class")


def pareto_rank() -> Column:
    """Random odds over inclusion odds, brought between 0 and 1 in the same order; null where none or all are taken."""
    p = F.col("take") / F.col("n")
    size = F.when(F.col("size") > 0, F.col("words") / (F.col("n") * F.col("size"))).otherwise(1.0)
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p) * size)
    return F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), rank / (1 + rank))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``last``, the rank of the last documents taken, how many have it, and of how many of them there is ``room``; null where none or all are taken."""
    rows = _on_stratum(sizes, plan.where("take > 0 and take < n")).select("source", "class", pareto_rank().alias("rank"), F.col("take").alias("room"))

    def reached(value: Column) -> DataFrame:
        """The value up to which there is room."""
        counts = rows.groupBy("source", "class", "room", value.alias("value")).agg(F.count(F.lit(1)).alias("have"))
        upto = F.sum("have").over(Window.partitionBy("source", "class").orderBy("value"))
        before = F.col("upto") - F.col("have")
        return counts.withColumn("upto", upto).where((F.col("upto") >= F.col("room")) & (before < F.col("room"))).select("source", "class", "value", "have", (F.col("room") - before).alias("room"))

    for depth in range(1, DEPTH + 1):
        place = F.floor(F.col("rank") * BINS**depth)
        rows = _on_stratum(rows.drop("room"), reached(place)).where(place == F.col("value")).select("source", "class", "rank", "room")
    return _on_stratum(plan, reached(F.col("rank")).withColumnRenamed("value", "last"), "left")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size (words), class of size and the id's random number u."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("class", size_class()).withColumn("u", chance())


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and for each (source, class) what is taken."""
    sizes = written(sized(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    found = thresholds(sizes, sample_sizes(sizes, goals))
    plan = found.join(goals.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return sizes, written(plan, "plan")


def _taken(rows: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` with ``copies``."""
    ranked = _on_stratum(rows, plan).withColumn("rank", pareto_rank())
    more = F.when(F.col("take") >= F.col("n"), 1).when(F.col("rank") <= F.col("last"), 1).otherwise(0)
    tied = F.coalesce((F.col("rank") == F.col("last")) & (F.col("room") < F.col("have")), F.lit(False))
    out = ranked.where(~tied).select(*keep, (F.col("whole") + more).alias("copies"))
    if plan.where("room < have").isEmpty():
        return out
    # Of equal rows at a threshold only their number matters: they are counted before they meet.
    # They go by a digest of their JSON: a column may be a map, which can neither be grouped by nor hashed.
    digest = F.sha2(F.to_json(F.struct(*keep)), 256).alias("digest")
    same = ranked.where(tied).groupBy("source", "class", "whole", "room", digest).agg(*(F.first(c).alias(c) for c in keep), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("source", "class").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1))
    each = same.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.union(each.select(*keep, (F.col("whole") + F.when(F.col("before") + F.col("place") <= F.col("room"), 1).otherwise(0)).alias("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), copies, taken (words, repeats counted)."""
    sizes, plan = _planned(docs, weights, share, most)
    out = _taken(sizes.withColumn("of", F.col("source")), plan, ["doc_id", "size", "of", "source_size", "target"])
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    names = docs.columns
    _, plan = _planned(docs, weights, share, most)
    rows = sized(docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")).drop("text")
    taken = _taken(rows, plan, ["row"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "copies")))).where("copy <= copies")
    return taken.select(*(F.col("row").getField(c).alias(c) for c in names))


SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) * 16 + CAST(floor(size * 16 / pow(2.0, length(bin(size)))) AS INT) ELSE 0 END AS class,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_hash), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM (SELECT doc_id, source, md5(coalesce(text, '')) AS text_hash, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM by_source
), filled AS (
  SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER ()) END AS target FROM filled
), parts AS (
  SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM goals)
), strata AS (
  SELECT s.source, class, count(*) AS n, sum(size)::DOUBLE AS words, any_value(part) AS part, any_value(whole) AS whole,
    row_number() OVER (PARTITION BY s.source ORDER BY class DESC) AS k
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, class
), fold AS (
  SELECT source, 0::BIGINT AS k, 0.0::DOUBLE AS due, 0.0::DOUBLE AS taken, 0 AS class, 0::BIGINT AS take FROM goals
  UNION ALL
  SELECT source, k, due, taken + take * (words / n), class, take FROM (
    SELECT s.source, s.k, f.due + part * words AS due, f.taken, s.class, words, n,
      least(n, greatest(0, CAST(floor((CASE WHEN words > 0 THEN (f.due + part * words - f.taken) / (words / n) ELSE part * n END) + 0.5) AS BIGINT))) AS take
    FROM fold f JOIN strata s ON s.source IS NOT DISTINCT FROM f.source AND s.k = f.k + 1)
), ranked AS (
  SELECT z.*, s.whole, f.take,
    row_number() OVER (PARTITION BY z.source, z.class ORDER BY CASE WHEN f.take > 0 AND f.take < s.n
      THEN (z.u / (1 - z.u)) / ((f.take::DOUBLE / s.n) / (1 - f.take::DOUBLE / s.n) * CASE WHEN z.size > 0 THEN s.words / (s.n * z.size) ELSE 1 END) END) AS place
  FROM sizes z JOIN strata s ON z.source IS NOT DISTINCT FROM s.source AND z.class = s.class
  JOIN fold f ON f.source IS NOT DISTINCT FROM s.source AND f.k = s.k
)
SELECT r.doc_id, r.size, g.source_size, g.target, CAST(r.whole AS INT) + CASE WHEN r.place <= r.take THEN 1 ELSE 0 END AS copies,
  (CAST(r.whole AS BIGINT) + CASE WHEN r.place <= r.take THEN 1 ELSE 0 END) * r.size AS taken
FROM ranked r JOIN goals g ON g.source IS NOT DISTINCT FROM r.source
"""
