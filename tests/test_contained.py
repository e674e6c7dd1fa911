"""Calls matched with the last expression that holds their text: against plain loops, and without shuffling pieces or pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.operators import contained
from assay.operators import resolve as R


@pytest.mark.parametrize("letters", ["ab", "aé𝄞", "ab%_(\n\0"])
def test_last_holding_as_by_a_loop(letters, monkeypatch):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for size in (8, 100, 1 << 20) * 10:
        monkeypatch.setattr(contained, "SLICE", size)
        texts = [text(rng.choice([0, 3, 10, 50, 90])) for _ in range(rng.randrange(40))]
        groups = [rng.randrange(3) for _ in texts]
        parts = [text(rng.randrange(6)) for _ in range(30)]
        for x in rng.choices(texts, k=30) if texts else []:
            i, j = sorted(rng.choices(range(len(x) + 1), k=2))
            parts.append(x[i:j])
        of = [rng.randrange(4) for _ in parts]
        want = [max((k for k, (x, g) in enumerate(zip(texts, groups)) if g == q and p in x), default=-1) for p, q in zip(parts, of)]
        assert contained.last_holding(np.array(groups, np.int64), pa.array(texts, pa.string()), np.array(of, np.int64), pa.array(parts, pa.string())).tolist() == want


def _frames(spark, calls, given):
    return spark.createDataFrame(calls, "repo string, file long, id long, full_string string"), spark.createDataFrame(given, "repo string, file long, seq long, text string, source_method_id long")


@pytest.mark.parametrize("lot", [R.LOT, 7])
def test_matches_of_files_in_lots_as_by_a_loop(spark, monkeypatch, lot):
    monkeypatch.setattr(R, "LOT", lot)
    monkeypatch.setattr(contained, "ROWS", 16)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab(%_)") for _ in range(n))
    where = lambda: (rng.choice("pq"), rng.choice([1, 1, 1, 2, 3, rng.randrange(4, 40)]))
    calls = [(*where(), i, text(rng.choice([0, 1, 2, 3, 5]))) for i in range(120)] + [("p", 1, 900, None), ("p", 77, 901, "a")]
    given = [(*where(), i // 2, text(rng.randrange(12)), rng.randrange(9)) for i in range(200)] + [("p", 1, 999, None, 3), ("p", 1, 999, "ab", None)]
    want = []
    for r, f, i, part in calls:
        met = [(seq, s) for a, b, seq, x, s in given if (a, b) == (r, f) and None not in (part, x, s) and part in x]
        want += [(r, f, i, *max(met))] if met else []
    got = R.last_matches(*_frames(spark, calls, given), ["repo", "file"]).select("repo", "file", "id", "seq", "source_method_id")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40


def _shuffled(spark, df) -> int:
    """Rows that the stages of a run wrote to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    every = stages()
    return sum(s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size())) if s.stageId() not in before)


def test_pieces_and_pairs_are_not_shuffled(spark):
    """A file whose calls each share pieces with many expressions: what is shuffled grows with the rows, not with pieces or pairs."""
    calls = spark.range(400).select(F.lit("p").alias("repo"), F.lit(1).cast("long").alias("file"), "id", F.expr("concat('all_', id % 90, '(')").alias("full_string"))
    given = spark.range(1600).select(F.lit("p").alias("repo"), F.lit(1).cast("long").alias("file"), F.col("id").alias("seq"), F.expr("concat('x.Call_', id % 90, '(', id % 50, ').Done()')").alias("text"), F.expr("concat('M', id % 9)").alias("name"), F.lit("p").alias("path"))
    methods = spark.range(9).select(F.lit("p").alias("repo"), "id", F.expr("concat('M', id)").alias("name"), F.lit("p").alias("path"))
    found = R.resolve_calls(calls, given, methods, ["file"], ["repo"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found.count() == 400 and _shuffled(spark, found) < 3 * (400 + 1600)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_calls_with_a_source_are_not_shuffled_again(spark):
    """Only calls that are looked up meet what was found for them, and both parts read the calls merged once."""
    from __spark_entry__ import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sf = "/root/testdata/sf0.001"
        found, updated = (queries()[name](spark, sf) for name in ("resolve_invocations", "update_invocation_source"))
        asked = updated.sparkSession.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("sk")).where("sk % 5 = 0").count()
        assert _shuffled(spark, updated) - _shuffled(spark, found) <= 2 * asked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
