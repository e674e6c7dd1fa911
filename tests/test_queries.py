"""Every registered query of the warehouse against its DuckDB SQL, and the measured counts of FIXTURES.md."""

import math
import re
import os

import duckdb
import pytest

from assay.operators import metrics as M
from assay.operators import resolve as R
from assay.plans import registry
from assay.sources.adapters import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    other = duck.execute(registry.oracle_sql()[name])
    assert comparable(df.columns, df.collect()) == comparable([d[0] for d in other.description], other.fetchall())


def test_counts_of_fixtures(spark):
    q = registry.queries()
    assert q["v_gen_test_coverage"](spark, SF).count() == 6830 and q["v_method_test_mapping"](spark, SF).count() == 3652
    categories = {r.evaluation_category: r["count"] for r in q["v_generated_test_evaluation"](spark, SF).groupBy("evaluation_category").count().collect()}
    assert categories == {"Approved / Improved Test": 184, "Benign Test": 23, "Candidate Test": 70, "Failed Test": 5198}
    assert q["lookup_location"](spark, SF).count() == 4385
    assert q["random_sample_k"](spark, SF).count() == 3


def test_empty_families(spark):
    """Views and flags stand empty tables."""
    t = Tables(spark, SF)
    t.__dict__["coverage_reports"] = t.coverage_reports.limit(0)
    from assay.plans import views as V

    assert V.project_coverage_comparison(t).count() == 0 and V.candidate_covered_methods(t).count() == 0
    assert V.generated_test_evaluation(t).where("evaluation_category <> 'Failed Test'").count() == 0
    assert M.exists(t.coverage_reports).first().found is False


def test_insert_if_absent(spark):
    new = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "c")], "id long, h string")
    old = spark.createDataFrame([(9, "c")], "id long, h string")
    assert sorted(tuple(r) for r in R.insert_if_absent(new, old, ["h"], "id").collect()) == [("a", 1), ("b", 2)]
    assert sorted(r.surrogate_id for r in R.surrogate_ids(new, "id", 10, width=2).collect()) == [11, 12, 13, 14]


def test_like_wildcards(spark):
    rows = spark.createDataFrame([("a_b\\c",), ("axbyc",)], "x string")
    names = spark.createDataFrame([(1, "A_B\\"), (2, "%y%")], "id long, n string")
    got = {r.x: r.found_id for r in R.lookup_contained(rows, "x", names, "n").collect()}
    assert got == {"a_b\\c": 1, "axbyc": 2}


def test_cohesion_by_hand(spark):
    df = spark.createDataFrame([("g", 1, "abcabc"), ("g", 2, "abcabc"), ("h", 1, "abc"), ("h", 2, "xyz"), ("one", 1, "abc"), ("short", 1, "a"), ("short", 2, "b")], "g string, id int, b string")
    got = {r.g: (r.bodies, r.mean_similarity, r.lacks_cohesion) for r in M.cohesion(df, "g", "b", "id").collect()}
    assert got == {"g": (2, 1.0, False), "h": (2, 0.0, True), "one": (1, None, False), "short": (2, 0.0, True)}


def test_contained_names_of_any_shape(spark):
    """Found by pieces or, without one, by comparing all: as a loop over all pairs finds them."""
    import random

    rng = random.Random(3)
    made = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [made(rng.randrange(40), "abAB_%\\é") for _ in range(150)] + ["", None, "abcd"]
    names = [made(rng.randrange(9), "abB_%\\É") for _ in range(80)] + ["", None, "__", "ab%BA", "ABCD"]
    got = R.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()
    pattern = lambda n: ".*" + "".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in n.lower()) + ".*"
    expected = sorted((t, n) for t in set(texts) - {None} for n in set(names) - {None} if re.fullmatch(pattern(n), t.lower(), 16))
    assert sorted((r.t, r.n) for r in got) == expected and len(expected) > 100


def test_cohesion_deals_out_bodies_before_it_makes_shingles(spark):
    """Bodies of one split become shingles in many tasks, each of which holds those of some bodies only."""
    df = spark.range(1200).selectExpr("id % 400 g", "concat('body ', id % 7, ' of ', id % 5, ' and more') b", "id").coalesce(1)
    got = M.cohesion(df, "g", "b", "id", each=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan or "Repartition 12" in plan
    assert plan.count("Generate") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.cohesion(df, "g", "b", "id").collect()))


def test_nothing_is_rounded_for_each_outcome(spark):
    """Rates and deltas belong to a test; its outcomes, of which there are many, are joined after they are made."""
    from assay.plans import views as V
    from assay.sources.adapters import RepoTables

    for t in (Tables(spark, SF), RepoTables(spark, SF)):
        for view in (V.test_agg, V.generated_test_evaluation):
            plan = view(t)._jdf.queryExecution().optimizedPlan().toString()
            assert "round(" in plan and "round(" not in plan[: plan.index("Join LeftOuter")]


def test_lines_are_dealt_out_before_they_are_merged(spark):
    """A task that reads a split hands its rows on: it keeps none to sort or merge them."""
    plan = Tables(spark, SF).lines._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "l_orderkey" in below and "Sort" not in below and "Aggregate" not in below
