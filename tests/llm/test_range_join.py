"""The metric range join against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from assay.llm import range_join as rj

SCHEMA = "vec_id long, embedding array<double>, node int, v string, n string, id int, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "v", "n", 2, 3) for r in rows], schema).repartition(3)


def fit(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain(rows, least=0.9):
    """n_links and component of each row by all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if fit(v)]
    links = {i: [j for j in good if j != i and rj.cosine(rows[i][1], rows[j][1]) >= least] for i in good}
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in links.get(todo.pop(), []):
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
        out.append((rows[i][0], len(links.get(i, [])), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed, n=260, dims=6):
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        base = rng.normal(size=dims)
        for _ in range(int(rng.choice([1, 2, 5, 60]))):
            spread = rng.choice([0, 0.05, 0.3, 0.6])
            rows.append((base + spread * rng.normal(size=dims)).tolist())
    ids = rng.permutation(len(rows)).tolist()
    return list(zip(ids, rows))


@pytest.mark.parametrize(("seed", "cell", "home", "lot"), [(1, 8_192, 8_192, 16_384), (2, 20, 8, 10), (3, 40, 1_000, 15), (4, 500, 30, 1_000)])
def test_all_pairs(spark, seed, cell, home, lot, monkeypatch):
    monkeypatch.setattr(rj, "STEP", 7)
    rows = clustered(seed)
    rows += [(i + 10_000, rows[0][1]) for i in range(40)]  # copies
    rows += [(20_000, [2e300 * x for x in rows[1][1]]), (20_001, [1e-300 * x for x in rows[1][1]])]
    assert got(rj.near_vectors(frame(spark, rows), cell=cell, home=home, lot=lot)) == plain(rows)


def test_odd_rows(spark):
    """Cosines of exactly 0.9 link; rows that take no part stand alone; ids repeat or are missing."""
    edge = [[10.0, 0.0, 0.0, 0.0], [9.0, 3.0, 3.0, 1.0], [9.0, -3.0, -3.0, -1.0001]]
    rows = [(i, v) for i, v in enumerate(edge)]
    rows += [(10, None), (11, []), (12, [0.0, -0.0]), (13, [1.0, None]), (14, [float("nan"), 1.0]), (15, [float("inf"), 1.0])]
    rows += [(20, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [-1.0, 0.0]), (21, [-0.0, 1.0, 0.0]), (None, [0.0, 2.0]), (None, [0.0, 0.0, -1.0]), (None, None)]
    want = plain(rows)
    assert (0, 1, 0, True) in want and (2, 0, 2, True) in want and (None, 0, None, False) in want
    assert got(rj.near_vectors(frame(spark, rows), cell=3, home=2, lot=2)) == want
    assert got(rj.near_vectors(frame(spark, rows).limit(0))) == []
    assert got(rj.near_vectors(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]


def test_other_names_and_floats(spark):
    rows = [("b", [1.0, 0.1], 0), ("a", [1.0, 0.0], 0), ("c", [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "name string, vec array<float>, kept int")
    assert sorted(map(tuple, rj.near_vectors(df, id_col="name", vector_col="vec").collect())) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    with pytest.raises(ValueError):
        rj.near_vectors(df, 1.0)


def test_cells_leave_out_what_is_far(spark):
    """Groups far from each other: a vector is copied to no cell but its own, and a core is not compared."""
    rng = np.random.default_rng(5)
    centres = np.eye(12)
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=12)).tolist()) for i in range(600)]
    distinct = spark.createDataFrame([(i, 1, v) for i, v in rows], "node long, n long, v array<double>")
    found = rj.cell_links(distinct, 0.9, cell=50)
    assert found.where("links is not null").groupBy("node").sum("links").select("sum(links)").distinct().collect() == [(49,)]
    assert found.where("other is not null").count() == 600 - 12
    cell = rj.Cell(pa.table({"node": [1, 2, 3], "n": [1, 1, 1], "core": [True, True, False], "v": [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]}), 0.9)
    cell.inside()  # the two marked as core count as linked whatever they hold
    assert cell.links.tolist() == [1, 2, 1]


def test_pivots_are_far_apart():
    rng = np.random.default_rng(6)
    x = rj.unit(pa.array(rng.normal(size=(500, 3)).tolist()))
    chosen = rj.far_apart(x, 100, 0.5)
    dots = chosen @ chosen.T - 2 * np.eye(len(chosen))
    assert 5 < len(chosen) < 100 and dots.max() < np.cos(0.5) and (x @ chosen.T).max(axis=1).min() >= np.cos(0.5)
