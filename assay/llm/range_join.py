"""Embedding near-duplicates by an exact metric range join.

Vectors lie on the unit sphere, their distance is the angle, and a cosine of ``least`` is the radius r.
Pivots (a bounded sample, thinned to those far from each other) partition the vectors: each belongs to the cell of
its nearest pivot h. By the triangle inequality a neighbour of x can lie in the cell of pivot p only if
d(x, p) <= d(x, h) + 2r and d(x, p) <= r + the cell's radius; there x is replicated. A pair of two cells is
found in the larger one alone, so x goes to cells larger than its own. Cells then join independently.

A cell of any size is dealt out: its own vectors in blocks of ``HOME``, what streams past them (replicas, and the cell's
other blocks) in lots of ``LOT``, a task for each block and lot; memory is bounded by the block.
What is within half the radius of a pivot is linked with each other by the triangle inequality; such cores
are counted without comparing. A task returns its vectors' numbers of links and a spanning forest, never the pairs.
Equal vectors enter once, with their number. Vectors without structure (random ones in many dimensions) have all
cells within 2r of each other: then no exact metric bound helps and the work is half of all pairs.

Cosines within ``SLACK`` of the limit are computed again as one dot product over the root of the squares' product.
Vectors are scaled by a power of two first, so that squares neither vanish nor overflow; shorter
ones count as padded with zeros. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
Repeated rows, also those of one id, are vectors of their own. A null id is never a component's smallest; a component without an id
has component_id null and kept false. An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import written
from assay.llm.components import connected_components

#: Vectors in a cell on average; cells at most (pivots are broadcast: so many rows of the vectors' width, PIVOT_MB at most); candidates for each pivot.
CELL, MOST_CELLS, PIVOT_MB, SAMPLE = 8_192, 2_048, 32, 8
#: A cell's own vectors in a task, and others that stream past them there.
HOME, LOT, STEP = 8_192, 16_384, 512
SLACK, SALTS, MOST_TASKS = 1e-9, 64, 20_000


def unit(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list array, padded and of length one."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), max(wide, width or 0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])
    return out / np.sqrt(np.square(out).sum(axis=1))[:, None]


def _scaled(vector: list[float]) -> np.ndarray:
    v = np.asarray(vector, dtype=np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def cosine(a: list[float], b: list[float]) -> float:
    """Cosine of two vectors in double precision."""
    a, b = _scaled(a), _scaled(b)
    n = min(len(a), len(b))
    return float(np.dot(a[:n], b[:n]) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def linked(x: np.ndarray, y: np.ndarray, raw_x: pa.Array, raw_y: pa.Array, least: float) -> np.ndarray:
    """Which of the vectors x are linked with which of y."""
    dots = x @ y.T
    out = dots >= least
    for i, j in zip(*np.nonzero(np.abs(dots - least) <= SLACK)):
        out[i, j] = cosine(raw_x[int(i)].as_py(), raw_y[int(j)].as_py()) >= least
    return out


def far_apart(sample: np.ndarray, k: int, apart: float) -> np.ndarray:
    """Up to k rows of a sample, each farthest from those before it, until all are within the angle ``apart`` of one."""
    chosen, nearest = [], np.full(len(sample), -2.0)
    while len(sample) and len(chosen) < k:
        at = int(np.argmin(nearest))
        if nearest[at] >= np.cos(apart):
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def _angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1, 1))


class Forest:
    """Components of a block's vectors; adding a vector's links gives the edges that join what was apart."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.label, self.edges = ids, np.arange(len(ids)), []

    def join(self, node: int, to: np.ndarray, at: int | None = None) -> None:
        """``node`` is linked with the vectors ``to``; ``at`` is its own place where it is of this block."""
        labels, first = np.unique(self.label[to], return_index=True)
        own = -1 if at is None else self.label[at]
        fresh = labels != own
        self.edges += [(node, int(self.ids[to[i]])) for i in first[fresh]]
        if fresh.sum() + (at is not None) > 1:
            self.label[np.isin(self.label, labels)] = own if at is not None else labels[0]
            if at is not None:
                self.label[at] = own


class Cell:
    """A block of a cell's own vectors and what it has found."""

    def __init__(self, rows: pa.Table, least: float):
        rows = rows.combine_chunks()
        self.least, self.raw = least, rows.column("v").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        self.ids, self.n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        self.core = rows.column("core").to_numpy(zero_copy_only=False)
        self.x, self.links, self.forest = unit(self.raw), np.zeros(rows.num_rows, np.int64), Forest(self.ids)

    def inside(self) -> None:
        """Links within the block; of two cores nothing is compared."""
        core, rest = np.flatnonzero(self.core), np.flatnonzero(~self.core)
        if len(core):
            self.links[core] += self.n[core].sum() - self.n[core]
            for i in core[1:].tolist():
                self.forest.edges.append((int(self.ids[i]), int(self.ids[core[0]])))
            self.forest.label[core] = core[0]
        for a in range(0, len(rest), STEP):
            part = rest[a : a + STEP]
            others = np.concatenate([core, rest[a:]])
            found = linked(self.x[part], self.x[others], self.raw.take(pa.array(part)), self.raw.take(pa.array(others)), self.least)
            found &= (others[None, :] > part[:, None]) | self.core[others][None, :]
            rows_in, others_in = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
            found = found[rows_in][:, others_in]
            self.links[part[rows_in]] += found @ self.n[others[others_in]]
            self.links[others[others_in]] += found.T @ self.n[part[rows_in]]
            for i, row in zip(part[rows_in].tolist(), found):
                self.forest.join(int(self.ids[i]), others[others_in[row]], i)

    def meet(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of links of passing vectors that are linked with the block's."""
        raw, ids, n = (rows.column(rows.schema.names.index(c)) for c in ("v", "node", "n"))
        core = rows.column(rows.schema.names.index("core")).to_numpy(zero_copy_only=False)
        y, ids, n = unit(raw), ids.to_numpy(), n.to_numpy()
        width = max(y.shape[1], self.x.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (self.x, y))
        counts, ours = np.zeros(len(ids), np.int64), np.flatnonzero(self.core)
        if core.any() and len(ours):  # two cores: linked, not compared
            self.links[ours] += n[core].sum()
            counts[core] += self.n[ours].sum()
            for node in ids[core].tolist():
                self.forest.join(node, ours)
                ours = ours[:1]  # they are one component now
        for which, others in ((np.flatnonzero(~core), np.arange(len(x))), (np.flatnonzero(core), np.flatnonzero(~self.core))):
            for a in range(0, len(which), STEP):
                part = which[a : a + STEP]
                found = linked(y[part], x[others], raw.take(pa.array(part)), self.raw.take(pa.array(others)), self.least)
                rows_in, ours_in = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
                found = found[rows_in][:, ours_in]
                self.links[others[ours_in]] += found.T @ n[part[rows_in]]
                counts[part[rows_in]] += found @ self.n[others[ours_in]]
                for i, row in zip(part[rows_in].tolist(), found):
                    self.forest.join(int(ids[i]), others[ours_in[row]])
        some = np.flatnonzero(counts)
        return ids[some], counts[some]


def _joined(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by cell, block and lot (``key``), a block's own vectors first -> (node, links) and (node, other) rows."""

    def out(ids: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*edges) if edges else ((), ())
        columns = [pa.array([*ids.tolist(), *u], pa.int64()), pa.array([*links.tolist(), *[None] * len(u)], pa.int64()), pa.array([*[None] * len(ids), *v], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

    def close(cell: Cell | None) -> Iterator[pa.RecordBatch]:
        if cell is not None:
            some = np.flatnonzero(cell.links)
            yield out(cell.ids[some], cell.links[some], cell.forest.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, lone, cell = None, [], False, None

        def ready() -> None:
            nonlocal cell, home
            if cell is None and home:
                cell = Cell(pa.Table.from_batches(home), least)
                if lone:
                    cell.inside()
            home = []

        for batch in batches:
            keys, passing, first = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (passing[1:] != passing[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if b <= a:
                    continue
                if keys[a] != key:
                    ready()
                    yield from close(cell)
                    key, cell, lone = keys[a], None, bool(first[a])
                rows = batch.slice(a, b - a)
                if not passing[a]:
                    home.append(rows)
                else:
                    ready()
                    if cell is not None:
                        ids, links = cell.meet(rows)
                        yield out(ids, links, [])
        ready()
        yield from close(cell)

    return run


def _placed(pivots: np.ndarray, radii: np.ndarray | None, rank: np.ndarray | None, r: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Home cell and angle to its pivot of each vector; with the cells' radii also the cells it is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unit(batch.column(0), pivots.shape[1])
            width = y.shape[1]
            angles = _angle(y @ np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).T)
            home = angles.argmin(axis=1)
            near = angles[np.arange(len(home)), home]
            columns, names = [pa.array(home.astype(np.int32)), pa.array(near)], ["home", "angle"]
            if radii is not None:
                to = (angles <= near[:, None] + 2 * r + 1e-7) & (angles <= radii[None, :] + r + 1e-7) & (rank[None, :] < rank[home][:, None])
                ends = np.concatenate([[0], to.sum(axis=1).cumsum()]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(to)[1].astype(np.int32))), *batch.columns]
                names += ["to", *batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v and whether the vector takes part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.withColumn("good", F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False)))


def cell_links(distinct: DataFrame, least: float, cell: int = CELL, home: int = HOME, lot: int = LOT) -> DataFrame:
    """``distinct`` (node long, n long, v array) -> (node, links, other): parts of numbers of links, and edges of a spanning forest."""
    r = float(np.arccos(least))
    count, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    k = max(1, min(MOST_CELLS, PIVOT_MB * 2**20 // (8 * max(1, width or 1)), -(-count // cell)))
    # A bounded sample, by hash: SAMPLE candidates for each pivot.
    picked = distinct.select("v", F.xxhash64("node").alias("o")).orderBy("o").limit(SAMPLE * k).select("v").toArrow().column("v").combine_chunks() if count else None
    pivots = far_apart(unit(picked), k, r) if count else np.zeros((1, 1))
    first = distinct.select("v").mapInArrow(_placed(pivots, None, None, r), "home int, angle double").groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    sizes, radii = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for row in first.collect():  # a row for each pivot at most
        sizes[row["home"]], radii[row["home"]] = row["n"], row["radius"]
    rank = np.empty(len(pivots), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(pivots))
    kind = distinct.schema["v"].dataType.simpleString()
    placed = written(distinct.select("v", "node", "n").mapInArrow(_placed(pivots, radii, rank, r), f"home int, angle double, to array<int>, v {kind}, node long, n long"), "placed")
    blocks = [max(1, -(-int(s) // home)) for s in sizes]
    passing = {p: (blocks[p] - 1) * int(sizes[p]) // 2 // blocks[p] for p in range(len(pivots))}
    for row in placed.select(F.explode("to").alias("p")).groupBy("p").count().collect():  # a row for each pivot at most
        passing[row["p"]] += row["count"]
    lots = [max(1, -(-passing[p] // lot)) for p in range(len(pivots))]
    of = lambda values, p: F.lit(values)[p]
    core = (F.col("angle") <= r / 2 - 1e-7).alias("core")
    dealt = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    base = placed.select("node", "n", "v", "home", "to", core).withColumns({"hb": of(blocks, F.col("home")), "hl": of(lots, F.col("home"))}).withColumn("own", dealt(F.col("hb"), 0))
    mine = base.select("node", "n", "v", "core", F.col("home").alias("cell"), F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("hl") - 1)).alias("lot"), F.lit(False).alias("passing"))
    past = base.where("own > 0").select("node", "n", "v", "core", F.col("home").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("block"), dealt(F.col("hl"), 1).alias("lot"), F.lit(True).alias("passing"))
    copies = base.select("node", "n", "v", F.explode("to").alias("cell"))
    copies = copies.withColumns({"hb": of(blocks, F.col("cell")), "hl": of(lots, F.col("cell"))})
    copies = copies.select("node", "n", "v", F.lit(False).alias("core"), "cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("block"), dealt(F.col("hl"), 1).alias("lot"), F.lit(True).alias("passing"))
    rows = mine.unionByName(past).unionByName(copies).select((F.col("cell").cast("long") * 2**51 + F.col("block") * F.lit(2**25).cast("long") + F.col("lot")).alias("key"), "passing", (F.col("lot") == 0).alias("first"), "node", "n", "core", "v")
    tasks = 2 * sum(b * m for b, m in zip(blocks, lots))  # a task computes much for its bytes: their number is set, so that it isn't chosen by size
    return rows.repartition(min(tasks, MOST_TASKS), "key").sortWithinPartitions("key", "passing").mapInArrow(_joined(least), "node long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, home: int = HOME, lot: int = LOT) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    rows = usable(vectors, id_col, vector_col)
    distinct = rows.where("good").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id())
    distinct = written(distinct, "distinct")
    found = written(cell_links(distinct.select("node", "n", "v"), least, cell, home, lot), "links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select("node", "first"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    parts = joined.groupBy("root", "salt").agg(F.min("first").alias("first"))
    least_id = parts.select("root", "salt").join(parts.groupBy("root").agg(F.min("first").alias("component")), "root")
    named = joined.join(least_id, ["root", "salt"]).select("node", "component")
    known = distinct.join(links, "node", "left").join(named, "node", "left")
    known = written(known.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("component").isNotNull(), F.col("component")).otherwise(F.col("first")).alias("component_id")), "classes")
    good = rows.where("good").join(known, "v").select("id", "n_links", "component_id")
    out = good.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE g AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), u AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM g
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (SELECT a.rid AS a, b.rid AS b, b.vec_id FROM u a JOIN u b ON a.rid <> b.rid AND list_dot_product(a.v, b.v) / sqrt(a.norm * a.norm * b.norm * b.norm) >= 0.9),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT reach.a, min(g.vec_id) AS least_id FROM reach JOIN g ON g.rid = reach.b GROUP BY reach.a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT g.vec_id, coalesce(n.n_links, 0) AS n_links, least(g.vec_id, coalesce(c.least_id, g.vec_id)) AS component_id, g.vec_id <= coalesce(c.least_id, g.vec_id) AS kept
FROM g LEFT JOIN c ON c.a = g.rid LEFT JOIN n ON n.a = g.rid
"""
