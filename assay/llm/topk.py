"""Exact top-k inner products by columnar branch and bound.

Vectors lie in vertical layout, a row for each dimension. For a query, scores are summed one
block of dimensions after another; after each block a candidate's score is bounded by what it
has plus the product of the norms that remain (Cauchy-Schwarz), and candidates whose bound is
under the query's k-th best score so far are compacted away.

Queries and candidates are dealt out in blocks, a task for each pair of blocks, so no task or
broadcast grows with the input; each pair returns k rows for a query, and those are merged. All
queries meet one block first: their k-th best scores in it bound the search in all other blocks.
A candidate is copied once for each block of queries.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without
an id. All rows with a query's id are the query's own; of repeated query rows one is asked.
Ties go to the smaller id; shorter vectors count as padded with zeros. An empty table gives an empty one; columns
other than id and vector aren't read, and ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import written

SCALE, BLOCK = 1024, 8
QUERIES, CANDIDATES = 16_384, 16_384  # in a block
_LONG = 2**63


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of a list array without nulls, one row for each vector, shorter ones padded with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best among ``vectors``, own ids left out; those under the query's floor may be missing."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, vectors))
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(vectors[order].T)
    out: list[tuple[int, int, int]] = []
    if not width or np.abs(queries).max() * np.abs(columns).max() * width >= 2**53:  # beyond exact doubles: whole numbers of any size
        exact = np.array([[int(x) for x in row] for row in columns.tolist()], dtype=object).reshape(width, len(ids))
        for q, own in zip(queries.tolist(), query_ids.tolist()):
            scores = [max(-_LONG, min(_LONG - 1, sum(int(a) * b for a, b in zip(q, exact[:, j])))) for j in range(len(ids))]
            best = sorted((-s, int(i)) for s, i in zip(scores, ids) if i != own)[:k]
            out += [(own, i, -s) for s, i in best]
        return out
    blocks = [slice(a, min(a + BLOCK, width)) for a in range(0, width, BLOCK)]
    squares = np.array([np.square(columns[b]).sum(axis=0) for b in blocks])
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    for q, own, known in zip(queries, query_ids.tolist(), floors.tolist()):
        mass = np.array([np.square(q[b]).sum() for b in blocks])
        walk = np.argsort(-mass, kind="stable")  # the query's heaviest blocks first
        left = np.sqrt(np.concatenate([np.cumsum(mass[walk][::-1])[::-1][1:], [0.0]]))
        rest = np.cumsum(squares[walk][::-1], axis=0)[::-1]
        alive = np.flatnonzero(ids != own)
        part = q[blocks[walk[0]]] @ columns[blocks[walk[0]]][:, alive]
        # A lower bound to begin with: the k-th best whole score of those that lead after a block.
        lead = alive[np.argpartition(-part, 4 * k)[: 4 * k]] if len(alive) > 4 * k else alive
        sure = q @ columns[:, lead]
        floor = max(known, np.sort(sure)[-k] if len(sure) >= k else -np.inf)
        for step, b in enumerate(walk):
            if step:
                part += q[blocks[b]] @ columns[blocks[b]][:, alive]
            if step + 1 < len(walk):
                most = part + left[step] * np.sqrt(rest[step + 1][alive]) * (1 + 1e-9) + 1e-3
                keep = most >= floor
                if keep.sum() < 0.8 * len(alive):
                    alive, part = alive[keep], part[keep]
        best = np.lexsort((ids[alive], -part))[:k]
        out += [(own, int(ids[alive[j]]), int(part[j])) for j in best]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: tuple[int, int] = (QUERIES, CANDIDATES)) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries`` against every row of ``candidates``."""
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null").where(finite)
    asked, rows = usable(queries).groupBy("id").agg(F.min("v").alias("v")), usable(candidates)
    qs, cs = max(1, -(-asked.count() // block[0])), max(1, -(-rows.count() // block[1]))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    schema = "query_id long, vec_id long, score long"

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and c.num_rows:
            q, c = q.combine_chunks(), c.combine_chunks()
            floors = q.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            found = search(integers(q.column("v").chunk(0)), q.column("id").to_numpy(), integers(c.column("v").chunk(0)), c.column("id").to_numpy(), k, floors)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), zip(*found) if found else ([], [], []))})

    def meet(asked: DataFrame, blocks: tuple[int, int]) -> DataFrame:
        """The best of the candidates' blocks of a range for every query."""
        left = asked.select("id", "v", "floor", own(qs).alias("qb"), F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[1] - 1))).alias("cb"))
        right = rows.select("id", "v", own(cs).alias("cb")).where(F.col("cb").between(blocks[0], blocks[1] - 1)).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("qb"), "cb")
        return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(pair, schema)

    parts = meet(asked.withColumn("floor", F.lit(None).cast("long")), (0, 1))
    if cs > 1:  # what a query's k-th best is at least is known from one block when it meets the others
        parts = written(parts, "first-block")
        floors = parts.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
        parts = parts.unionByName(meet(asked.join(floors, "id", "left"), (1, cs)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_every(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return top_k(vectors.where(F.col("vec_id") % every == 0), vectors, k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
