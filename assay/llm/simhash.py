"""SimHash near-duplicates found with BK-trees over shards of the fingerprints.

A fingerprint is made of the XXH64 values of a text's shingles of four words. Fingerprints
within ``RADIUS`` differing bits are linked, and linked ones form groups. Of the 64 bits cut
into RADIUS + 1 bands, two linked fingerprints agree in one band at least (of more bands, in
more): fingerprints that agree in so many bands form a shard, and every link lies within a shard.
There are more bands where there are more fingerprints, so that shards stay small. Each shard has
a BK-tree (children keyed by their Hamming distance to the parent), held only by the task that
searches it and followed only along edges within the radius: a tree's size has a bound
(``SHARD``; at 24 bytes a fingerprint with its order and groups one megabyte), and a larger shard is
dealt out as trees over pairs of its blocks. All trees together hold each fingerprint once a shard key, which has
no bound, so they are not broadcast. Of the links in a shard a spanning forest leaves it, not every pair.

Copies share a fingerprint and enter the search once. Null and blank texts have fingerprint
zero, which links like any other. Repeated rows each give a row; a null doc_id is never
a group's smallest id, and a group without an id has component_id null. An empty table gives
an empty one. Texts are hashed whole, 65,536 shingles at a time; a very long one is held by one task with
8 bytes a shingle. Columns other than id and text aren't read by ``near_duplicates``; ``one_of_each`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import claim, map_batches, written
from assay.llm.components import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints in one BK-tree at most; a shard of more becomes trees over pairs of blocks. Even share of a shard that more bands keep to.
SHARD, EVEN = 40_000, 4_096
#: Fingerprints of a tree's stretch that are compared as a block, with so many searches at a time.
LEAF, BLOCK = 256, 1_024
#: Parts in which a component meets its smallest id.
SALTS = 64


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[i : i + 65_536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """id and ``fp``, the fingerprint's bits as a (signed) long; columns of ``more`` come along."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), *batch.columns[2:]], names=[id_col, "fp", *more])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *more)}
    return map_batches(docs.select(id_col, text_col, *more), fn, ", ".join([f"`{id_col}` {kinds[id_col]}", "fp long", *(f"`{c}` {kinds[c]}" for c in more)]))


class BKTree:
    """A BK-tree over distinct fingerprints, built at once, that also finds which of them are linked.

    A node is a stretch of ``order``; its first fingerprint is the parent of the others, which stand by their
    distance to it, one child each distance. A stretch of ``LEAF`` or fewer is a leaf and is compared as a block.
    Searches go down side by side, each along the edges within the radius. Of a search for links, what is
    already in the one group that a subtree belongs to passes it over, so that a dense group costs little more than its size.
    """

    def __init__(self, values: np.ndarray, radius: int = RADIUS):
        self.radius, self.values = radius, np.asarray(values, np.uint64)
        self.order = np.arange(len(self.values))
        #: Of each inner node, by (begin, end): its children as (distance, begin, end).
        self.children: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        todo = [(0, len(self.values))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                continue
            rest = self.order[lo + 1 : hi]
            d = self.distance(rest, self.order[lo])
            by = np.argsort(d, kind="stable")
            self.order[lo + 1 : hi], d = rest[by], d[by]
            cuts = (lo + 1 + np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [len(d)]])).tolist()
            self.children[lo, hi] = [(int(d[x - lo - 1]), x, y) for x, y in zip(cuts, cuts[1:])]
            todo += [(x, y) for _, x, y in self.children[lo, hi]]
        #: The tree's fingerprints in ``order``; the group of each place as its smallest known member (of places, fully followed).
        self.sorted = self.values[self.order]
        self.group = np.arange(len(self.values))

    def distance(self, some: np.ndarray, one: int) -> np.ndarray:
        return np.bitwise_count(self.values[some] ^ self.values[one]).astype(np.int64)

    def within(self, value: int) -> list[int]:
        """All members within the radius."""
        out, todo, value = [], [(0, len(self.values))], np.uint64(value)
        while todo:
            lo, hi = todo.pop()
            inner = self.children.get((lo, hi))
            d = np.bitwise_count(self.sorted[lo : lo + 1 if inner else hi] ^ value).astype(np.int64)
            out += self.order[lo + np.flatnonzero(d <= self.radius)].tolist()
            todo += [(x, y) for k, x, y in inner or () if abs(int(d[0]) - k) <= self.radius]
        return out

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Make one group of the groups of each pair of places."""
        group = self.group
        while True:
            x, y = group[a], group[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = (v[apart] for v in (a, b, x, y))
            np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
            while (group[group] != group).any():
                group[:] = group[group]

    def link(self) -> None:
        """Unite all that is linked. Each place searches what stands after it, so that a pair is met once."""
        todo = [(0, len(self.sorted), np.arange(len(self.sorted)))]
        while todo:
            lo, hi, asking = todo.pop()
            whole = self.group[lo]
            if (self.group[lo:hi] == whole).all():
                asking = asking[self.group[asking] != whole]
            if not len(asking):
                continue
            if (inner := self.children.get((lo, hi))) is None:
                for at in range(0, len(asking), BLOCK):
                    some = asking[at : at + BLOCK]
                    near = np.bitwise_count(self.sorted[some, None] ^ self.sorted[None, lo:hi]) <= self.radius
                    a, b = np.nonzero(near)
                    self.unite(some[a], lo + b)
                continue
            d = np.bitwise_count(self.sorted[asking] ^ self.sorted[lo]).astype(np.int64)
            linked = asking[d <= self.radius]
            self.unite(linked, np.full(len(linked), lo))
            # Of a pair of places the one that stands first searches for the other, in one leaf both do.
            todo += [(x, y, asking[(np.abs(d - k) <= self.radius) & (asking < y)]) for k, x, y in inner]

    def forest(self) -> Iterator[tuple[int, int]]:
        """Each linked member with one that stands for its group."""
        for i in np.flatnonzero(self.group != np.arange(len(self.group))).tolist():
            yield int(self.sorted[i]), int(self.sorted[self.group[i]])


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in each run of equal shards; a run may go over several batches."""
    claim()
    rest_keys, rest_values = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.array([0])
        u, v = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                tree = BKTree(np.unique(values[a:b]).view(np.uint64))
                tree.link()
                for x, y in tree.forest():
                    u.append(x)
                    v.append(y)
        if not u:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    for batch in batches:
        keys = np.concatenate([rest_keys, batch.column(0).to_numpy()])
        values = np.concatenate([rest_values, batch.column(1).to_numpy()])
        if not len(keys):
            continue
        at = int(np.searchsorted(keys, keys[-1]))  # keys are sorted; the last run may go on
        rest_keys, rest_values = keys[at:], values[at:]
        if (out := links(keys[:at], values[:at])) is not None:
            yield out
    if (out := links(rest_keys, rest_values)) is not None:
        yield out


def bands_for(n: int, radius: int = RADIUS) -> int:
    """Bands for n distinct fingerprints: as few as keep an even share of them in a shard under ``EVEN``."""
    bands = radius + 1
    while n > EVEN * 2 ** (64 * (bands - radius) // bands) and bands < 3 * (radius + 1):
        bands += 1
    return bands


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, bands: int = RADIUS + 1) -> DataFrame:
    """Distinct ``fp`` -> (u, v): a spanning forest of each shard's links.

    Of ``bands`` bands, two linked fingerprints agree in all but ``radius`` at least: each choice of so many makes a shard key.
    """
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    values = [F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - b + a) for a, b in zip(cuts, cuts[1:])]
    keys = F.array(*(F.xxhash64(F.lit(i), *chosen) for i, chosen in enumerate(combinations(values, bands - radius))))
    rows = fps.select("fp", F.explode(keys).alias("shard"))  # shards whose hashes are equal share a tree
    large = rows.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.ceil(F.col("count") / max(1, shard // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, own).cast("long") * F.col("blocks") + F.greatest(j, own))
    part = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("part")
    keyed = rows.join(large, "shard", "left").select("fp", "shard", part).select(F.xxhash64("shard", "part").alias("shard"), "fp")
    return keyed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links_of_sorted, "u long, v long")


def grouped(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id, root (a fingerprint that stands for the group) and the columns of ``more`` of every row of ``docs``."""
    fps = written(fingerprints(docs, more=more), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    found = written(links(first.select("fp"), bands=bands_for(first.count())), "links")
    roots = connected_components(found)
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select("root").distinct().select(F.col("root").alias("fp"), "root"))
    # A component may hold a third of all fingerprints: it is met in SALTS parts, each of which gets the whole's smallest id.
    linked = linked.join(first, "fp").select("fp", "first", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    parts = linked.groupBy("root", "salt").agg(F.min("first").alias("first"))
    least = parts.select("root", "salt").join(parts.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    named = linked.join(least, ["root", "salt"]).select("fp", "root", "component_id")
    of = first.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    of = written(of, "classes")
    return fps.join(of, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates; rows without an id stay as they are.

    It is one with the group's smallest id; of several, that whose text has the smallest hash, and of those
    the one whose other columns come first as JSON. Where rows of one id belong to several groups, each group keeps its row.
    A row travels as one struct, so its other columns may have any names and types.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    hashed = docs.where("doc_id is not null").select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("hash"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("rest"))
    of = grouped(docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("hash")), ("hash",))
    kept = of.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash")).select("doc_id", "hash").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("rest"))  # the join's partitioning serves
    once = hashed.join(kept, ["doc_id", "hash"], "left_semi").withColumn("place", place).where("place = 1")
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).union(docs.where("doc_id is null"))
