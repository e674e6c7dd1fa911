"""The trie of conversation prefixes, its subtrees summed by heavy-path decomposition.

Every sequence of first turns is a node. A node's key is a polynomial hash of its turns modulo 2^127 - 1,
each turn standing for the first 128 bits of a SHA-256, so keys of prefixes come from a prefix scan:
turns are sorted over all tasks by conversation, each task scans what it has, and what stands before
a task's first turn is added afterwards. A conversation of any length is scanned by many tasks.

The child with most members is a node's heavy child; nodes joined by heavy edges are a path. The bottom of a
path is a leaf, and the path is the end of that leaf's walk from its last light edge on, so a path is found by one
aggregation over the walks of the leaves, and its level is the number of light edges above. As a light child has half its
parent's members at most, levels are at most the logarithm of the number of conversations. Paths are arrays
by depth, cut into blocks of ``BLOCK``; sums run along them from the bottom (block sums first, then inside the
blocks), level by level from the deepest, and a path's whole sum is attached to the parent of its top.

Defined results: turns are ordered by ``turn`` (null first), those of one turn by the hash of role and text; repeated rows are turns
of their own. Null role or text is empty. Rows without a conversation id take no part. A conversation whose rebuilt
form has no turns is a member of the root only. An empty table has no nodes, not even a root. Texts are only hashed
and their words counted, so long ones cost their length; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import WORD_SQL, written

#: Fixed: the hash's modulus and base, and the base's inverse.
MOD = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15])
BACK = pow(BASE, -1, MOD)
ROOT = bytes(16)

#: Positions of a path in a block; ids in a chunk of a node's list of members.
BLOCK, CHUNK = 1_024, 4_096

_key = lambda x: x.to_bytes(16)
_num = int.from_bytes


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix hash of each turn among those of its conversation in this task; rows come sorted."""
    part, now, place, hashed = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        places, hashes = [], []
        for conv, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if conv != now:
                now, place, hashed = conv, 0, 0
            hashed = (hashed * BASE + _num(turn)) % MOD
            places.append(place)
            hashes.append(_key(hashed))
            place += 1
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), _binary(hashes)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "t", "words", "part", "place", "h"])


def _carry(parts: pa.Table) -> pa.Table:
    """What stands before each task's turns of one conversation: their number and hash."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["part"])
    before, hashed, out = 0, 0, []
    for r in rows:
        out.append({"conv_id": r["conv_id"], "part": r["part"], "before": before, "carried": _key(hashed)})
        before, hashed = before + r["n"], (hashed * pow(BASE, r["n"], MOD) + _num(r["h"])) % MOD
    return pa.Table.from_pylist(out, schema=pa.schema([("conv_id", parts.schema.field("conv_id").type), ("part", pa.int32()), ("before", pa.int64()), ("carried", pa.binary())]))


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix hash over all tasks, of rows (..., place, h, before, carried)."""
    for batch in batches:
        names = batch.schema.names
        place, h, before, carried = (batch.column(names.index(c)).to_pylist() for c in ("place", "h", "before", "carried"))
        whole = [x if c is None else _key((_num(c) * pow(BASE, p + 1, MOD) + _num(x)) % MOD) for p, x, c in zip(place, h, carried)]
        pos = [p + (b or 0) for p, b in zip(place, before)]
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in ("conv_id", "t", "words")), pa.array(pos, pa.int64()), _binary(whole)], names=["conv_id", "t", "words", "pos", "h"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, t (the turn's 16 bytes), words, pos (from 0) and h (hash of the turns up to this one), for each turn in order."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"), F.regexp_count(text, F.lit(WORD_SQL)).cast("long").alias("words"), "turn", F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "words")
    local = written(placed.mapInArrow(_scan, f"conv_id {kind}, t binary, words long, part int, place long, h binary"), "turns")
    # Only a task's first and last conversation can go on elsewhere: rows to carry are at most twice the tasks.
    torn = local.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id")
    pieces = local.join(F.broadcast(torn), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("h", "place").alias("h"))
    carry = written(pieces.groupBy("conv_id").applyInArrow(_carry, f"conv_id {kind}, part int, before long, carried binary"), "carried")
    return local.join(F.broadcast(carry), ["conv_id", "part"], "left").mapInArrow(_shifted, f"conv_id {kind}, t binary, words long, pos long, h binary")


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a turn's node and its parent: a head's own, or the turns of a conversation after its first ``h``, put after another beginning."""
    for batch in batches:
        names = batch.schema.names
        column = lambda c: batch.column(names.index(c)).to_pylist()
        nodes, parents = [], []
        for t, hashed, after, own, begin in zip(column("t"), column("h"), column("after"), column("own"), column("begin")):
            x = _num(hashed)
            if after is not None:
                x = (x + ((_num(begin) if begin else 0) - (_num(own) if own else 0)) * pow(BASE, after, MOD)) % MOD
            nodes.append(_key(x))
            parents.append(_key((x - _num(t)) * BACK % MOD))
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in ("conv_id", "depth", "words")), _binary(nodes), _binary(parents)], names=["conv_id", "depth", "words", "node", "parent"])


def plain_walks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, walks) of ``turns`` as they are: a row for each turn, with the key of its node and of that one's parent."""
    kept = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "words", "t", "h", *(F.lit(None).cast(k).alias(c) for c, k in (("after", "long"), ("own", "binary"), ("begin", "binary"))))
    return rows.select("conv_id").distinct(), kept.mapInArrow(_extended, _walk_schema(rows))


def rebuilt_walks(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``plain_walks``, where each conversation c begins with the first crc32(c) % most turns of c - c % every instead of its own."""
    first = rows.where(F.col("pos") < most - 1).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("h", "t", "words")))).alias("first"))
    ids = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("cut"))
    joined = ids.join(first, "conv_id", "left").join(first.select(F.col("conv_id").alias("base"), F.col("first").alias("of_base")), "base", "left")
    begun = F.least("cut", F.coalesce(F.size("of_base"), F.lit(0))).cast("long")
    at = lambda m, i: F.when(i > 0, F.try_element_at(m, i - 1)["h"])
    convs = written(joined.withColumn("begun", begun).select("conv_id", "cut", "begun", "of_base", at(F.col("first"), F.col("cut")).alias("own"), at(F.col("of_base"), F.col("begun")).alias("begin")), "conversations")
    heads = convs.where("begun > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("begun") - 1)).alias("pos"), "of_base").withColumn("turn", F.col("of_base")[F.col("pos")])
    none = [F.lit(None).cast(k).alias(c) for c, k in (("after", "long"), ("own", "binary"), ("begin", "binary"))]
    heads = heads.select("conv_id", (F.col("pos") + 1).alias("depth"), "turn.words", "turn.t", "turn.h", *none)
    after = (F.col("pos") - F.col("cut") + 1).alias("after")
    tails = rows.join(convs.select("conv_id", "cut", "begun", "own", "begin"), "conv_id").where("pos >= cut").select("conv_id", (F.col("begun") + after).alias("depth"), "words", "t", "h", after, "own", "begin")
    return convs.select("conv_id"), heads.unionByName(tails).mapInArrow(_extended, _walk_schema(rows))


def _walk_schema(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, depth long, words long, node binary, parent binary"


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks joined by commas; rows come sorted by node and chunk, a node may go over batches."""
    now, sha = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == now:
                sha.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    digests.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([_binary(nodes), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([_binary([now]), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def _ends(convs: DataFrame, walks: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end in each node. Ids are put into text in chunks of ``CHUNK`` by many tasks; one task only digests a node's chunks in turn."""
    last = walks.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"), F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
    chunks = ends.groupBy("node", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_digest_lists, "node binary, ends_sha256 string")


def trie(convs: DataFrame, walks: DataFrame) -> DataFrame:
    """The nodes of ``walks``: key, parent's key, conv_id, depth, members, children, last turn's words, heavy or not, digest of the members that end there."""
    walks = written(walks, "walks")
    nodes = walks.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = written(nodes.unionByName(root.select(F.lit(ROOT).alias("node"), "conv_id", "n_convs", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"))), "nodes")
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.max_by("node", F.struct("n_convs", "node")).alias("heavy"))
    kids = written(kids, "kids")
    heavy = kids.select(F.col("heavy").alias("node"), F.lit(True).alias("is_heavy"))
    own = nodes.join(kids.select(F.col("parent").alias("node"), "n_children"), "node", "left").join(heavy, "node", "left").join(_ends(convs, walks), "node", "left")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return walks, written(own.join(above, "parent", "left").withColumns({"n_children": F.coalesce("n_children", zero), "is_heavy": F.coalesce("is_heavy", F.lit(False)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))}), "trie")


def paths(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path`` (the conversation of the leaf that its heavy path ends in), ``level`` (light edges above the path) and ``top`` (depth of the path's first node)."""
    leaves = nodes.where("n_children = 0").select("conv_id")
    light = nodes.where("not is_heavy").select("node", F.lit(True).alias("light"))
    steps = walks.join(leaves, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), "depth", "node")
    tops = steps.join(light, "node").groupBy("path").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("level"))
    tops = leaves.select(F.col("conv_id").alias("path")).join(tops, "path", "left").select("path", F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("level", F.lit(0)).alias("level"))
    on = steps.join(tops, "path").where("depth >= top").select("node", "path", "level", "top")
    root_path = tops.where("level = 0").select(F.lit(ROOT).alias("node"), "path", "level", "top")
    return nodes.join(on.unionByName(root_path), "node")


def _suffix_sums(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``values`` summed from the bottom of each path up to the node: block sums first, then inside the blocks."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(*(F.sum(v).alias(v) for v in values)).select("path", "block", *(F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"{v}_below") for v in values))
    inside = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(v).over(inside).alias(f"{v}_inside") for v in values)).join(blocks, ["path", "block"])
    return summed.withColumns({v: F.col(f"{v}_inside") + F.col(f"{v}_below") for v in values}).select(*(c for c in rows.columns if c != "block"))


def subtree_sums(placed: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """``placed`` (of ``paths``) with each of ``values`` summed over the node's subtree, a round for each level from the deepest."""
    placed = written(placed, "placed")
    deepest = placed.agg(F.max("level")).first()[0]
    done, attached = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        rows = placed.where(F.col("level") == level)
        if attached is not None:
            light = attached.select(F.col("parent").alias("node"), *(F.col(v).alias(f"{v}_light") for v in values))
            rows = rows.join(light, "node", "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"{v}_light"), F.lit(0)) for v in values}).select(*placed.columns)
        done.append(written(_suffix_sums(rows, values), f"level-{level}"))
        attached = done[-1].where("depth = top and parent is not null").groupBy("parent").agg(*(F.sum(v).alias(v) for v in values))
    if not done:
        return placed
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(convs: DataFrame, walks: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    walks, nodes = trie(convs, walks)
    own = paths(walks, nodes).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    return subtree_sums(own, ("n_leaves", "saved_tokens")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt_walks(turns(conversations)))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
SQL = f"""
WITH o AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), r AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:({_CRC.replace("conv_id", "o.conv_id")}) % 4], []), o.turns[({_CRC.replace("conv_id", "o.conv_id")}) % 4 + 1:]) AS turns
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20
), w AS (SELECT conv_id, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent, d = len(turns) AS ends, turns[d].text AS text FROM r, unnest(range(0, len(turns) + 1)) u(d)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM w GROUP BY node, depth
), k AS (SELECT depth - 1 AS depth, parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent, depth),
s AS (
  SELECT w.node, w.depth, sum(CASE WHEN k.parent IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE n.words END) AS saved_tokens
  FROM n JOIN w ON w.conv_id = n.conv_id AND w.depth <= n.depth LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth GROUP BY w.node, w.depth
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node AND s.depth = n.depth LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth
LEFT JOIN n p ON n.depth > 0 AND p.node = n.parent AND p.depth = n.depth - 1
"""
