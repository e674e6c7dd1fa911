"""The prefix trie against a plain trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from assay.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, path int, h binary"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "n", 1, b"h") for r in rows], SCHEMA).repartition(parts)


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    """Rows of every node, by following each conversation down."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(of) - 1) * words
    ends = {node: ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(node)) for node, of in members.items()}
    return sorted((min(of), len(n), min(members[n[:-1]]) if n else -1, len(of), kids[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, of in members.items())


def got(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def tangled(seed, convs=90, most=9, words="ab"):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(200), convs):
        for t in range(rng.randint(0, most)):
            text = rng.choice([None, "", rng.choice(words), rng.choice(words) + " x\ty", rng.choice(words) * 3])
            rows.append((c, rng.choice([None, t, t, t // 2]), rng.choice([None, "user"]), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 2)
    monkeypatch.setattr(pt, "CHUNK", 16)
    rows = [*tangled(seed), *tangled(seed)[:40], (None, 1, "user", "lost"), (-41, 0, "user", "a"), (-41, 1, "user", "b")]
    convs = ordered(rows)
    # Truncated division, as in SQL: -41 belongs to -40.
    want = {c: v for c, v in rebuilt({c: v for c, v in convs.items() if c >= 0}).items()}
    h = zlib.crc32(b"-41") % 4
    want[-41] = convs[-41][h:]
    assert got(pt.rebuilt_trie(frame(spark, rows))) == plain(want)


def test_plain_walks_and_deep_light_paths(spark, monkeypatch):
    """A binary tree has as many levels as it has depths; its paths are summed level by level."""
    monkeypatch.setattr(pt, "BLOCK", 3)
    rows = [(c, t, "user", f"{c >> (4 - t) & 1} w") for c in range(32) for t in range(5)]
    rows += [(100 + c, t, "user", "same text") for c in range(50) for t in range(7)]
    assert got(pt.prefix_trie(*pt.plain_walks(pt.turns(frame(spark, rows))))) == plain(ordered(rows))


def test_long_conversation_over_many_tasks(spark):
    """One conversation holds most turns: it is sorted, hashed and summed in many tasks."""
    rows = [(7, t, "user", f"turn {t // 3}") for t in range(4000)] + [(c, t, "user", f"turn {t // 3}") for c in (8, 27, 60) for t in range(40)] + [(61, 0, "user", "word " * 200_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = pt.turns(frame(spark, rows, 6))
        conv = {r["pos"]: (bytes(r["t"]), bytes(r["h"])) for r in turns.where("conv_id = 7").collect()}
        parts = pt.written(turns, "t").where("conv_id = 7").count()
        nodes = got(pt.rebuilt_trie(frame(spark, rows, 6)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == len(conv) == 4000
    x = 0
    for pos in range(4000):
        x = (x * pt.BASE + int.from_bytes(conv[pos][0])) % pt.MOD
        assert conv[pos][1] == x.to_bytes(16)
    want = rebuilt(ordered(rows))
    depths = defaultdict(set)
    for c, v in want.items():
        for d in range(len(v) + 1):
            depths[tuple(v[:d])].add(c) if d < 45 else None
    assert len(nodes) == 1 + len({tuple(v[:d]) for v in want.values() for d in range(1, min(len(v), 50) + 1)}) + sum(max(0, len(v) - 50) for v in want.values())
    root = next(n for n in nodes if n[1] == 0)
    assert root[3] == 5 and root[5] == len({tuple(v) for v in want.values()} - {tuple(v[:d]) for v in want.values() for d in range(len(v))})


def test_turnless_and_empty(spark):
    """Conversations that lose all turns are members of the root; without conversations there is no root."""
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:6]
    rows = [(c, 0, "user", "only turn") for c in ids]
    assert got(pt.rebuilt_trie(frame(spark, rows))) == plain(rebuilt(ordered(rows))) == [(min(ids), 0, -1, 6, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
    assert got(pt.rebuilt_trie(frame(spark, rows).limit(0))) == []
    assert got(pt.rebuilt_trie(frame(spark, [(None, 1, "user", "x")]))) == []
