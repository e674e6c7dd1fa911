"""SimHash groups and repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from assay.llm import simhash, substring_dedup
from assay.llm.components import connected_components


def signed(values):
    return [int(x) for x in np.array(values, dtype=np.uint64).view(np.int64)]


def clusters(seed):
    rng, out = random.Random(seed), []
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6, 40])):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return list(dict.fromkeys(out))


def groups_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("leaf", "block"), [(256, 1024), (1, 1), (7, 3)])
def test_tree(monkeypatch, leaf, block):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = clusters(1)
    tree = simhash.BKTree(values)
    tree.link()
    for v in values[::7]:
        assert sorted(tree.within(v)) == [j for j, w in enumerate(values) if (v ^ w).bit_count() <= 4]
    of = dict(tree.forest())
    mine, theirs = defaultdict(set), defaultdict(set)
    for v, g in zip(values, groups_of(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4)):
        mine[of.get(v, v)].add(v)
        theirs[g].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_shards():
    """40,000 random fingerprints, and as many in one dense group, in a tree."""
    rng = np.random.default_rng(5)
    loose = np.unique(rng.integers(0, 2**64, 40_000, np.uint64))
    loose[1::1000] = loose[::1000] ^ np.uint64(0b1111)
    tree = simhash.BKTree(loose)
    tree.link()
    assert {frozenset(x) for x in tree.forest()} == {frozenset((int(x), int(x) ^ 0b1111)) for x in loose[::1000]}
    bits = np.uint64(1) << rng.integers(0, 64, (40_000, 3), np.uint64)
    dense = np.unique(np.bitwise_xor.reduce(bits, axis=1))
    tree = simhash.BKTree(dense)
    tree.link()
    assert len(set(tree.group.tolist())) == 1 and len(list(tree.forest())) == len(dense) - 1


def test_bands():
    assert [simhash.bands_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]


@pytest.mark.parametrize(("shard", "bands"), [(40_000, 5), (6, 5), (40_000, 6), (3, 7)])
def test_links_and_components(spark, shard, bands):
    values = clusters(2)
    df = spark.createDataFrame([(v,) for v in signed(values)], "fp long")
    root = {r.node: r.root for r in connected_components(simhash.links(df, shard=shard, bands=bands)).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for i, (v, g) in enumerate(zip(signed(values), groups_of(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 4))):
        mine[root.get(v, v)].add(i)
        theirs[g].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {i: 0 for i in range(1, n + 1)}
    assert connected_components(edges.limit(0)).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(300))
        docs.append((i * 3 + 2, text))
        for k in range(rng.choice([0, 1, 3])):
            w = text.split()
            w[rng.randrange(300)] = "edit"
            docs.append((i * 3 + k, " \t".join(w).upper() if k else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "A b"), (503, "a  B"), (None, "a b"), (None, None), (7, "a b"), (504, "Ünï cödé wörds here")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, fp string, component_id string")
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = groups_of(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {r: min((d[0] for d, q in zip(docs, roots) if q == r and d[0] is not None), default=None) for r in roots}
    want = sorted(((d[0], f"{f:016x}", least[r]) for d, f, r in zip(docs, fps, roots)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want
    kept = [r.doc_id for r in simhash.one_of_each(df).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for i, _, c in want if c is not None and i is not None and i == c})
    assert kept.count(None) == 2
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def brute(docs, length):
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            if d is not None:
                first[tuple(w[i : i + length])] = min(first.get(tuple(w[i : i + length]), d), d)
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "日本"]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 140))) for _ in range(6)]
    docs = []
    for i in range(100):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 70))))
            if rng.random() < 0.1:
                parts.append("rep eat " * rng.randint(10, 400))
        text = rng.choice(docs)[1] if docs and rng.random() < 0.2 else "\n ".join(parts)
        docs.append((rng.choice([i, i, i, i // 2, 1000 - i]), text))
    return docs + [(5, None), (None, shared[0]), (None, None), (7, "")]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    docs = passages(hot)
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, sha string")
    assert sorted((tuple(r) for r in substring_dedup.dedup_digest(df).collect()), key=str) == brute(docs, 50)
    assert substring_dedup.dedup_digest(df.limit(0)).collect() == []


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    docs = passages(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.dedup_digest(df).collect()), key=str) == brute(docs, 50)


@pytest.mark.parametrize("same_keys", [False, True])
def test_shards_alone(monkeypatch, same_keys):
    """Owners of windows by brute force, in one lot and in three; also where different windows share a hash."""
    if same_keys:
        monkeypatch.setattr(substring_dedup, "_window_keys", lambda text, window: text % 2)
    rng = random.Random(6)
    for _ in range(30):
        regions = list(dict.fromkeys(" ".join(rng.choice("abc") for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 12))))
        owners, length = sorted(rng.randint(0, 50) for _ in regions), rng.choice([3, 5])
        least = {}
        for r, o in zip(regions, owners):
            w = r.split()
            for i in range(len(w) - length + 1):
                least[tuple(w[i : i + length])] = min(least.get(tuple(w[i : i + length]), o), o)
        for lots in (1, 3):
            shard, got = substring_dedup.Shard(length), []
            for k in range(lots):
                a, b = len(regions) * k // lots, len(regions) * (k + 1) // lots
                if a < b:
                    got += shard.least(regions[a:b], owners[a:b])
            for r, found in zip(regions, got):
                w, mine = r.split(), {}
                for a, b, o in found:
                    assert not mine.keys() & set(range(a, b + 1))
                    mine |= dict.fromkeys(range(a, b + 1), o)
                assert mine == {i: least[tuple(w[i : i + length])] for i in range(len(w) - length + 1)}


def test_index_is_small():
    """The index keeps few bytes of a word, its text not among them."""
    rng = np.random.default_rng(0)
    index = substring_dedup.FMIndex([rng.integers(1, 2**15, 300) for _ in range(300)], np.arange(300))
    held = sum(x.words.nbytes + x.before.nbytes for x in [*index.levels, index.sampled]) + index.number.nbytes
    assert held < 4 * index.size


def test_text_ids_and_long_texts(spark):
    rng = random.Random(8)
    some = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    long = " ".join(f"x{rng.randrange(9000)}" for _ in range(60_000))
    docs = [("b", some), ("a", long + " " + some), ("c", some + " end"), ("d", long)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_digest(df).collect()}
    assert got == {"a": (60_120, 0), "b": (120, 120), "c": (121, 120), "d": (60_000, 60_000)}


def test_repeated_ids(spark):
    """Each group keeps one row, and the same one whatever the partitions: two groups share the id 1."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(1, text("a")), (1, text("b")), (1, text("a")), (2, text("a")), (3, text("c")), (None, text("c")), (None, text("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((tuple(r) for r in simhash.one_of_each(df.repartition(n)).collect()), key=str) for n in (1, 5)]
    assert got[0] == got[1] and got[0] == sorted([(1, text("a")), (1, text("b")), (3, text("c")), (None, text("c")), (None, text("c"))], key=str)
    cut = sorted((tuple(r) for r in substring_dedup.without_repeats(df).collect()), key=str)
    assert cut == sorted([(1, text("a")), (1, text("b")), (1, text("a")), (2, ""), (3, text("c")), (None, text("c")), (None, text("c"))], key=str)


def test_repeated_ids_of_other_groups(spark):
    """The row that stays for an id is one of the group that the id stands for."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    for k in range(8):  # some of the hashes put the other group's text first
        rows = [(1, text("a")), (2, text("a")), (2, text(f"b{k}")), (3, text(f"b{k}"))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in simhash.one_of_each(df).collect()) == [(1, text("a")), (2, text(f"b{k}"))]
