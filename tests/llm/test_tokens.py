"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from assay.llm import bpe, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")
ALPHABET = list("ab é\n  \t'stld09¹ß漢字😀　\xa0\x1c\x85​-!?<|>") + ["<|endoftext|>", " the", "ation", "'s", "\r\n"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_encode_as_library(codec, library):
    for t in [*texts(1500, 60, 1), "", "antidisestablishmentarianism " * 50, "x" * 5000, "'" * 999, "zqxj" * 800]:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_forgetting_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 16)
    monkeypatch.setattr(bpe, "LOOK", 8)
    some = texts(200, 60, 2)
    for t in some:
        assert codec.encode(t) == library.encode_ordinary(t)
    monkeypatch.setattr(bpe, "GROUP", 100)
    assert [x.tolist() for x in codec.encode_all([*some, None])] == [*map(library.encode_ordinary, some), []]


def test_long_words(codec, library):
    """Words read by themselves, some bytes at a time."""
    rng = random.Random(9)
    for n in (63, 64, 65, 128, 129, 700):
        for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "é漢aß"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert codec.encode(t) == library.encode_ordinary(t)


def test_tokens_come_off_edges(codec, library):
    """Words that are no tokens themselves: tokens are those of the edges taken, within bounded lookahead; words beside each other share states."""
    t = bpe.Transducer(codec.transducer.ranks)
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 150))).encode() for _ in range(400)]
    words = [w for w in words if w not in t.ranks]
    encoded = [np.frombuffer(x, np.int32).tolist() for x in t.encode(words)]
    longest = max(map(len, t.ranks))
    for word, tokens in zip(words, encoded):
        assert tokens == library._encode_single_piece(word)
        state, emitted = 0, []
        for at, symbol in enumerate((*word, bpe.END), 1):
            edge = t.edge_of[state << 9 | symbol]
            state = t.target[edge]
            emitted += t.tokens[t.begin[edge] : t.begin[edge] + t.count[edge]].tolist()
            open_bytes = at - sum(t.length[x] for x in emitted)
            assert symbol == bpe.END or open_bytes == len(t.states[state][1]) - 1 <= 3 * longest
        assert emitted == tokens and state == 0
    assert len(t.states) < sum(map(len, words))  # of random letters; some 0.6
    before = len(t.states), len(t.target)
    assert t.encode(words) == t.encode(words) and (len(t.states), len(t.target)) == before


def test_states_are_bounded(codec, library, monkeypatch):
    """Forgotten states, also amid a long word, change nothing."""
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe, "SLOTS", 16)
    t = bpe.Transducer(codec.transducer.ranks)
    rng = random.Random(13)
    for n in (5, 30, 64, 65, 900):
        words = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(n)).encode() for _ in range(12)]
        assert [np.frombuffer(x, np.int32).tolist() for x in t.encode(words)] == [library._encode_single_piece(w) for w in words]
    word = "".join(rng.choice("abcdeghilmnoprstu") for _ in range(3000)).encode()
    assert np.frombuffer(t.encode([word])[0], np.int32).tolist() == library._encode_single_piece(word)
    assert len(t.states) <= 52


def test_pairs_by_merging(codec):
    """The seam test agrees with merging the two tokens' bytes."""
    rng, t = random.Random(3), codec.transducer
    ids = list(t.token)
    short = [i for i in ids if len(t.token[i]) < 3]
    pairs = [(rng.choice(short), rng.choice(ids if rng.random() < 0.5 else short)) for _ in range(20_000)]
    for a, b in pairs:
        both = t.token[a] + t.token[b]
        assert t.pair(a, b) == (both not in t.ranks and bpe.merge_by_rank(both, t.ranks) == [a, b])


def test_utf8_machine():
    """Any split of any bytes decodes as the whole does, with a replacement for each malformed part."""
    rng = random.Random(4)
    for _ in range(300):
        raw = "".join(rng.choice("aé漢😀") for _ in range(6)).encode()
        machine, state, out, at = bpe.Utf8(), b"", "", 0
        while at < len(raw):
            to = min(len(raw), at + rng.randint(1, 3))
            text, state = machine.feed(state, raw[at:to])
            out, at = out + text, to
        assert out.encode() == raw and not state
    assert bpe.Utf8().feed(b"", b"\xc0\xaf\xed\xa0\x80\xf4\x90a")[0].endswith("a")
    assert bpe.Utf8().feed(b"\xe6\xbc", b"a") == ("�a", b"")


def test_digest_query(spark, library):
    rows = [(1, "the théâtre"), (1, "the théâtre"), (2, None), (3, ""), (None, "x" * 70_000), (4, " \n ")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    got = sorted((tuple(r) for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []
    both = bpe.decode_documents(bpe.encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(r.decoded for r in both.collect()) == sorted(t or "" for _, t in rows)
    assert sorted(r.ids for r in both.collect()) == sorted(r.ids for r in bpe.round_trip(df, RANKS, P.PATTERN, with_ids=True).collect())


def test_counts_as_library(spark):
    counter = token_count.Counter.of(P.path("byte_bpe_50k.json"))
    some = texts(800, 80, 5) + ["a" * 3000, " " * 500, "word " * 900, "12ab" * 400, "", "<|endoftext|> " * 90]
    for t in some:
        want = len(counter.tokenizer.encode(t, add_special_tokens=False))
        assert [counter.count(t, *sizes) for sizes in ((16, 4), (200, 8), (1024, 64))] == [want] * 3
    size = token_count.CHUNK
    rng = random.Random(7)
    words = lambda n: "".join(rng.choice(ALPHABET) + rng.choice(("a", "the", " ", "")) for _ in range(n))
    some += [words(3 * size)[:n] for n in (size - 1, size, size + 1, 2 * size)] + [words(65_536)[:n] for n in (65_535, 65_536, 65_537)]
    some += ["x" * (5 * size), "y" * (5 * size) + " z" * size, words(300_000), None]
    rows = [(i, t, 1) for i, t in enumerate(some)] + [(3, some[3], 2), (None, "a b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_count.token_counts(df, P.path("byte_bpe_50k.json")).collect()), key=str)
    count = lambda t: len(counter.tokenizer.encode(t or "", add_special_tokens=False))
    assert got == sorted(((i, len((t or "").encode()), n := count(t), n > 512) for i, t, _ in rows), key=str)
    assert token_count.token_counts(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []
