"""Substring deduplication: word windows that begin in an earlier document are removed.

1. Anchors. A window of ``WINDOW`` words is represented by the smallest hash among its ``GRAM``-word
   grams, so that equal windows have equal anchors wherever they stand. Neighbouring windows
   with one anchor make a region. Documents with all words equal are settled by their hash.
2. Routing. Anchors seen in one document only are done with. Regions of the others are cut from
   the texts, copies of a region are merged (smallest doc_id kept), and all regions of
   an anchor go to one shard, which reads them in lots of ``SHARD_WORDS`` words. Of an anchor
   in more than ``HOT`` documents, each window is routed by its own hash instead.
3. Matching. Of windows with one hash, a shard indexes the one with the smallest doc_id: the first
   documents' text, each window once. Its FM-index is a wavelet matrix of packed bits over the Burrows-Wheeler
   transform, with segment numbers at sampled positions; the text isn't kept. All other windows are streamed
   through it by backward search; the intervals in which the matching statistic reaches WINDOW words are
   reported with the doc_id of the segment matched. Words are compared, not hashes: a window that only
   shares its hash finds no match and gets an index of its own. An anchor's later lots are streamed
   through the indexes of the earlier ones, which hold smaller doc_ids.
4. Windows whose smallest doc_id is under their own document's are covered; their words go.

Null texts have no words, and texts under WINDOW words lose nothing. A null doc_id is neither smaller nor
larger than another, so such rows lose and take nothing. Rows that repeat a doc_id don't count
against each other. A text of any length is cut into regions; an empty table gives an empty one, and other
columns are not read. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from assay.llm.common import cache_of, claim, map_batches, short, written

WINDOW, GRAM = 50, 8
SHARD_WORDS, HOT, LONGEST_RUN, STREAM, SAMPLED = 300_000, 20_000, 256, 16, 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_HASHES = WordHashes()
cache_of("substrings", _HASHES.clear)


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(anchor, first window, last window) of each run of windows with one anchor."""
    if len(words) < window:
        return []
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        factor, size = _MULTIPLIER, 1
        while size < gram:  # gram is a power of two
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, size * 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    span, size = window - gram + 1, 1
    least = h
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(least) - 1]])
    out = []
    for a, p, q in zip(least[starts].view(np.int64).tolist(), starts.tolist(), ends.tolist()):
        for at in range(p, q + 1, LONGEST_RUN):
            out.append((a, at, min(at + LONGEST_RUN - 1, q)))
    return out


class PackedBits:
    """A bit vector with counts for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Over segments of symbols (1 and up), each with a number, no window of them twice. The text itself isn't kept: only the
    wavelet matrix of its Burrows-Wheeler transform, and the number of the segment at every ``SAMPLED``-th position."""

    def __init__(self, segments: list[np.ndarray], numbers: np.ndarray):
        size = np.array([len(x) for x in segments], dtype=np.int64)
        text = np.zeros(int(size.sum()) + len(segments), dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        for a, x in zip(start.tolist(), segments):
            text[a : a + len(x)] = x
        self.size = n = len(text)
        order = self._suffixes(text, start + size)
        counts = np.bincount(text)
        self.first = np.cumsum(counts) - counts
        self.levels: list[PackedBits] = []
        row = text[order - 1]
        for level in range(int(text.max()).bit_length() - 1, -1, -1):
            bits = ((row >> level) & 1).astype(np.uint8)
            self.levels.append(PackedBits(bits))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        self.origin = self._through(np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64))
        segment = np.repeat(np.arange(len(segments)), size + 1)[order]
        sampled = (order - start[segment]) % SAMPLED == 0
        self.sampled, self.number = PackedBits(sampled.astype(np.uint8)), numbers[segment[sampled]].astype(np.int32)

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix array by doubling. Each segment's end is a symbol of its own, below all words: suffixes differ at the latest there."""
        n, h = len(text), 1
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[:-h] = rank[h:] + 1
            key = rank * (int(following.max()) + 1) + following
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            if fresh[-1] == n - 1:
                return order
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            h *= 2

    def _through(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes when the levels are followed along the symbol's bits."""
        for depth, bits in enumerate(self.levels):
            ones = bits.ones(i)
            up = (symbol >> (len(self.levels) - 1 - depth)) & 1
            i = np.where(up == 1, bits.zeros + ones, i - ones)
        return i

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with ``symbol`` put before them; empty for symbols that the index doesn't have."""
        there = symbol < len(self.first)
        symbol = np.where(there, symbol, 0)
        base = self.first[symbol] - self.origin[symbol]
        both = self._through(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(low)], np.where(there, base + both[len(low) :], -1)

    def before(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that are one symbol longer; not for those that begin a segment."""
        symbol = np.zeros(len(row), dtype=np.int64)
        for bits in self.levels:
            up, ones = bits.at(row), bits.ones(row)
            symbol = symbol << 1 | up
            row = np.where(up, bits.zeros + ones, row - ones)
        return self.first[symbol] - self.origin[symbol] + row

    def numbers(self, row: np.ndarray) -> np.ndarray:
        """The numbers of the segments in which the suffixes of these rows begin."""
        out, todo = np.empty(len(row), dtype=np.int64), np.arange(len(row))
        while len(todo):
            known = self.sampled.at(row)
            out[todo[known]] = self.number[self.sampled.ones(row[known])]
            todo, row = todo[~known], self.before(row[~known])
        return out

    def intervals(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stream the ranges [begin, end) of ``text`` through the index, side by side, each from right to left.

        The matching statistic of a position is the length of the longest match that begins there. Returned are the intervals
        of positions where it reaches the window: first and last position, and the number of the segment matched. Where a match
        can't go on, the search begins anew with the next window's last word.
        """
        found: list[tuple[np.ndarray, ...]] = []
        ok = end - begin >= window
        begin, last = begin[ok], end[ok] - 1  # the first word of each range, the last one of the match
        at, low, high = last.copy(), np.zeros(len(last), dtype=np.int64), np.full(len(last), self.size)
        while len(at):
            to_low, to_high = self.backward(text[at], low, high)
            goes_on = to_low < to_high
            over = ~goes_on | (at == begin)
            row, first = np.where(goes_on, to_low, low), np.where(goes_on, at, at + 1)
            report = over & (last - first + 1 >= window)
            found.append((first[report], last[report] - window + 1, row[report]))
            low, high = np.where(goes_on, to_low, 0), np.where(goes_on, to_high, self.size)
            last = np.where(goes_on, last, np.minimum(last - 1, at + window - 1))
            at = np.where(goes_on, at - 1, last)
            live = (at >= begin) & (last - window + 1 >= begin)
            begin, last, at, low, high = (x[live] for x in (begin, last, at, low, high))
        first, until, row = (np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in range(3))
        return first, until, self.numbers(row)


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], cut + 1])], places[np.append(cut, len(places) - 1)]


class Shard:
    """Owners of the windows of regions that come in lots. Lots go on with the same anchor: of its regions, those with the smallest owners come first."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.reset()

    def reset(self) -> None:
        self.symbols: dict[str, int] = {}
        self.indexes: list[FMIndex] = []
        self.owners: list = []

    def least(self, regions: list[str], owners: list) -> list[list]:
        """For each region, (first window, last window, owner): the smallest owner among the regions of this and earlier lots that have the windows."""
        window, symbols = self.window, self.symbols
        coded = [[symbols.setdefault(w, len(symbols) + 1) for w in r.split(" ")] for r in regions]
        size = np.array([len(c) for c in coded], dtype=np.int64)
        start = np.cumsum(size) - size
        text = np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int(size.sum()))
        region = np.repeat(np.arange(len(size)), size)
        number = len(self.owners) + np.arange(len(owners))
        self.owners += owners
        place = {x: i for i, x in enumerate(sorted(set(owners)))}
        order = np.array([place[x] for x in owners], dtype=np.int64)
        open_ = np.flatnonzero(np.arange(len(text)) - start[region] <= size[region] - window)  # windows without an owner yet
        out: list[list] = [[] for _ in regions]

        def settle(first: np.ndarray, until: np.ndarray, which: np.ndarray) -> None:
            nonlocal open_
            done = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(done, first, 1)
            np.add.at(done, until + 1, -1)
            open_ = open_[np.cumsum(done)[open_] == 0]
            for a, b, x in zip(first.tolist(), until.tolist(), which.tolist()):
                r = region[a]
                out[r].append((a - int(start[r]), b - int(start[r]), self.owners[x]))

        def stream(index: FMIndex, places: np.ndarray) -> None:
            if len(places):
                a, b = _runs(places)  # they end with their region, as the next one's windows begin later than this one's last window
                # Cut short, as all are read side by side until the last one ends.
                pieces = -((a - b - 1) // STREAM)
                begin = np.repeat(a, pieces) + STREAM * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                settle(*index.intervals(text, begin, np.minimum(begin + STREAM - 1, np.repeat(b, pieces)) + window, window))

        for index in self.indexes:
            stream(index, open_)
        keys = _window_keys(text, window)
        while len(open_):
            # Of the windows with one key, that of the smallest owner is indexed, and the others are streamed. Should they
            # differ from it, they are left for another round.
            by = open_[np.argsort(order[region[open_]], kind="stable")]
            key = keys[by]
            sort = np.argsort(key, kind="stable")
            leads = np.ones(len(by), dtype=bool)
            leads[1:] = key[sort[1:]] != key[sort[:-1]]
            own = np.sort(by[sort[leads]])
            a, b = _runs(own)
            self.indexes.append(FMIndex([text[x : y + window] for x, y in zip(a.tolist(), b.tolist())], number[region[a]]))
            settle(a, b, number[region[a]])
            stream(self.indexes[-1], open_)
        return [sorted(x, key=lambda y: y[0]) for x in out]


def _window_keys(text: np.ndarray, window: int) -> np.ndarray:
    """A hash of the window that begins at each place; the last places' are of no use."""
    with np.errstate(over="ignore"):
        h = (text.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        size, factor = 1, _MULTIPLIER
        while size * 2 <= window:
            h, size, factor = h[:-size] * factor + h[size:] if len(h) > size else h[:0], size * 2, factor * factor
        out = np.zeros(len(text), dtype=np.uint64)
        n = len(text) - window + 1
        if n > 0:
            out[:n] = h[:n] * np.uint64(0x94D049BB133111EB) + h[window - size : window - size + n]
    return out


def _match(window: int, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        shard = Shard(window)
        keys: list[int] = []
        marks: list[int] = []
        regions: list[str] = []
        owners: list = []
        words = 0
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("owner", id_kind)]))

        def found() -> pa.RecordBatch:
            rows = [[{"from": a, "to": b, "owner": o} for a, b, o in found] for found in shard.least(regions, owners)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(rows, kind)], names=["a", "mark", "owners"])

        for batch in short(batches):
            for a, mark, region, owner in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if words >= SHARD_WORDS:
                    yield found()
                    if a != keys[-1]:
                        shard.reset()
                    keys, marks, regions, owners, words = [], [], [], [], 0
                keys.append(a)
                marks.append(mark)
                regions.append(region)
                owners.append(owner)
                words += region.count(" ") + 1
        if keys:
            yield found()

    return run


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def find_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, sha of its words, n_words, first doc_id with those words), and (doc_id, sha, text, spans to remove)."""

    def summary(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, shas, rows = batch.column(0), [], [], []
        for i, text in zip(ids.to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()
            counts.append(len(words))
            shas.append(_sha(words))
            rows.append([] if i is None else [{"a": a, "p": p, "q": q} for a, p, q in anchors(words, window)])
        runs = pa.list_(pa.struct([("a", pa.int64()), ("p", pa.int32()), ("q", pa.int32())]))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(shas, pa.binary()), pa.array(rows, runs)], names=["doc_id", "n_words", "sha", "anchors"])

    texts = docs.select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType
    kind = id_kind.simpleString()
    every = written(map_batches(texts, summary, f"doc_id {kind}, n_words long, sha binary, anchors array<struct<a:long,p:int,q:int>>", "substrings"), "anchors")
    long = every.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = written(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.min_by("anchors", "doc_id").alias("anchors")), "first")
    seen = first.select(F.col("first").alias("doc_id"), "sha", F.explode("anchors").alias("x")).select("doc_id", "sha", "x.*")
    shared = seen.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("a", (F.col("n") > HOT).alias("hot"))
    wanted = seen.join(shared, "a").groupBy("doc_id", "sha").agg(F.collect_list(F.struct("a", "p", "q", "hot")).alias("runs"))

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:  # rows that repeat a doc_id with another text met the wrong runs
        keep = [_sha((t or "").encode().split()) == s for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names=batch.schema.names)

    shape = f"doc_id {kind}, text string, sha binary, runs array<struct<a:long,p:int,q:int,hot:boolean>>"
    held = written(map_batches(texts.join(wanted, "doc_id"), own, shape).select("doc_id", "text", "sha", "runs"), "held").dropDuplicates(["doc_id", "sha"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        out: list[tuple] = []
        for doc, text, sha, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
            words = text.encode().split()
            for run in runs:
                if run["hot"]:
                    for at in range(run["p"], run["q"] + 1):
                        region = b" ".join(words[at : at + window])
                        out.append((doc, sha, xxhash.xxh64_intdigest(region, 11) - 2**63, at, region.decode()))
                else:
                    out.append((doc, sha, run["a"], run["p"], b" ".join(words[run["p"] : run["q"] + window]).decode()))
        kinds = (to_arrow_type(id_kind), pa.binary(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "sha", "a", "p", "region"])

    regions = map_batches(held, cut, f"doc_id {kind}, sha binary, a long, p int, region string").withColumn("mark", F.xxhash64("region"))
    distinct = regions.groupBy("a", "mark", "region").agg(F.min("doc_id").alias("owner")).select("a", "mark", "region", "owner")
    matched = distinct.repartition("a").sortWithinPartitions("a", "owner", "mark").mapInArrow(_match(window, to_arrow_type(id_kind)), f"a long, mark long, owners array<struct<from:int,to:int,owner:{kind}>>")
    spans = (
        regions.select("doc_id", "sha", "a", "mark", "p")
        .join(matched, ["a", "mark"])
        .select("doc_id", "sha", "p", F.explode("owners").alias("o"))
        .where("o.owner < doc_id")
        .select("doc_id", "sha", F.struct((F.col("p") + F.col("o.from")).alias("s"), (F.col("p") + F.col("o.to") + window).alias("e")).alias("span"))
        .groupBy("doc_id", "sha")
        .agg(F.sort_array(F.collect_set("span")).alias("spans"))
    )
    cuts = held.select("doc_id", "sha", "text").join(spans, ["doc_id", "sha"])
    return every.select("doc_id", "sha", "n_words").join(first.select("sha", "first"), "sha", "left"), cuts


def _kept(text: str, spans: list[dict]) -> list[bytes]:
    words = text.encode().split()
    out, at = [], 0
    for s in spans:  # sorted by start
        if s["s"] > at:
            out += words[at : s["s"]]
        at = max(at, s["e"])
    return out + words[at:]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by spaces; null where none were removed or all)."""
    every, cuts = find_repeats(docs, window)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = [_kept(t, s) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in left], pa.int64()), pa.array([b" ".join(w).decode() for w in left], pa.string())], names=["doc_id", "sha", "left", "kept"])

    changed = map_batches(cuts, fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sha binary, left long, kept string")
    copy = F.col("doc_id") > F.col("first")  # false or null for rows without an earlier copy
    out = every.join(changed, ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", "sha", F.coalesce(F.when(copy, F.col("n_words")), F.col("n_words") - F.col("left"), F.lit(0).cast("long")).alias("n_removed"), F.when(~F.coalesce(copy, F.lit(False)), F.col("kept")).alias("kept"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = deduplicate(docs)
    whole = F.col("n_removed") == 0
    return out.select("doc_id", "n_words", "n_removed", F.when(whole, F.lower(F.hex("sha"))).otherwise(F.sha2(F.coalesce("kept", F.lit("")), 256)).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with their texts cut (n_chars follows, where there is such a column). Texts that lose nothing stay as they are; other columns may have any names and types."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}  # by place, so that no name clashes with those added
    plain = docs.toDF(*at.values())
    place = names.index("text")

    def add_sha(batch: pa.RecordBatch) -> pa.RecordBatch:
        shas = [_sha((t or "").encode().split()) for t in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.binary())], names=[*at.values(), "sha"])

    cut = deduplicate(docs.select("doc_id", "text"), window).where("n_removed > 0").select(F.col("doc_id").alias("id"), F.col("sha").alias("of"), F.coalesce("kept", F.lit("")).alias("kept")).distinct()
    keyed = map_batches(plain, add_sha, StructType([*plain.schema.fields, StructField("sha", BinaryType())]))
    joined = keyed.join(cut, (F.col(at["doc_id"]) == F.col("id")) & (F.col("sha") == F.col("of")), "left")
    new = {"text": F.coalesce("kept", at["text"])}
    if "n_chars" in names:
        new["n_chars"] = F.coalesce(F.length("kept").cast(docs.schema["n_chars"].dataType), at["n_chars"])
    return joined.select(*(new.get(c, F.col(at[c])).alias(c) for c in names))
