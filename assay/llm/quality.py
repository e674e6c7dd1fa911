"""Quality rules: base statistics, and content or boilerplate by line with a linear-chain CRF.

Each line with a word is labelled content or boilerplate by Viterbi decoding of a linear-chain
conditional random field; the share of words in content lines decides whether a text is kept.
The field's weights are fitted on a bounded sample of labelled documents (``SAMPLE``): lines of
good documents count as content; of lines in bad ones, those count as boilerplate that a first
fit without neighbours finds more like bad documents than good ones. Fitting maximises the
pseudo-likelihood: of each line's label, given its features and its neighbours' labels.
Without labels of both kinds, ``PRIOR`` is used.

Null texts have no words; a text of fewer than 50 words, or of which more than half the words
stand in repeated three-word windows, fails the base rules. Repeated rows each give a row, and an empty
table gives an empty one; other columns are not read. A very long text is labelled as a whole, in one
worker, with memory in proportion to its lines. Ids may be of any type.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import mul
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import map_batches

#: Bounds of the sample that the field is fitted on: labelled documents, and lines of them.
SAMPLE, SAMPLE_LINES = 1_500, 60_000
#: Lines of a document in it: as many as its share of SAMPLE_LINES, within these, in runs of RUN lines chosen by a hash.
LEAST_LINES, MOST_LINES, RUN = SAMPLE_LINES // SAMPLE, 1_000, 20
#: Fixed values of the base rules.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A text whose share of words in content lines is under this is boilerplate.
MIN_CONTENT = 0.5

FEATURES = ("bias", "upper", "symbols", "marks", "digits", "few_words", "repeated", "sentence_end", "long_words", "short_words", "bare")
#: Weights for boilerplate of each feature, and of agreeing with a neighbour, where nothing can be fitted.
PRIOR = (-3.0, 4.0, 4.0, 4.0, 3.0, 0.5, 1.0, -0.5, 0.0, -1.0, 4.0, 0.8)

_UPPER, _LOWER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?*#$%&|<>=_~^{}[]\\/+@"
_SYMBOLS, _PUNCTUATION = SYMBOLS.encode(), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATER = bytes(range(0x80, 0xC0))


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    """Of a UTF-8 line with at least one word. Characters beyond ASCII count as lower-case letters."""
    n, size = len(words), len(line)
    chars = sum(map(len, words)) - (0 if line.isascii() else size - len(line.translate(None, _LATER)))
    upper = size - len(line.translate(None, _UPPER))
    marks = size - len(line.translate(None, _MARKS))
    symbols = size - len(line.translate(None, _SYMBOLS))
    digits = size - len(line.translate(None, _DIGITS))
    letters = chars - (size - len(line.translate(None, _PUNCTUATION))) - digits
    return (
        1.0,
        upper / letters if letters > 0 else 0.5,
        min(1.0, symbols / n),
        min(1.0, marks / n),
        digits / chars,
        float(n < 4),
        float(seen),
        float(words[-1][-1:] in b".!?"),
        min(1.0, chars / n / 12),
        sum(len(w) < 4 for w in words) / n,
        sum(not w.translate(None, _PUNCTUATION) for w in words) / n if symbols else 0.0,
    )


def lines_of(text: str) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of those lines came before."""
    features, counts, seen, repeats = [], [], set(), 0
    for line in text.encode().split(b"\n"):
        if words := line.split():
            again = line in seen
            repeats += again
            seen.add(line)
            features.append(line_features(line, words, again))
            counts.append(len(words))
    return features, counts, repeats


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    size = len(ids)
    pair = a[:-1] * size + a[1:]
    if size > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(n, dtype=bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    covered = starts.copy()
    covered[1:] |= starts[:-1]
    covered[2:] |= starts[:-2]
    return int(covered.sum())


@dataclass(frozen=True)
class LineField:
    """A linear-chain field with two labels; ``agree`` is the gain of a neighbour with the same label over one with the other."""

    weights: tuple[float, ...]
    agree: float

    def boilerplate(self, features: list[tuple[float, ...]]) -> list[bool]:
        """Viterbi: the most likely labels of a text's lines; ties go to content."""
        if not features:
            return []
        w = self.weights
        gains = [sum(map(mul, f, w)) for f in features]
        content, other, back = 0.0, gains[0], []
        for g in gains[1:]:
            stay_c, stay_o = content >= other - self.agree, other > content - self.agree
            back.append((not stay_c, stay_o))
            content, other = (content if stay_c else other - self.agree), (other if stay_o else content - self.agree) + g
        labels = [other > content]
        for from_content, from_other in reversed(back):
            labels.append(from_other if labels[-1] else from_content)
        return labels[::-1]

    def share(self, features: list[tuple[float, ...]], counts: list[int]) -> float:
        """Share of words in content lines; 1 for a text without words."""
        bad = self.boilerplate(features)
        return sum(c for c, b in zip(counts, bad) if not b) / sum(counts) if counts else 1.0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, center: np.ndarray, strength: float = 15.0, rounds: int = 40) -> np.ndarray:
    """Newton's method; a normal prior around ``center`` counts where rows are few."""
    w = center.astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - strength * (w - center))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_lines(texts: list[tuple[bool, list[tuple[float, ...]]]]) -> LineField:
    """Fit on (good?, features of the lines) of labelled texts."""
    texts = [(good, f) for good, f in texts if len(f)]
    if not any(good for good, _ in texts) or all(good for good, _ in texts):
        return LineField(PRIOR[:-1], PRIOR[-1])
    x = np.concatenate([np.asarray(f, dtype=float) for _, f in texts])
    text = np.repeat(np.arange(len(texts)), [len(f) for _, f in texts])
    bad = np.array([not good for good, _ in texts])[text]
    share = bad.mean()
    first = _logistic(x, bad.astype(float), np.where(bad, 0.5 / share, 0.5 / (1 - share)), np.array(PRIOR[:-1]))
    y = bad & (x @ first > 0)
    if not y.any():
        return LineField(PRIOR[:-1], PRIOR[-1])
    sign, near = np.where(y, 1.0, -1.0), np.zeros(len(y))
    joined = text[1:] == text[:-1]
    near[1:] += np.where(joined, sign[:-1], 0)
    near[:-1] += np.where(joined, sign[1:], 0)
    w = _logistic(np.column_stack([x, near]), y.astype(float), np.ones(len(y)), np.array([*PRIOR[:-1], PRIOR[-1] / 2]))
    # The labels of a bad text's lines often agree by their making; the gain stays where a clear line can still differ.
    return LineField(tuple(w[:-1].tolist()), float(np.clip(2 * w[-1], 0.0, 1.0)))


def some_lines(doc_id: object, lines: list, most: int) -> list[list]:
    """All lines, or as many as ``most`` in runs that follow each other in the text, chosen by a hash of the id and place."""
    if len(lines) <= most:
        return [lines]
    out, left = [], most
    for i in sorted(range(0, len(lines), RUN), key=lambda i: (crc32(f"{doc_id}:{i}".encode()), i)):
        out.append(lines[i : i + min(RUN, left)])
        left -= len(out[-1])
        if not left:
            break
    return out


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """Fit on at most ``sample`` labelled documents and SAMPLE_LINES lines, chosen by hashes of their ids. Only line features reach the driver."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).collect()
    most = min(MOST_LINES, max(LEAST_LINES, SAMPLE_LINES // max(1, len(chosen))))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = [[[list(f) for f in run] for run in some_lines(i, lines_of(t or "")[0], most)] for i, t in zip(ids, texts)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(rows, pa.list_(pa.list_(pa.list_(pa.float64()))))], names=["doc_id", "quality", "hash", "runs"])

    few = docs.sparkSession.createDataFrame(chosen, labels.select("doc_id", "quality").schema)  # SAMPLE rows at most
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("hash"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    lines = map_batches(texts, fn, f"doc_id {kind}, quality {texts.schema['quality'].dataType.simpleString()}, hash long, runs array<array<array<double>>>")
    got, total = [], 0
    for row in lines.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "hash").limit(sample).toLocalIterator():
        got += [(row.quality > 0, [tuple(x) for x in run]) for run in row.runs]
        total += sum(map(len, row.runs))
        if total >= SAMPLE_LINES:
            break
    return fit_lines(got)


def quality_rules(docs: DataFrame, field: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""

    def one(text: str) -> tuple:
        words = text.encode().split()
        n = len(words)
        features, counts, repeats = lines_of(text)
        again = repeated_words(words)
        failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
        share = field.share(features, counts)
        return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeats, again, failed, share, not failed and share >= min_content

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(one(t or "") for t in batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_good(docs: DataFrame, field: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. No join: the verdict is reached where the row is."""
    from pyspark.sql.types import StructType

    names, place = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any names, dots included

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for text in batch.column(place).to_pylist():
            words = (text or "").encode().split()
            ok = len(words) >= MIN_WORDS and 100 * repeated_words(words) <= MAX_REPEAT_PERCENT * len(words)
            keep.append(ok and field.share(*lines_of(text)[:2]) >= min_content)
        return pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, names=batch.schema.names)

    return map_batches(plain, fn, StructType(plain.schema.fields)).toDF(*names)
