"""Language identification by mixture inference.

A text is taken as words drawn from a mixture of languages, each word with the likelihood of
its character trigrams under one language. Expectation-maximisation estimates the languages'
proportions; of the nested sets of likely languages, the one with the best penalised likelihood
(BIC) is chosen, and its largest language is the prediction, with its proportion as score.

Trigram counts are learnt from texts with a language outside the held-out fold, about ``SAMPLE``
of them for each language, chosen by a hash of their id.

Null texts and texts without a letter are ``und`` with score 0, as is every text where there is
nothing to learn from. Repeated rows each give a row, an empty table gives an empty one, and other
columns are not read. Ids may be of any type.

A very long text is one mixture too. Its words are counted, and each round of the estimate goes over its distinct
words some at a time, whose likelihoods are made anew when all together would not fit ``CELLS``. What is kept of it
besides is its distinct words with their counts. A word of any length is read some at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import claim, map_batches

#: Texts of each language that the model is fitted on, about; buckets that trigrams hash into.
SAMPLE, BUCKETS = 2_000, 1 << 15
#: Every FOLDS-th crc32 of an id is held out. Weight of BIC's penalty.
FOLDS, PENALTY = 5, 4.0
ROUNDS, MORE_ROUNDS = 10, 3
#: Characters of the texts that are estimated side by side, and bytes of a part of a longer text.
PART = 400_000
#: Numbers (one for each trigram or word and language) that a step may hold at a time, and those that a text's rounds may keep.
CELLS = 1 << 23
#: A long text's words are counted together until they would fill so many blocks.
KEPT_BLOCKS = 8
#: Languages that a model may have: it is held whole, 8 * BUCKETS bytes for each, by the driver and every worker. More are an error.
MOST_LANGUAGES = 512

#: Letters stay (A-Z in lower case, all beyond ASCII), everything else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter; where each word's begin; how many words each text has."""
    words = [t.encode().translate(_LETTERS).split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return *trigrams_of(b" ".join(w for ws in words for w in ws)), counts


def _buckets(flat: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of bytes, one around each byte but the first and the last."""
    key = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def trigrams_of(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of words with one space between them."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.frombuffer(b" " + words + b" ", dtype=np.uint8).astype(np.uint32)
    letter = flat[1:-1] != 32
    first = letter & (flat[:-2] == 32)
    at = np.cumsum(letter)
    return _buckets(flat)[letter], at[first] - 1


def _parts(words: bytes) -> Iterator[bytes]:
    """Some ``PART`` bytes at a time, cut between words: a very long text's words don't lie in memory one by one."""
    at = 0
    while at < len(words):
        end = words.find(b" ", at + PART)
        end = len(words) if end < 0 else end
        yield words[at:end]
        at = end + 1


@dataclass(frozen=True)
class Words:
    """Distinct words of a text: those of each block joined by spaces, with their counts; and words too long to lie in a block."""

    blocks: list[tuple[bytes, np.ndarray]]
    long: list[tuple[bytes, int]]

    @classmethod
    def of(cls, text: str, room: int) -> Words:
        """``room``: bytes of a block, about. A word that comes again in a later block is counted there anew."""
        blocks, long = [], Counter()
        seen: Counter[bytes] = Counter()
        size = 0
        for part in _parts(text.encode().translate(_LETTERS)):
            for word, n in Counter(part.split()).items():
                if len(word) > room:
                    long[word] += n
                    continue
                size += 0 if word in seen else len(word) + 1
                seen[word] += n
                if size >= room * KEPT_BLOCKS:
                    blocks += _blocks(seen, room)
                    seen, size = Counter(), 0
        return cls(blocks + _blocks(seen, room), list(long.items()))

    @property
    def total(self) -> int:
        return sum(int(n.sum()) for _, n in self.blocks) + sum(n for _, n in self.long)

    @property
    def distinct(self) -> int:
        return sum(len(n) for _, n in self.blocks) + len(self.long)


def _blocks(counts: Counter[bytes], room: int) -> list[tuple[bytes, np.ndarray]]:
    out, words, size = [], [], 0
    for word in counts:
        words.append(word)
        size += len(word) + 1
        if size >= room:
            out.append(words)
            words, size = [], 0
    return [(b" ".join(ws), np.array([counts[w] for w in ws], dtype=np.float64)) for ws in [*out, words] if ws]


def _relative(logs: np.ndarray) -> np.ndarray:
    """Likelihoods of each word relative to its best language's; a word that no language knows decides nothing."""
    return np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -30.0))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_p: np.ndarray  # buckets x languages

    def of_words(self, words: bytes) -> np.ndarray:
        """Log likelihood of each word in each language."""
        bucket, starts = trigrams_of(words)
        return np.add.reduceat(self.log_p[bucket], starts, axis=0)

    def of_long_word(self, word: bytes, room: int) -> np.ndarray:
        """The same of one word, ``room`` bytes at a time."""
        counts, word = np.zeros(BUCKETS), b" " + word + b" "
        for at in range(0, len(word) - 2, room):
            counts += np.bincount(_buckets(np.frombuffer(word[at : at + room + 2], dtype=np.uint8).astype(np.uint32)), minlength=BUCKETS)
        return counts @ self.log_p

    @property
    def room(self) -> int:
        """Characters whose trigrams' numbers fit ``CELLS``, ``PART`` at most."""
        return max(1, min(PART, CELLS // max(len(self.languages), 1)))

    def score_long(self, text: str) -> tuple[np.ndarray, int]:
        """Proportions and word count of one text, in bounded memory besides its distinct words."""
        k, room = len(self.languages), self.room
        words = Words.of(text, room)
        n = words.total
        if not n or not k:
            return np.zeros(k), n

        def likes() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for block, counts in words.blocks:
                yield _relative(self.of_words(block)), counts
            for word, count in words.long:
                yield _relative(self.of_long_word(word, room)[None, :]), np.array([float(count)])

        kept = list(likes()) if words.distinct * k <= CELLS else None

        def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
            for step in range(rounds + 1):
                into, value = np.zeros(k), 0.0
                for like, counts in kept if kept is not None else likes():
                    total = np.maximum(like @ pi, 1e-300)
                    if step < rounds:
                        into += (counts / total) @ like
                    else:
                        value += counts @ np.log(total)
                if step < rounds:
                    pi = pi * into / n
            return pi, value

        full, _ = em(np.full(k, 1 / k), ROUNDS)
        place = np.argsort(np.argsort(-full, kind="stable"), kind="stable")
        best, best_value = np.zeros(k), -np.inf
        for m in range(1, k + 1):
            pi = np.where(place < m, np.maximum(full, 1e-12), 0.0)
            pi, value = em(pi / pi.sum(), MORE_ROUNDS if m > 1 else 1)
            value -= PENALTY * 0.5 * (m - 1) * np.log(n + 1)
            if value <= best_value:
                break
            best, best_value = pi, value
        return best, n

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (texts x languages; zero outside the chosen set), and word counts; of texts that fit ``room`` together."""
        words = [b" ".join(t.encode().translate(_LETTERS).split()) for t in texts]
        counts = np.array([w.count(b" ") + 1 if w else 0 for w in words], dtype=np.int64)
        n, k = len(texts), len(self.languages)
        share = np.zeros((n, k))
        there = np.flatnonzero(counts)
        if not len(there) or not k:
            return share, counts
        like = _relative(np.concatenate([self.of_words(part) for part in _parts(b" ".join(filter(None, words)))]))
        size = counts[there]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        text = np.repeat(np.arange(len(there)), size)

        def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                post = pi[text] * like
                total = post.sum(axis=1, keepdims=True)
                post /= np.maximum(total, 1e-300)
                pi = np.add.reduceat(post, begin, axis=0) / size[:, None]
            return pi, np.add.reduceat(np.log(np.maximum((pi[text] * like).sum(axis=1), 1e-300)), begin)

        full, _ = em(np.full((len(there), k), 1 / k), ROUNDS)
        place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        best, best_value, growing = None, None, None
        for m in range(1, k + 1):
            pi = np.where(place < m, np.maximum(full, 1e-12), 0.0)
            pi, value = em(pi / pi.sum(axis=1, keepdims=True), MORE_ROUNDS if m > 1 else 1)
            value = value - PENALTY * 0.5 * (m - 1) * np.log(size + 1)
            if best is None:
                best, best_value, growing = pi, value, np.ones(len(there), dtype=bool)
            else:
                growing &= value > best_value  # a text's set stays once it has not grown, whatever its neighbours do
                if not growing.any():
                    break
                best, best_value = np.where(growing[:, None], pi, best), np.where(growing, value, best_value)
        share[there] = best
        return share, counts


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from labelled texts outside the held-out fold. What reaches the driver has the size of the model."""
    rows = docs.where("lang is not null and text is not null").where(~held_out())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in lang")
    if not counts:
        return LanguageModel((), np.zeros((BUCKETS, 0)))
    languages = tuple(sorted(counts))
    index = {x: i for i, x in enumerate(languages)}
    draw = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    part = F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, sample / counts[x]))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        got: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                got[lang] += np.bincount(trigrams([text])[0], minlength=BUCKETS)
        for lang, c in got.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    chosen = rows.where(draw < part[F.col("lang")]).select("lang", "text")
    table = np.zeros((BUCKETS, len(languages)))
    summed = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for lang, bucket, n in summed.toPandas().itertuples(index=False):
        table[bucket, index[lang]] = n
    smooth = 0.5
    return LanguageModel(languages, np.log((table + smooth) / (table.sum(axis=0) + smooth * BUCKETS)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, and languages with their proportions, largest first."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = known.value, [t or "" for t in batch.column(1).to_pylist()]
        preds, scores, sets = [], [], []
        begin = 0
        while begin < len(texts):  # so many characters at a time
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= model.room):
                size += len(texts[end])
                end += 1
            if size > model.room:  # one text
                row, n = model.score_long(texts[begin])
                share, counts = [row], [n]
            else:
                share, counts = model.score(texts[begin:end])
            for text, row, n in zip(texts[begin:end], share, counts):
                if not n or not len(row) or not has_letter(text):
                    preds.append("und")
                    scores.append(0.0)
                    sets.append([])
                    continue
                order = np.argsort(-row, kind="stable")
                preds.append(model.languages[order[0]])
                scores.append(float(min(1.0, row[order[0]])))
                sets.append([{"lang": model.languages[i], "share": float(row[i])} for i in order if row[i] > 0])
            begin = end
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    return map_batches(docs.select("doc_id", "text"), fn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def language_id(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
