"""Token counts of whole texts by overlap resynchronisation.

Every text longer than a chunk is encoded in overlapping chunks with character offsets. Two neighbours
are spliced at an offset where both encodings end a token and begin the next, and where the cut is proven
stable: a character that isn't white space stands before it and white space after it. The pattern
that splits texts never matches across such a place and looks only forward, and no special
token holds white space or takes it in, so the tokens on either side are those of the whole text.

Text without such places is spliced where both encodings agree on the token before the cut and on the one after it. For merges by
rank that is proof as well: tokens are a text's encoding if, and only if, each two neighbours are the
encoding of what they spell together (a merge over a boundary needs only the two tokens beside it), and both chunks
have encoded these two side by side. The second chunk begins where a token of the first does, so they agree at once but for
the first one's end. This holds for byte-level merges split by the usual pattern (``local``); with any other
tokenizer an overlap without a proven offset is widened, up to the rest of the text. Shorter texts are one chunk.

Null texts count as empty: no bytes and no tokens. Repeated rows each give a row; an empty table gives an
empty one, other columns are not read, and of a very long text only two chunks are encoded at a time.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from assay.llm.bpe import SPACE
from assay.llm.common import cache_of, map_batches

STABLE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Characters in a chunk, and in the overlap of two.
CHUNK, OVERLAP = 1_024, 64


class Counter:
    """Counts with one tokenizer file; built once in each Python worker."""

    _built: dict[str, Counter] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or re.search(f"[{SPACE}]", t["content"]) for t in added):
            raise ValueError("an added token takes in white space: cuts before white space aren't proven")
        self.tokenizer = Tokenizer.from_file(path)
        self.local = self.is_local(path)
        self.longest = max((len(t["content"]) for t in added), default=0)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._built:
            cls._built[path] = cls(path)
        return cls._built[path]

    @staticmethod
    def is_local(path: str) -> bool:
        """Whether two agreeing tokens prove a cut: plain byte-level merges, split by the byte-level pattern, on the text as it is."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        return bool(plain and split and not spec.get("normalizer"))

    def encode(self, text: str) -> Encoding:
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        local = self.local and overlap > 2 * self.longest  # else an added token may lie over both ends of an overlap
        start, stop = 0, min(chunk, len(text))
        left, skip = self.encode(text[:stop]), 0  # of the last chunk: its encoding, and its tokens before the last cut
        total = 0
        while stop < len(text):
            width, cut = overlap, None
            while cut is None:
                begin = max(start, stop - width)
                if local and begin > start:
                    begin = start + left.token_to_chars(left.char_to_token(begin - start))[0]
                to = min(len(text), max(begin + chunk, stop + width))
                right = self.encode(text[begin:to])
                cut = self.common(text, left, start, right, begin, stop)
                if cut is None and local:
                    cut = self.agreed(left, start, right, begin, stop)
                if cut is None and begin == start and to == len(text):  # nowhere proven: the rest is one piece
                    return total + len(right) - (skip and self.before(left, skip))
                width *= 2
            total += self.before(left, cut - start) - self.before(left, skip)
            left, skip, start, stop = right, cut - begin, begin, to
        return total + len(left) - self.before(left, skip)

    @staticmethod
    def before(encoding: Encoding, place: int) -> int:
        """Tokens before a place at which a token begins."""
        return encoding.char_to_token(place) if place else 0

    @staticmethod
    def meets(encoding: Encoding, place: int) -> bool:
        """Whether a token ends and the next one begins there."""
        token = encoding.char_to_token(place)
        return bool(token) and encoding.token_to_chars(token)[0] == place and encoding.token_to_chars(token - 1)[1] == place

    def common(self, text: str, left: Encoding, start: int, right: Encoding, begin: int, stop: int) -> int | None:
        """The last proven offset in the overlap at which both encodings have a token's end and the next one's start."""
        # The very edge of a chunk proves nothing about what the library would do beyond it.
        for m in reversed(list(STABLE.finditer(text, max(begin, 1), stop))):
            if begin < m.start() < stop and self.meets(left, m.start() - start) and self.meets(right, m.start() - begin):
                return m.start()
        return None


    def agreed(self, left: Encoding, start: int, right: Encoding, begin: int, stop: int) -> int | None:
        """The last offset in the overlap at which both encodings have the same token before it and the same after it."""
        ids, others = left.ids, right.ids
        for token in range(len(ids) - 1, 0, -1):
            place, end = (x + start for x in left.token_to_chars(token))
            if place <= begin:
                return None
            if end >= stop or not self.meets(left, place - start) or left.char_to_token(place - start) != token or not self.meets(right, place - begin):
                continue
            other = right.char_to_token(place - begin)
            if ids[token - 1 : token + 1] == others[other - 1 : other + 1] and left.token_to_chars(token - 1)[0] + start == right.token_to_chars(other - 1)[0] + begin:
                return place
        return None


cache_of("token_count", Counter._built.clear)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: the id, n_bytes long (UTF-8) and n_tokens long."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = Counter.of(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.count(t, chunk, overlap) for t in texts], pa.int64())],
            names=[id_col, "n_bytes", "n_tokens"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), fn, f"`{id_col}` {kind}, n_bytes long, n_tokens long", "token_count")


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
