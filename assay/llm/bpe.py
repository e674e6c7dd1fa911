"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A vocabulary with merge ranks becomes a transducer over bytes. Its nondeterministic
configurations are (last finished token, token being read, tokens not yet emitted). A configuration
survives the end of a token only where the pair (last, new) is one that the merges themselves leave
apart; exactly one token sequence of each prefix of a word passes, the one that merging by rank
gives. So the set of live configurations is given by the longest suffix read that begins a token (its
suffixes are the tokens being read) and by the tokens not yet emitted on the way to each place where one of
them begins. Such a set is a state of the determinised transducer. States get numbers when first reached;
an edge (state, byte) holds its target and the tokens that become certain with the byte, those on which all
live configurations agree. It is worked out when a text first takes it and then looked up. The lookahead is
bounded by the longest vocabulary entry. All tokens come from edges; the edge by the
word's end emits those that its last bytes left open. (A word that is a vocabulary entry is one token, as the library has it.)
States are forgotten beyond a bound and worked out again.

Decoding joins token bytes through an incremental UTF-8 state machine, so that a character
may be split over tokens; malformed bytes become U+FFFD.

Null texts encode as empty texts; an empty text has no tokens. Long texts are cut at places
where white space follows other characters, where a match of the pattern always ends.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.common import cache_of, map_batches, offsets

#: Unicode's White_Space characters as a character class body.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space with what follows it. No match of a byte-level BPE pattern crosses from other characters to white space.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The same, cut also between a Latin letter and ASCII punctuation, where a match always ends too (but special tokens may go on).
LATIN = re.compile(f"[{SPACE}]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-/:-@\\[-`{{-~{SPACE}]|\\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Bounds of what a worker remembers: pieces of text, verdicts on pairs of tokens, states (forgotten before the next words, or bytes of a long word). Places for edges, a power of two.
MAX_PIECES, MAX_PAIRS, MAX_STATES, SLOTS = 300_000, 1 << 20, 300_000, 1 << 20
#: Longer words are read by themselves. Words read side by side at most. Characters whose pieces are looked up together.
LOOK, MAX_WORDS, GROUP = 64, 20_000, 1_000_000
#: The end of a word as a symbol. What doesn't matter any more. The start state: at the root, no token before.
END, UNUSED = 256, -2
START = (0, (-1,))
BYTES = [bytes((i,)) for i in range(256)]
#: Tokens that the decoder takes at a time.
FEED = 4096


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """Plain BPE of one piece: merge the adjacent pair of lowest rank, leftmost first, until none is left (under ``below``)."""
    if below is None and piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best) and (below is None or r < below):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes words (pre-tokens); see the module's text.

    A state is (``node``, ``lasts``): ``node`` is the longest suffix of the word's bytes that begins a token, and
    ``lasts`` the token that ends at each position from the one up to which tokens have been emitted (-1: the word's
    start; UNUSED: no live configuration goes by it). Words are read side by side, a byte of each at a time, so that a
    step is a look into arrays; long ones by themselves.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.node_of = {b"": 0}
        for word in ranks:
            for i in range(1, len(word) + 1):
                self.node_of.setdefault(word[:i], len(self.node_of))
        self.path = list(self.node_of)
        self.inner = {path[:-1] for path in self.path if path}
        size = max(ranks.values()) + 1
        #: Of each token: its bytes, the two tokens that merging joins last to make it (-1: it isn't made by merging), the longest token that ends it.
        self.length, self.left, self.right, self.shorter = ([-1] * size for _ in range(4))
        for word, rank in ranks.items():
            self.length[rank] = len(word)
            self.left[rank], self.right[rank] = self.last_merge(word)
            self.shorter[rank] = self.token_at_end(word[1:])
        #: Of each node, the longest token that ends there and how far back the tokens being read begin (filled on demand).
        self.longest = [self.token_at_end(path) for path in self.path]
        self.reading: list[tuple[int, ...] | None] = [None] * len(self.path)
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Begin anew with the start state alone."""
        self.states: list[tuple[int, tuple[int, ...]]] = [START]
        self.state_of = {START: 0}
        #: Edges by (state, byte), END for the word's end: target, and the tokens emitted (where they begin among all edges' tokens, how many).
        self.edge_of: dict[int, int] = {}
        self.target, self.begin, self.count, self.tokens = array("i"), array("i"), array("i"), array("i")
        #: The same edges for look-ups by the array; each key has one place.
        self.slots = np.full(SLOTS, -1, np.int64)
        self.edge_at = np.zeros(SLOTS, np.int32)

    def last_merge(self, word: bytes) -> tuple[int, int]:
        """The two tokens that merging joins last to make ``word``; (-1, -1) where merging doesn't make it."""
        if len(word) < 2:
            return -1, -1
        parts = merge_by_rank(word, self.ranks, below=self.ranks[word])
        return (parts[0], parts[1]) if len(parts) == 2 else (-1, -1)

    def token_at_end(self, path: bytes) -> int:
        return next((self.ranks[path[i:]] for i in range(len(path)) if path[i:] in self.ranks), -1)

    def pair(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side as they are.

        Both tokens' merges are undone from the last one back. Of what then meets at the seam, no
        pair may have a merge that comes before the merge that would have hidden it.
        """
        rank_of, spelled, hide_left, hide_right = self.ranks, self.token, 2 * len(self.left), 2 * len(self.left)
        while True:
            rank = rank_of.get(spelled[left] + spelled[right])
            # A tie is the same merge at two places: the leftmost goes first, which is the left token's own.
            if rank is not None and rank < hide_left and rank <= hide_right and rank < max(hide_left, hide_right):
                return False
            undo_left, undo_right = (x if self.left[x] >= 0 else -1 for x in (left, right))
            if undo_left == undo_right == -1:
                return True
            if undo_left > undo_right:
                hide_left, left = undo_left, self.right[left]
            else:
                hide_right, right = undo_right, self.left[right]

    def apart(self, left: int, right: int) -> bool:
        """``pair`` with a memory."""
        ok = self.verdicts.get((left, right))
        if ok is None:
            if len(self.verdicts) >= MAX_PAIRS:
                self.verdicts.clear()
            ok = self.verdicts[left, right] = self.pair(left, right)
        return ok

    def token_after(self, node: int, lasts: tuple[int, ...]) -> int:
        """The last token of the prefix that ends at ``node``, of the ones that end there the one that its neighbour stays apart from."""
        token = self.longest[node]
        while token >= 0:
            last = lasts[-self.length[token]]
            if last < 0 or self.apart(last, token):
                return token
            token = self.shorter[token]
        raise ValueError("the vocabulary cannot spell a word")

    def settle(self, reading: tuple[int, ...], lasts: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """The tokens on which all tokens being read agree, and what matters of ``lasts`` after them."""
        end = len(lasts) - 1
        begins = {end, *(end - back for back in reading)}
        live, used = set(begins), set()
        while len(live) > 1:
            at = max(live)
            live.remove(at)
            used.add(at)
            live.add(at - self.length[lasts[at]])
        base = at = live.pop()
        out = []
        while at:
            out.append(lasts[at])
            at -= self.length[lasts[at]]
        if base in begins:
            used.add(base)
        return out[::-1], tuple([lasts[i] if i in used else UNUSED for i in range(base, end + 1)])

    def edge(self, key: int) -> int:
        """The edge of a state (``key`` over 512) by a byte or END (``key`` modulo 512), determinised when first asked for."""
        known = self.edge_of.get(key)
        if known is not None:
            return known
        node, lasts = self.states[key >> 9]
        byte = key & 511
        if byte == END:
            out, to = self.settle((), lasts)[0], 0
        else:
            path = self.path[node] + BYTES[byte]
            while path not in self.node_of:
                path = path[1:]
            node = self.node_of[path]
            reading = self.reading[node]
            if reading is None:
                reading = self.reading[node] = tuple(len(path) - i for i in range(len(path)) if path[i:] in self.inner)
            out, lasts = self.settle(reading, (*lasts, self.token_after(node, lasts)))
            state = (node, lasts)
            to = self.state_of.setdefault(state, len(self.states))
            if to == len(self.states):
                self.states.append(state)
        known = self.edge_of[key] = len(self.target)
        self.target.append(to)
        self.begin.append(len(self.tokens))
        self.count.append(len(out))
        self.tokens.extend(out)
        return known

    def edges(self, state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
        """``edge`` of each row."""
        key = state << 9 | byte
        place = (key * 0x9E3779B97F4A7C1 >> 20) & (SLOTS - 1)
        out = self.edge_at[place]
        new = np.flatnonzero(self.slots[place] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            out[new] = np.fromiter(map(self.edge, keys.tolist()), np.int32, len(keys))[back]
            self.slots[place[new]], self.edge_at[place[new]] = key[new], out[new]
        return out

    def encode_short(self, words: list[bytes]) -> list[bytes]:
        """Words of one byte and more, side by side: a step follows one edge of each, and tokens come off the edges."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        longest = int(size.max())  # the column after it is for the ends
        rows = np.frombuffer(b"".join(words[i].ljust(longest + 1, b"\0") for i in order.tolist()), np.uint8).reshape(-1, longest + 1)
        size, state = size[order], np.zeros(len(words), np.int64)
        taken = np.full((len(words), longest + 1), -1, np.int32)
        for at in range(longest + 1):
            live, upto = (int(np.searchsorted(-size, -at, side=side)) for side in ("left", "right"))  # words longer than at, and of at bytes or more
            taken[live:upto, at] = self.edges(state[live:upto], END)
            edge = taken[:live, at] = self.edges(state[:live], rows[:live, at])
            state = np.frombuffer(self.target, np.int32)[edge].astype(np.int64)
        flat = taken[np.argsort(order)].reshape(-1)
        begin, count = np.frombuffer(self.begin, np.int32)[flat], np.where(flat < 0, 0, np.frombuffer(self.count, np.int32)[flat])
        ends = np.cumsum(count)
        flat = np.frombuffer(self.tokens, np.int32)[np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)].tobytes()
        ends = (4 * ends[longest :: longest + 1]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_long(self, word: bytes) -> bytes:
        """One word, read by itself."""
        out, state = [], 0
        for symbol in (*word, END):
            edge = self.edge_of.get(state << 9 | symbol)
            if edge is None:
                if len(self.states) > MAX_STATES:
                    now = self.states[state]
                    self.forget()
                    state = self.state_of.setdefault(now, len(self.states))
                    if state:
                        self.states.append(now)
                edge = self.edge(state << 9 | symbol)
            state = self.target[edge]
            if self.count[edge]:
                out += self.tokens[self.begin[edge] : self.begin[edge] + self.count[edge]]
        return np.array(out, np.int32).tobytes()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word, as 32-bit numbers. A word that is a token itself is that, as the rank file's library has it."""
        out = [None if (whole := self.ranks.get(w)) is None else whole.to_bytes(4, sys.byteorder) for w in words]
        short = [i for i, x in enumerate(out) if x is None and 0 < len(words[i]) <= LOOK]
        for at in range(0, len(short), MAX_WORDS):
            if len(self.states) > MAX_STATES:
                self.forget()
            some = short[at : at + MAX_WORDS]
            for i, tokens in zip(some, self.encode_short([words[i] for i in some])):
                out[i] = tokens
        return [self.encode_long(w) if x is None else x for w, x in zip(words, out)]


class Pieces:
    """Tokens of pieces of text, as 32-bit numbers. Beyond a bound, pieces that weren't asked for again are forgotten."""

    def __init__(self, transducer: Transducer, pattern):
        self.transducer, self.pattern = transducer, pattern
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces' words side by side."""
        new, words = [], []
        for piece in pieces:
            if (tokens := self.older.get(piece)) is not None:
                self.known[piece] = tokens
            else:
                new.append(piece)
                # One match of the pattern, or several.
                one = piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha()
                words.append((piece,) if one else self.pattern.findall(piece))
        places = {word: i for i, word in enumerate(set(chain.from_iterable(words)))}
        tokens = self.transducer.encode([word.encode() for word in places])
        for piece, some in zip(new, words):
            self.known[piece] = tokens[places[some[0]]] if len(some) == 1 else b"".join([tokens[places[word]] for word in some])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.known) >= MAX_PIECES:
            self.known, self.older = {}, self.known
        cut = list(map(LATIN.findall, texts))
        new = set().union(*cut).difference(self.known)
        self.learn(new)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32) for parts in cut]
        for piece in new:
            if len(piece) > 64:
                del self.known[piece]
        return out


class Codec:
    """Encoder and decoder for one rank file; built once in each Python worker."""

    _built: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # \s is spelled out, so that it means Unicode's White_Space whatever the library.
        spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(self.transducer, regex.compile(spelled))
        token = self.transducer.token
        size = max(token) + 1
        #: Bytes of the tokens one after another, with where each begins; decimal names of the ids with a space, zeros around them.
        self.spelled = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)
        self.length = np.array([len(token.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        width = len(str(size)) + 1
        self.names = np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(size)), np.uint8).reshape(size, width)
        self.utf8 = Utf8()

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._built:
            gc.set_threshold(500_000, 50, 100)  # what a codec remembers has no cycles
            cls._built[path, pattern] = cls(path, pattern)
        return cls._built[path, pattern]

    def encode(self, text: str | None) -> list[int]:
        return self.pieces.of([text or ""])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self.pieces.of(group)
                group, size = [], 0
        if group:
            yield from self.pieces.of(group)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - length), length)
        return self.spelled[place].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Tokens are fed to the machine some at a time."""
        ids, state, out = np.asarray(ids, np.int32), b"", []
        for at in range(0, len(ids), FEED):
            text, state = self.utf8.feed(state, self.bytes_of(ids[at : at + FEED]))
            out.append(text)
        if state:
            out.append("�")
        return "".join(out)

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by spaces."""
        flat = self.names[ids].reshape(-1)
        return flat[flat > 0].tobytes()[:-1]


def _forget() -> None:
    if Codec._built:
        Codec._built.clear()
        gc.set_threshold(2_000, 10, 10)
        gc.collect()


cache_of("bpe", _forget)


class Utf8:
    """Incremental UTF-8: a state is the bytes of an unfinished character (three at most)."""

    @staticmethod
    def expects(state: bytes) -> tuple[int, int, int]:
        """Bytes still missing after ``state``, and the range of the next one."""
        first = state[0]
        length = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        low, high = 0x80, 0xBF
        if len(state) == 1:  # no overlong forms, no surrogates, nothing over U+10FFFF
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
        return length - len(state), low, high

    def feed(self, state: bytes, more: bytes) -> tuple[str, bytes]:
        """The characters that ``more`` ends, and the state after it. Where all bytes are well formed, all but the last ones are read at once."""
        raw = state + more
        whole = len(raw)
        for back in range(1, min(3, whole) + 1):
            if raw[-back] >= 0xC0:  # a character begins here
                whole = len(raw) - back
                break
        try:
            text, rest = raw[:whole].decode(), raw[whole:]
        except UnicodeDecodeError:
            text, rest = "", raw
        out, pending = [text], b""
        for byte in rest:
            if pending:
                missing, low, high = self.expects(pending)
                if low <= byte <= high:
                    pending += bytes((byte,))
                    if missing == 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                pending = bytes((byte,))
            else:
                out.append("�")
        return "".join(out), pending


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, repeated rows included: the id and ``ids`` array<int>.

    ``path`` names a rank file that every executor can read (it comes with the installed
    vocabulary package). Null and empty texts give an empty array; other columns are not read, and an
    empty table gives an empty one.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(Codec.of(path, pattern).encode_all(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), fn, f"`{id_col}` {kind}, ids array<int>", "bpe")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``encode_documents`` with ``decoded`` string added; null ids decode as none."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, "ids"), fn, f"`{id_col}` {kind}, ids array<int>, decoded string", "bpe")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each document in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` where asked for.

    A digest of ids is that of their decimal forms joined by spaces. The ids themselves leave the worker only ``with_ids``.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path, pattern)
        rows, shas, decoded, counts = [], [], [], []
        for ids in codec.encode_all(batch.column(1).to_pylist()):
            counts.append(len(ids))
            shas.append(hashlib.sha256(codec.written(ids)).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            if with_ids:
                rows.append(ids)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, _lists(rows)] if with_ids else columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select("doc_id", "text"), fn, schema, "bpe")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    return pa.ListArray.from_arrays(offsets([len(r) for r in rows]), pa.array(flat))
