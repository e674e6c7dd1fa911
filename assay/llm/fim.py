"""Fill-in-the-middle transformation of documents held as ropes.

A text is a rope: a balanced binary tree whose leaves hold up to ``LEAF`` code points and whose nodes
cache how many units and code points lie below them. A unit is a code point, or what a pattern matches
(with the unmatched text before it; unmatched text at the end is a unit too). The tree is split at two unit
ranks, and prefix, suffix and middle are concatenated in another order with sentinels between them; whole
subtrees are shared, only the leaves at the cuts are cut. The inverse makes a rope of the output alone,
finds the sentinels in its leaves and splits it there.

The cuts and the form come from the SHA-256 of the seed and the id, so that reruns agree. Texts that
are empty, or hold a sentinel, stay plain; so do those whose output would hold a sentinel earlier than
it was put (possible with sentinels that overlap themselves).

A null text counts as empty. A null id counts as an empty one; repeated rows each give the same row. A text of any
length is one row and takes a few times its size in one task; an empty table gives an empty one. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import map_batches

#: Code points in a leaf at most (a longer unit is a leaf of its own).
LEAF = 4_096


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (``text``) or a node (``left``, ``right``) with its counts."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[Rope]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                if node.chars:
                    yield node
            else:
                todo += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(leaf.text for leaf in self.leaves())


EMPTY = Rope(0, 0)


@lru_cache(maxsize=16)
def _pattern(unit: str) -> re.Pattern[str]:
    return re.compile(unit)


def _ends(text: str, unit: str) -> Iterator[int]:
    """Where the units of ``text`` end; matches of nothing end none."""
    end = 0
    for m in _pattern(unit).finditer(text):
        if m.end() > end:
            yield (end := m.end())
    if end < len(text):
        yield len(text)


def concat(left: Rope, right: Rope) -> Rope:
    if not left.chars:
        return right
    if not right.chars:
        return left
    return Rope(left.units + right.units, left.chars + right.chars, "", left, right)


def rope(text: str, unit: str | None = None, leaf: int = LEAF) -> Rope:
    """The rope of a text; ``unit`` is a pattern without look-around, or None for code points. Leaves end where units end."""
    if unit is None:
        row = [Rope(len(part), len(part), part) for part in (text[a : a + leaf] for a in range(0, len(text), leaf))]
    else:
        row, begin, last, n = [], 0, 0, 0
        for end in _ends(text, unit):
            if end - begin > leaf and n:
                row.append(Rope(n, last - begin, text[begin:last]))
                begin, n = last, 0
            last, n = end, n + 1
        if n:
            row.append(Rope(n, last - begin, text[begin:last]))
    while len(row) > 1:  # neighbours pair up: depth is the logarithm of the number of leaves
        row = [concat(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def split(node: Rope, rank: int, unit: str | None = None, by_chars: bool = False) -> tuple[Rope, Rope]:
    """The rope's first ``rank`` units (or code points) and the rest."""
    count = (lambda x: x.chars) if by_chars else (lambda x: x.units)
    if rank <= 0:
        return EMPTY, node
    if rank >= count(node):
        return node, EMPTY
    if node.left is not None:
        of_left = count(node.left)
        if rank < of_left:
            a, b = split(node.left, rank, unit, by_chars)
            return a, concat(b, node.right)
        a, b = split(node.right, rank - of_left, unit, by_chars)
        return concat(node.left, a), b
    if by_chars or unit is None:
        at = rank
    else:
        at = next(end for i, end in enumerate(_ends(node.text, unit), 1) if i == rank)
    parts = node.text[:at], node.text[at:]
    a, b = (Rope(len(x) if unit is None else sum(1 for _ in _ends(x, unit)), len(x), x) for x in parts)
    return a, b


def find(node: Rope, what: str) -> int:
    """Code points before the first place of ``what``, or -1; it may lie over several leaves."""
    before, tail = 0, ""
    for leaf in node.leaves():
        if (at := (seen := tail + leaf.text).find(what)) >= 0:
            return before - len(tail) + at
        before += leaf.chars
        tail = seen[max(0, len(seen) - len(what) + 1) :]
    return -1


@dataclass(frozen=True)
class Fim:
    """What is asked for: the share of texts transformed, the share of those with the suffix first (per cent), the sentinels, the unit."""

    rate: int = 90
    spm_rate: int = 20
    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str | None = None

    def __post_init__(self) -> None:
        if not (self.prefix and self.suffix and self.middle):
            raise ValueError("sentinels must not be empty")

    def sentinel(self, text: str) -> Rope:
        return Rope(1, len(text), text)

    def apply(self, doc_id: object, text: str) -> tuple[int, str, int | None, int | None, Rope]:
        """Units of the text, form, code points of prefix and middle (None if plain), output."""
        whole = rope(text, self.unit)
        n, digest = whole.units, hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not n or h3 % 100 >= self.rate or any(s in text for s in (self.prefix, self.suffix, self.middle)):
            return n, "plain", None, None, whole
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        head, suffix = split(whole, second, self.unit)
        prefix, middle = split(head, first, self.unit)
        p, s, m = map(self.sentinel, (self.prefix, self.suffix, self.middle))
        form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < self.spm_rate else ("psm", (p, prefix, s, suffix, m, middle))
        out = EMPTY
        for part in parts:
            out = concat(out, part)
        if self.overlapping and str(self.invert(str(out), form)) != text:
            return n, "plain", None, None, whole
        return n, form, prefix.chars, middle.chars, out

    @property
    def overlapping(self) -> bool:
        """Whether a sentinel ends as it begins, so that text before it can make up an earlier one with its beginning."""
        return any(m[:k] == m[-k:] for m in (self.prefix, self.suffix, self.middle) for k in range(1, len(m)))

    def invert(self, output: str, form: str) -> Rope:
        """The text of an output, from it and its form alone."""
        whole = rope(output)
        if form == "plain":
            return whole
        if form not in ("psm", "spm"):
            raise ValueError(f"unknown form {form!r}")
        one, two = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        if not output.startswith(one):
            raise ValueError(f"no {one} at the beginning of a text of form {form}")
        _, rest = split(whole, len(one), by_chars=True)
        parts = []
        for mark in (two, self.middle):
            at = find(rest, mark)
            if at < 0:
                raise ValueError(f"no {mark} in a text of form {form}")
            part, rest = split(rest, at, by_chars=True)
            parts.append(part)
            _, rest = split(rest, len(mark), by_chars=True)
        prefix, suffix = parts if form == "psm" else parts[::-1]
        return concat(concat(prefix, rest), suffix)


def fill_in_middle(docs: DataFrame, fim: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and ``output``, the transformed text."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [fim.apply(i, t or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        n, form, prefix, middle, out = map(list, zip(*rows)) if rows else ([], [], [], [], [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(map(str, out), pa.string())], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), fn, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """``rows`` of ``fill_in_middle``, or any with columns output and form, with ``restored``: the texts they were made of."""
    names, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [str(fim.invert(o or "", f)) for o, f in zip(batch.column(names.index("output")).to_pylist(), batch.column(names.index("form")).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    return map_batches(rows, fn, f"{kinds}, restored string")


def fim_digest(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""
    both = restored(fill_in_middle(docs, fim), fim)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
