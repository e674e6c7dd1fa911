"""A small scanner for C# method bodies: statements, invocations and what test-smell rules need of them.

It knows comments, string and character literals, nesting and statement keywords, not types.
One Arrow pass turns bodies into structs; the rules on them are Column expressions (smells.py).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^\s*\#[^\n]*)"
    r"|(?P<string>\$?@\$?\"(?:[^\"]|\"\")*\"|\"\"\".*?\"\"\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"
    r"|(?P<name>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|::|\+\+|--|->|.)",
    re.S,
)
_CONTROL = frozenset("if for foreach while switch using lock catch fixed when".split())
_NOT_TYPES = frozenset("await return new throw in is as case else do yield out ref and or not stackalloc goto".split())
_NOT_CALLS = _CONTROL | frozenset("typeof sizeof default checked unchecked return throw await new in is as and or not else case delegate base this".split()) - {"base", "this"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Body:
    statements: int = 0
    branches: int = 0
    expressions: list[str] = field(default_factory=list)
    invocations: list[tuple[str, list[str]]] = field(default_factory=list)
    callees: list[str] = field(default_factory=list)
    locals: int = 0
    inner_constructor: bool = False


class Scanner:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "op" and t in _OPEN:
                stack.append(i)
            elif kind == "op" and t in _CLOSE and stack and _OPEN[self.tokens[stack[-1]][1]] == t:
                j = stack.pop()
                self.pair[i], self.pair[j] = j, i
        self.out = Body()

    def t(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def slice(self, a: int, b: int) -> str:
        """Text of tokens a to b, both included."""
        return self.text[self.tokens[a][2] : self.tokens[b][3]]

    def scan(self) -> Body:
        out, n = self.out, len(self.tokens)
        begin, end = (1, self.pair.get(0, n)) if self.t(0) == "{" else (0, n)
        i = begin
        while i < end:
            out.statements += 1
            i = max(i + 1, self.statement(i, end))
        self.everywhere()
        return out

    def after(self, i: int, end: int) -> int:
        """The token after the semicolon that ends what begins at i."""
        while i < end and self.t(i) != ";":
            i = self.pair[i] + 1 if self.t(i) in _OPEN and i in self.pair else i + 1
        return i + 1

    def block(self, i: int, end: int) -> int:
        """A block or a single statement under a control keyword."""
        if self.t(i) != "{":
            return self.statement(i, end)
        close = self.pair.get(i, end)
        j = i + 1
        while j < close:
            j = max(j + 1, self.statement(j, close))
        return close + 1

    def statement(self, i: int, end: int) -> int:
        word = self.t(i)
        if word == ";":
            return i + 1
        if word == "{":
            return self.block(i, end)
        if word == "await" and self.t(i + 1) in ("foreach", "using"):
            return self.statement(i + 1, end)
        if word in ("if", "while", "for", "foreach", "lock", "fixed", "catch") or (word in ("using", "switch") and self.t(i + 1) == "("):
            j = self.pair.get(i + 1, end) + 1
            if word == "catch" and self.t(i + 1) != "(":
                j = i + 1
            if word == "catch" and self.t(j) == "when":
                j = self.pair.get(j + 1, end) + 1
            j = j + 1 if self.t(j) == ";" else self.block(j, end)
            return self.statement(j, end) if j < end and (word, self.t(j)) in (("if", "else"), ("catch", "catch"), ("catch", "finally")) else j
        if word in ("else", "try", "finally", "do", "unsafe") or (word in ("checked", "unchecked") and self.t(i + 1) == "{"):
            j = self.block(i + 1, end)
            if word == "try" and j < end and self.t(j) in ("catch", "finally"):
                return self.statement(j, end)
            return self.after(j, end) if word == "do" else j
        if word in ("case", "default") and self.t(i + 1) != "(":
            while i < end and self.t(i) != ":":
                i = self.pair[i] + 1 if self.t(i) in _OPEN and i in self.pair else i + 1
            return i + 1
        if word in ("return", "throw", "break", "continue", "goto", "yield"):
            return self.after(i, end)
        if (j := self.local_function(i, end)) is not None:
            return j
        to = self.after(i, end)
        last = min(to, end) - 1
        if self.is_declaration(i, last):
            self.out.locals += 1
        else:
            self.out.expressions.append(self.slice(i, last).strip())
            close = last - 1 if self.t(last) == ";" else last
            if self.t(close) == ")" and close in self.pair and (callee := self.callee(self.pair[close])) and callee[0] == i:
                self.out.invocations.append((callee[1], self.arguments(self.pair[close], close)))
        return to

    def type_end(self, i: int) -> int | None:
        """The token after a type that begins at i, or None."""
        if self.t(i) == "(" and i in self.pair and "," in (self.t(j) for j in range(i, self.pair[i])):
            i = self.pair[i] + 1
        elif i < len(self.tokens) and self.tokens[i][0] == "name" and self.t(i) not in _NOT_TYPES | _CONTROL:
            i += 1
            while True:
                if self.t(i) in (".", "::") and i + 1 < len(self.tokens) and self.tokens[i + 1][0] == "name":
                    i += 2
                elif self.t(i) == "<" and (j := self.generic_end(i)) is not None:
                    i = j
                else:
                    break
        else:
            return None
        while self.t(i) == "?" or (self.t(i) == "[" and i in self.pair and all(self.t(j) == "," for j in range(i + 1, self.pair[i]))):
            i = self.pair[i] + 1 if self.t(i) == "[" else i + 1
        return i

    def generic_end(self, i: int) -> int | None:
        depth = 0
        for j in range(i, min(i + 60, len(self.tokens))):
            kind, t = self.tokens[j][:2]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif kind != "name" and t not in (",", ".", "::", "[", "]", "?", "(", ")"):
                return None
        return None

    def is_declaration(self, i: int, last: int) -> bool:
        while self.t(i) in ("const", "using", "scoped", "ref"):
            i += 1
        j = self.type_end(i)
        return j is not None and j <= last and j < len(self.tokens) and self.tokens[j][0] == "name" and self.t(j) not in _NOT_TYPES | {"switch", "with", "when"} and self.t(j + 1) in ("=", ";", ",")

    def local_function(self, i: int, end: int) -> int | None:
        while self.t(i) in ("static", "async", "unsafe", "extern"):
            i += 1
        j = self.type_end(i)
        if j is None or j >= len(self.tokens) or self.tokens[j][0] != "name":
            return None
        j += 1
        if self.t(j) == "<":
            j = self.generic_end(j) or j
        if self.t(j) != "(" or j not in self.pair:
            return None
        j = self.pair[j] + 1
        if self.t(j) == "{":
            return self.block(j, end)
        return self.after(j, end) if self.t(j) == "=>" else None

    def callee(self, paren: int) -> tuple[int, str] | None:
        """First token and text of what is called by the parenthesis, or None where it isn't a call."""
        i = paren - 1
        if self.t(i) == ">":
            depth, j = 0, i
            while j >= 0:
                depth += {">": 1, "<": -1}.get(self.t(j), 0)
                if not depth:
                    break
                j -= 1
            if j <= 0 or self.generic_end(j) != paren:
                return None
            i = j - 1
        if i < 0 or not (self.tokens[i][0] == "name" or self.t(i) in (")", "]")) or self.t(i) in _NOT_CALLS:
            return None
        if self.t(i) == ")" and (i not in self.pair or self.t(self.pair[i] - 1) in _CONTROL):
            return None
        start = i
        while True:
            while self.t(start) in (")", "]") and start in self.pair:
                start = self.pair[start]
                if start and (self.tokens[start - 1][0] == "name" or self.t(start - 1) in (")", "]")) and self.t(start - 1) not in _NOT_TYPES | _CONTROL:
                    start -= 1
                elif start and self.t(start - 1) == ">" and (j := self.open_angle(start - 1)) is not None:
                    start = j - 1
                else:
                    break
            if self.t(start) == ">" and (j := self.open_angle(start)) is not None:
                start = j - 1
            if start >= 2 and self.t(start - 1) in (".", "?.", "::"):
                start -= 2
                if self.t(start) == "!":
                    start -= 1
                continue
            break
        before = self.t(start - 1)
        if before == "new":
            # The parenthesis right after the type is the object's creation.
            j = self.type_end(start)
            if j is not None and j == paren:
                return None
            start -= 1
        elif start and (self.tokens[start - 1][0] == "name" and before not in _NOT_TYPES | _CONTROL or before in (">", "]", "?") and start == i and self.declared(start)):
            return None  # a local function's or delegate's name after its type
        return start, self.slice(start, paren - 1)

    def open_angle(self, i: int) -> int | None:
        depth, j = 0, i
        while j >= 0:
            depth += {">": 1, "<": -1}.get(self.t(j), 0)
            if not depth:
                return j if j and self.generic_end(j) == i + 1 else None
            j -= 1
        return None

    def declared(self, name: int) -> bool:
        """Whether a name follows a type that begins a statement."""
        i = name
        while i and self.t(i - 1) not in (";", "{", "}"):
            i -= 1
        return self.type_end(i) == name

    def arguments(self, open_: int, close: int) -> list[str]:
        """Texts between the commas, with the white space before and after them on their line."""
        out, begin, i = [], self.tokens[open_][3], open_ + 1
        if close == open_ + 1:
            return []
        while i < close:
            if self.t(i) == "," and not self.in_angles(open_, i):
                out.append(self.text[begin : self.tokens[i][2]])
                begin = self.tokens[i][3]
            i = self.pair[i] + 1 if self.t(i) in _OPEN and i in self.pair else i + 1
        out.append(self.text[begin : self.tokens[close][2]])
        # White space after a comma belongs to the comma, as far as the line goes.
        return [out[0], *(re.sub(r"^[ \t]+", "", x) for x in out[1:])]

    def in_angles(self, open_: int, i: int) -> bool:
        for j in range(i - 1, open_, -1):
            if self.t(j) == "<":
                end = self.generic_end(j)
                return end is not None and end > i
        return False

    def everywhere(self) -> None:
        """What is counted at any depth, in lambdas too."""
        do_depths: list[int] = []
        depth = 0
        for i, (kind, t, _, _) in enumerate(self.tokens):
            depth += (t == "{") - (t == "}")
            if kind == "op" and t == "(" and (c := self.callee(i)):
                self.out.callees.append(c[1])
            if kind != "name":
                continue
            if t == "do":
                do_depths.append(depth)
            elif t == "while":
                if do_depths and do_depths[-1] == depth and self.t(i - 1) in ("}", ";"):
                    do_depths.pop()
                else:
                    self.out.branches += 1
            elif t in ("if", "else", "foreach", "for") or (t == "switch" and self.t(i + 1) == "(" and self.t(i - 1) in ("", "{", "}", ";", ")", ":", "else", "do")):
                self.out.branches += 1
            elif t in ("class", "struct") and self.t(i + 2) in ("{", ":", "<"):
                name = self.t(i + 1)
                for j in range(i + 2, len(self.tokens) - 1):
                    if self.t(j) == name and self.t(j + 1) == "(" and self.t(j - 1) in ("public", "private", "internal", "protected", "{", "}", ";", "static"):
                        self.out.inner_constructor = True


def scan_body(text: str | None) -> Body:
    return Scanner(text or "").scan()


FEATURES = "struct<stmt_count:int,branch_nodes:int,expressions:array<string>,invocations:array<struct<callee:string,args:array<string>>>,callees:array<string>,local_decls:int,has_ctor_class:boolean>"


def with_features(methods: DataFrame, body: str = "body", out: str = "f") -> DataFrame:
    """``methods`` with the struct of FEATURES; null for a null body (expression-bodied methods)."""
    names = methods.columns
    struct = pa.struct([
        ("stmt_count", pa.int32()), ("branch_nodes", pa.int32()), ("expressions", pa.list_(pa.string())), ("invocations", pa.list_(pa.struct([("callee", pa.string()), ("args", pa.list_(pa.string()))]))),
        ("callees", pa.list_(pa.string())), ("local_decls", pa.int32()), ("has_ctor_class", pa.bool_()),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(names.index(body)).to_pylist():
                b = None if text is None else scan_body(text)
                rows.append(b and {"stmt_count": b.statements, "branch_nodes": b.branches, "expressions": b.expressions, "invocations": [{"callee": c, "args": a} for c, a in b.invocations], "callees": b.callees, "local_decls": b.locals, "has_ctor_class": b.inner_constructor})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, struct)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in methods.schema.fields)
    return methods.mapInArrow(run, f"{schema}, `{out}` {FEATURES}")
