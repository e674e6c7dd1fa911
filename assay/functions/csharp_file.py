"""Declarations of C# source files: usings, namespace, classes, methods, properties, fields, calls in tests.

Built on the body scanner's tokens. Members of a nested class belong to that class. Lines count from zero;
the columns of a location are those of its first and last character.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.functions.csharp import Scanner

_MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override async partial readonly const new unsafe extern volatile required file".split())
_TYPES = frozenset("class struct interface enum record".split())
_DOC = re.compile(r"^\s*///\s?(.*)$", re.M)


class FileScanner(Scanner):
    def location(self, a: int, b: int) -> dict:
        start, end = self.tokens[a][2], self.tokens[b][3]
        column = lambda at: at - (self.text.rfind("\n", 0, at) + 1)
        return {"start_line": self.text.count("\n", 0, start), "body_start": column(start), "end_line": self.text.count("\n", 0, end), "body_end": column(end)}

    def doc(self, a: int) -> str:
        """The documentation comment right before token a."""
        before = self.text[self.tokens[a - 1][3] if a else 0 : self.tokens[a][2]]
        return "\n".join(m[1].rstrip() for m in _DOC.finditer(before))

    def head(self, i: int) -> tuple[list[str], list[str], int]:
        """Attributes and modifiers from token i, and the token after them."""
        attributes: list[str] = []
        while self.t(i) == "[" and i in self.pair:
            close, begin = self.pair[i], i + 1
            j = begin
            while j <= close:
                if j == close or self.t(j) == ",":
                    if j > begin:
                        attributes.append(self.slice(begin, j - 1))
                    begin = j + 1
                j = self.pair[j] + 1 if j < close and self.t(j) in ("(", "[", "{") and j in self.pair else j + 1
            i = close + 1
        modifiers = []
        while self.t(i) in _MODIFIERS:
            modifiers.append(self.t(i))
            i += 1
        return attributes, modifiers, i

    def end_of(self, i: int, end: int) -> tuple[int, int | None]:
        """The last token of a declaration whose rest begins at i, and the brace of its block, if it has one."""
        while i < end:
            if self.t(i) == ";":
                return i, None
            if self.t(i) == "{" and i in self.pair:
                return self.pair[i], i
            if self.t(i) in ("=", "=>"):
                return min(self.after(i, end), end) - 1, None
            i = self.pair[i] + 1 if self.t(i) in ("(", "[") and i in self.pair else i + 1
        return end - 1, None

    def members(self, i: int, end: int, owner: str, out: dict) -> None:
        while i < end:
            if self.t(i) in (";", "}"):
                i += 1
                continue
            first = i
            attributes, modifiers, i = self.head(i)
            common = {"class": owner, "attributes": attributes, "modifiers": modifiers, "doc_string": self.doc(first)}
            if self.t(i) == "namespace":
                j = i + 1
                while self.t(j) not in ("{", ";", ""):
                    j += 1
                out["namespaces"].append(self.slice(i + 1, j - 1) if j > i + 1 else "")
                if self.t(j) == "{" and j in self.pair:
                    self.members(j + 1, self.pair[j], owner, out)
                    i = self.pair[j] + 1
                else:
                    i = j + 1
                continue
            if self.t(i) in ("using", "global") and not owner and self.t(i + 1) != "(":
                j = self.after(i, end) - 1
                out["usings"].append(self.slice(i, min(j, end - 1)))
                i = j + 1
                continue
            if self.t(i) in _TYPES and i + 1 < end and not (self.t(i) == "record" and self.t(i + 1) == "("):
                kind = self.t(i)
                name = self.t(i + 2) if kind == "record" and self.t(i + 1) in ("class", "struct") else self.t(i + 1)
                last, brace = self.end_of(i + 1, end)
                if kind == "class":
                    out["classes"].append({**common, "class": name, "full_string": self.slice(first, last), **self.location(first, last)})
                if brace is not None and kind != "enum":
                    self.members(brace + 1, last, name, out)
                i = last + 1
                continue
            j = self.type_end(i)
            name_at = j if j is not None and j < end and self.tokens[j][0] == "name" else None
            if name_at is None:  # a constructor, an operator, an event or something unread
                last, _ = self.end_of(i, end)
                i = max(last, first) + 1
                continue
            after = name_at + 1
            if self.t(after) == "<":
                after = self.generic_end(after) or after
            last, brace = self.end_of(after, end)
            if self.t(after) == "(":
                body = self.slice(brace, last) if brace is not None else None
                out["methods"].append({**common, "name": self.t(name_at), "full_string": self.slice(first, last), "body": body, **self.location(first, last)})
            elif brace is not None or self.t(after) == "=>":
                if brace is not None and self.t(last + 1) == "=":
                    last = min(self.after(last + 1, end), end) - 1
                out["properties"].append({**common, "name": self.t(name_at), "full_string": self.slice(first, last)})
            else:
                out["fields"].append({**common, "name": self.t(name_at), "full_string": self.slice(first, last)})
            i = last + 1

    def declarations(self) -> dict:
        out: dict = {"usings": [], "namespaces": [], "classes": [], "methods": [], "properties": [], "fields": []}
        self.members(0, len(self.tokens), "", out)
        return out

    def calls(self) -> list[str]:
        """Texts of all invocations, at any depth."""
        return [self.slice(c[0], self.pair[i]) for i, (kind, t, _, _) in enumerate(self.tokens) if kind == "op" and t == "(" and i in self.pair and (c := self.callee(i))]


def first_method_name(code: str | None) -> str | None:
    """Name of the first method in a piece of code, in a class or by itself."""
    found = FileScanner(code or "").declarations()["methods"]
    return found[0]["name"] if found else None


_LOCATION = [("start_line", pa.int32()), ("body_start", pa.int32()), ("end_line", pa.int32()), ("body_end", pa.int32())]
_COMMON = [("class", pa.string()), ("attributes", pa.list_(pa.string())), ("modifiers", pa.list_(pa.string())), ("doc_string", pa.string())]
_METHOD = pa.struct([*_COMMON, ("name", pa.string()), ("full_string", pa.string()), ("body", pa.string()), *_LOCATION])
_CLASS = pa.struct([*_COMMON, ("full_string", pa.string()), *_LOCATION])
_MEMBER = pa.struct([*_COMMON, ("name", pa.string()), ("full_string", pa.string())])
_DDL_COMMON = "class:string,attributes:array<string>,modifiers:array<string>,doc_string:string"
_DDL_LOCATION = "start_line:int,body_start:int,end_line:int,body_end:int"
_SHAPE = (
    "path string, namespace string, usings array<string>, "
    f"classes array<struct<{_DDL_COMMON},full_string:string,{_DDL_LOCATION}>>, methods array<struct<{_DDL_COMMON},name:string,full_string:string,body:string,{_DDL_LOCATION}>>, "
    f"properties array<struct<{_DDL_COMMON},name:string,full_string:string>>, fields array<struct<{_DDL_COMMON},name:string,full_string:string>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, content) -> path, namespace (the first, or empty), usings, and arrays of classes, methods, properties and fields."""

    def run(batches):
        for batch in batches:
            found = [FileScanner(c or "").declarations() for c in batch.column(1).to_pylist()]
            get = lambda key, kind: pa.array([f[key] for f in found], pa.list_(kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([(f["namespaces"] or [""])[0] for f in found], pa.string()), get("usings", pa.string()), get("classes", _CLASS), get("methods", _METHOD), get("properties", _MEMBER), get("fields", _MEMBER)],
                names=["path", "namespace", "usings", "classes", "methods", "properties", "fields"],
            )

    return files.select("path", "content").mapInArrow(run, _SHAPE)


def _tested(attributes: Column) -> Column:
    """The framework of a method with these attributes; null where it isn't a test."""
    return S.test_framework(F.transform(attributes, lambda a: F.regexp_extract(a, r"^\s*([\w.]+)", 1)))


def methods_of(parsed: DataFrame) -> DataFrame:
    """One row per method with visibility, whether it is a test, and its framework."""
    rows = parsed.select("path", F.explode("methods").alias("m")).select("path", "m.*")
    framework = _tested(F.col("attributes"))
    return rows.withColumns({"visibility": S.visibility(F.col("modifiers")), "testing_framework": F.coalesce(framework, F.lit("")), "is_test_method": framework.isNotNull()})


def classes_of(parsed: DataFrame) -> DataFrame:
    """One row per class with visibility, the framework of the file's usings, and whether any of its methods is a test. A file is parsed once: its classes meet its methods in its row."""
    tests = F.transform(F.filter("methods", lambda m: _tested(m["attributes"]).isNotNull()), lambda m: m["class"])
    rows = parsed.select("path", S.framework_from_usings(F.col("usings")).alias("testing_framework"), F.array_distinct(tests).alias("_tests"), F.explode("classes").alias("c")).select("path", "testing_framework", "_tests", "c.*")
    rows = rows.withColumns({"visibility": S.visibility(F.col("modifiers")), "is_test_class": F.coalesce(F.array_contains("_tests", F.col("class")), F.lit(False))})
    return rows.drop("_tests")


def members_of(parsed: DataFrame) -> DataFrame:
    """One row per field and property, with its kind."""
    of = lambda column, kind: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["class"].alias("class"), x["name"].alias("name"), x["full_string"].alias("full_string")))
    return parsed.select("path", F.explode(F.concat(of("fields", "field"), of("properties", "property"))).alias("x")).select("path", "x.*")


def invocations_of(parsed: DataFrame) -> DataFrame:
    """One row per call in a test method: path, class, method, invocation, is_assertion."""
    tests = methods_of(parsed).where("is_test_method and body is not null").select("path", "class", F.col("name").alias("method"), "body")

    def run(batches):
        for batch in batches:
            rows = [(*r[:3], call) for r in zip(*(batch.column(i).to_pylist() for i in range(4))) for call in FileScanner(r[3]).calls()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], names=["path", "class", "method", "invocation"])

    return tests.mapInArrow(run, "path string, class string, method string, invocation string").withColumn("is_assertion", S.is_assertion(F.col("invocation")))
