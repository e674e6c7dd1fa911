"""The 18 test-smell rules as Column expressions over the scanner's struct ``f`` and the attribute list ``attributes``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.csharp import with_features
from assay.sources.adapters import SMELLS
from assay.sources.sinks import shared_path

#: Words in a called name that make a test's purpose known.
KNOWN_CALLS = ("Verify", "Should", "When", "Given", "And", "Then", "Test", "MatchSnapshot")


def _has(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part))


def _int(text: Column) -> Column:
    return F.trim(text).try_cast("int").isNotNull()


def _bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "false")


def _distinct_members(callees: Column) -> Column:
    """Whether two different members of one name are called."""
    pairs = F.transform(F.filter(callees, lambda c: F.contains(c, F.lit(".")) & ~(_has(c, "assert") | _has(c, "console") | _has(c, "thread"))), lambda c: F.slice(F.split(c, r"\."), 1, 2))
    distinct = F.array_distinct(pairs)
    return F.size(distinct) > F.size(F.array_distinct(F.transform(distinct, lambda p: p[0])))


def known_purpose(callees: Column) -> Column:
    part = lambda s: F.exists(F.array(*map(F.lit, KNOWN_CALLS)), lambda k: F.contains(s, k)) | _has(s, "assert")
    return F.exists(callees, lambda c: F.exists(F.split(c, r"\."), part))


def rules(f: str = "f", attributes: str = "attributes", known_helpers: str | None = None) -> dict[str, Column]:
    """The rules in the order of their ids. ``known_helpers``: a column with the names of helpers that are not unknown themselves."""
    x = lambda n: F.col(f"{f}.{n}")
    two = lambda i: F.size(i["args"]) > 1
    arg = lambda i, n: F.get(i["args"], F.lit(n))
    asserts = F.filter(x("expressions"), lambda e: F.startswith(e, F.lit("Assert")))
    plain = F.filter(x("callees"), lambda c: ~_has(c, "assert"))
    helped = F.arrays_overlap(x("callees"), F.col(known_helpers)) if known_helpers else F.lit(False)
    values = [
        x("stmt_count") == 0,
        x("branch_nodes") > 0,
        x("branch_nodes") + 1 > 10,
        F.array_contains(attributes, "ExpectedException"),
        F.size(asserts) > 2,
        (F.size(asserts) == 0) & ~known_purpose(x("callees")) & ~F.coalesce(helped, F.lit(False)),
        F.exists(x("expressions"), lambda e: _has(e, "console.write")),
        F.exists(x("expressions"), lambda e: _has(e, "thread.sleep")),
        F.exists(attributes, lambda a: _has(a, "skip")),
        F.exists(x("invocations"), lambda i: two(i) & (arg(i, 0) == arg(i, 1))),
        F.size(plain) > F.size(F.array_distinct(plain)),
        F.exists(x("invocations"), lambda i: two(i) & (_int(arg(i, 0)) != _int(arg(i, 1)))),
        _distinct_members(x("callees")),
        # A call with one argument can't be compared with a second; it counts by the one it has.
        F.exists(x("invocations"), lambda i: _has(i["callee"], "assert.equal") & F.coalesce(_bool(arg(i, 0)) | F.coalesce(_bool(arg(i, 1)), F.lit(False)), F.lit(False))),
        F.exists(x("invocations"), lambda i: (_has(i["callee"], "assert.true") | _has(i["callee"], "assert.false")) & F.exists(i["args"], lambda a: F.contains(a, F.lit("=")))),
        F.exists(x("invocations"), lambda i: _has(i["callee"], "assert") & F.exists(i["args"], lambda a: _has(a, "tostring"))),
        x("has_ctor_class"),
        x("local_decls") > 10,
    ]
    return dict(zip(SMELLS, values))


def detect(methods: DataFrame, kinds: Sequence[str] = SMELLS) -> DataFrame:
    """(class, method, smell, status) of every test with a block body, for the rules named.

    ``methods`` has class, name, body (null where expression-bodied) and attributes (array of their texts). Tests
    have the attribute Fact in any case; all others are helpers. A helper by bare name is
    judged first, by itself (of overloads the last by body counts); tests that call one which isn't unknown aren't either.

    Each body is scanned once: helpers' only if their verdict is asked for, and then the tests' scan is written to
    the shared folder, since it is read twice.
    """
    rows = methods.select("class", "name", "body", "attributes").where("body is not null")
    is_test = F.coalesce(F.exists("attributes", lambda a: F.lower(F.regexp_extract(a, r"^\s*(\w+)", 1)) == "fact"), F.lit(False))
    tests = with_features(rows.where(is_test))
    if "UnknownTestSmell" in kinds:
        path = shared_path(methods.sparkSession, "test-features")
        tests.withColumn("_id", F.xxhash64("class", "name", "body")).drop("body").write.parquet(path)
        tests = methods.sparkSession.read.parquet(path)
        helpers = with_features(rows.where(~is_test)).groupBy("name").agg(F.max_by(rules()["UnknownTestSmell"], "body").alias("unknown")).where("not unknown").select("name")
        called = tests.select("_id", F.explode(F.array_distinct("f.callees")).alias("name")).join(helpers, "name").groupBy("_id").agg(F.collect_set("name").alias("known"))
        tests = tests.join(called, "_id", "left")
        found = rules(known_helpers="known")
    else:
        found = rules()
    judged = F.array(*(F.struct(F.lit(n).alias("smell"), F.when(F.coalesce(found[n], F.lit(False)), "Found").otherwise("Not Found").alias("status")) for n in kinds))
    return tests.select("class", F.col("name").alias("method"), F.explode(judged).alias("s")).select("class", "method", "s.smell", "s.status")
