"""The schema's tables, files under a folder, recorded answers, and token counts against plain merging."""

import base64
import os

import pytest

from assay.functions import scalars as S
from assay.functions.tokens import token_count
from assay.operators import generate as G
from assay.operators import resolve as R
from assay.sources import reports as P
from assay.sources import schema, sinks


def test_schema_is_made_once(spark, tmp_path):
    root = f"{tmp_path}/warehouse"
    schema.create(spark, root)
    new = spark.createDataFrame([("r", 1, "CustomSmell", None)], schema.schema_of("test_smells"))
    sinks.append(new, f"{root}/test_smells", partition=None)
    os.remove(f"{root}/imports/_SUCCESS")
    schema.create(spark, root)
    assert len(schema.COLUMNS) == 24 and set(os.listdir(root)) == set(schema.COLUMNS) and set(schema.KEYS) <= set(schema.COLUMNS)
    assert schema.read(spark, root, "test_smells").count() == 19 and schema.read(spark, root, "imports").count() == 0
    assert all(set(keys) <= set(schema.schema_of(table).names) for table, keys in schema.KEYS.items())


def test_files(spark, tmp_path):
    root = f"{tmp_path}/tree"
    sinks.write_files(spark.createDataFrame([("a/b/X.cs", "é\n"), ("Y.cs", None), ("a/Z.sln", "z")], "path string, content string"), root)
    read = P.read_files(spark, root, "*.cs").withColumn("path", P.below(P.F.col("path"), root))
    assert sorted(tuple(r) for r in read.collect()) == [("a/b/X.cs", "é\n")]
    assert sorted(r.path for r in P.list_files(spark, root).collect()) == ["a/Z.sln", "a/b/X.cs"]


def test_answers(spark):
    """Recorded ones first, the rest made once for each prompt; without a function they stay empty."""
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, prompt string")
    recorded = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first")], "p string, seq int, response string").withColumn("prompt_hash", S.content_hash("p"))
    got = lambda f: {r.id: r.response for r in G.responses(prompts, recorded, f).collect()}
    assert got(None) == {1: "first", 2: None, 3: None, 4: None}
    assert got(str.upper) == {1: "first", 2: "B", 3: "B", 4: None}


def test_token_counts(spark):
    P_ = pytest.importorskip("public_tokenizers")
    import regex

    path = P_.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}

    def plain(text):
        n = 0
        for piece in regex.findall(P_.PATTERN, text or ""):
            parts = [bytes([b]) for b in piece.encode()]
            while pairs := [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]:
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            n += len(parts)
        return n

    texts = ["Write one xUnit test method for:\nint Add(int a)", "", None, "naïve 漢字 <|endoftext|>", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", token_count(P.F.col("t"), path, P_.PATTERN).alias("n")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_many_files_by_many_tasks(spark, tmp_path):
    """Of rows with one path one stays; nothing hidden is left behind."""
    rows = [(f"d{i % 3}/f{i}.txt", "é" * i if i % 5 else None) for i in range(40)] + [("d0/f0.txt", "")]
    assert sinks.write_files(spark.createDataFrame(rows, "path string, content string").repartition(5), str(tmp_path / "made")) == 41
    found = {str(p.relative_to(tmp_path / "made")): p.read_text() for p in (tmp_path / "made").rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert found == {path: content or "" for path, content in rows}
    assert sinks.write_files(spark.createDataFrame([], "path string, content string"), str(tmp_path / "none")) == 0


def test_smells_bound_by_class_and_method(spark):
    """Against the report made in full and inserted row by row."""
    import random

    r = random.Random(5)
    classes = [(i, r.randrange(4) or None, f"C{r.randrange(5)}" if i % 7 else None) for i in range(1, 25)]
    methods = [(i, r.randrange(1, 27), f"M{r.randrange(4)}" if i % 11 else None) for i in range(1, 80)]
    smells = [(r.randrange(1, 84), r.randrange(3), r.choice(["Found", "Not Found"])) for _ in range(200)]
    smells = list({(m, s): (m, s, x) for m, s, x in smells}.values())
    want = {}
    for c, file, name in classes:
        for m, owner, method in methods:
            if file is None or method is None or name is None or file not in [f for i, f, _ in classes if i == owner]:
                continue
            first = min(i for i, _, n in classes if n == name)
            to = min((i for i, o, n in methods if o == first and n == method), default=None)
            for x, s, status in smells:
                if x == m and to is not None:
                    old = want.get((to, s), (status, 0))
                    want[to, s] = (old[0], old[1] + 1)
    got = R.bind_smells(
        spark.createDataFrame(smells, "method_id long, test_smell_id long, status string"), spark.createDataFrame(methods, "id long, class_id long, name string"), spark.createDataFrame(classes, "id long, file_id long, name string")
    )
    assert {(x.method_id, x.test_smell_id): (x.status, x.n) for x in got.collect()} == want and len(want) > 10


def test_updates_and_defaults(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 5, None), (None, None, "c")], "id long, source long, text string")
    done = R.update_column(rows, spark.createDataFrame([(1, 9, 0), (3, 4, 0), (None, 8, 0)], "id long, source long, seq int"), "source")
    assert sorted(done.collect(), key=str) == sorted([(1, 9, "a"), (2, 5, None), (None, None, "c")], key=str)
    assert sorted(R.with_defaults(rows.selectExpr("*", "id > 1 as `a.b`")).collect()) == [(0, 0, "c", False), (1, 0, "a", False), (2, 5, "", True)]
