"""The pipeline against a plain version of it on a small fixture."""

import hashlib
import random

import public_tokenizers as P
import pytest

import corpus_pipeline
from assay.llm import bpe, quality
from tests.llm.test_duplicates import groups_of, plain_fingerprint


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["the", "of", "and"] + ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    passage = say(70)
    docs, labels = [], []
    for i in range(80):
        lines = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        if i % 9 == 0:
            lines.insert(1, passage)
        if i % 8 == 3:
            lines = [w.upper().replace(" ", "!! ") for w in lines]
            labels.append((i, 0, 0))
        elif i % 3 == 0:
            labels.append((i, 1, 0))
        docs.append((i, "\n".join(lines), "en", f"s{i % 4}"))
    docs += [(100 + i, docs[i][1] + " end", "en", "s1") for i in range(0, 20, 2)] + [(200, None, None, None), (201, "", "en", "s0"), (202, docs[0][1], "en", "s2")]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), docs, labels


def test_run(spark, folder):
    where, docs, labels = folder
    text = {d[0]: d[1] for d in docs}
    field = quality.fit_field(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(spark.read.parquet(f"{where}/documents.parquet"), field).collect()}
    good = sorted(i for i in text if verdict[i])
    assert not [i for i, q, _ in labels if q != verdict[i]]
    fps = [plain_fingerprint(text[i]) for i in good]
    roots = groups_of(len(good), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    kept = [i for k, i in enumerate(good) if roots[k] == k]
    seen, left = {}, {}
    for i in kept:
        w = text[i].split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i in kept:
        w = text[i].split()
        gone = {j for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        left[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else text[i]
    assert any(left[i] != text[i] for i in kept) and len(kept) < len(good) < len(docs)
    got = corpus_pipeline.run(spark, where).collect()
    codec = bpe.Codec.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in got:
        assert list(r.ids) == codec.encode(left[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()
    words = sum(len(left[r.doc_id].split()) for r in got)
    assert words == pytest.approx(1.5 * sum(len(left[i].split()) for i in kept), rel=0.05)


def test_stage_columns(spark, folder):
    where, docs, _ = folder
    frame = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, where).columns == frame.columns
        assert stage(spark, frame.limit(0), where).count() == 0


def test_any_columns_ties_and_long_texts(spark, folder):
    """Columns named as the stages' own, a map and a struct among them, come through with their values; so do repeated rows and a long text."""
    where, docs, _ = folder
    extra = "_hash long, _place int, _sha string, _kept string, _id long, _of string, row string, hash string, place string, sha string, kept string, id int, of int, root int, rest string, digest string, copies int, size string, class int, u int, take string, source_size int, `a.b` int, m map<string,int>, s struct<x:int,y:array<string>>"
    values = (1, 2, "s", "k", 5, "o", "r", "h", "p", "s2", "k2", 6, 7, 8, "rest", "d", 9, "z", 10, 11, "t", 12, 13, {"a": 1}, (3, ["y"]))
    long = " ".join(f"w{i % 997}x{i // 7}" for i in range(60_000))
    rows = [*docs, docs[1], docs[1], docs[1], (300, long, "en", "s1")]
    frame = spark.createDataFrame([(*d, len(d[1] or ""), *values) for d in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(4)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, where)
        assert out.schema.names == frame.schema.names and out.count() > 40, name
        got = out.collect()
        assert all(tuple(r)[5:] == (*values[:-1], (3, ["y"])) for r in got), name
        assert name == "quality" or any(r.doc_id == 300 for r in got), name
        assert name in ("quality", "repeated_passages") or all(r.text in {d[1] for d in rows} for r in got), name
    tied = spark.createDataFrame([(1, "a b c", "en", "s", 5, {"k": 1})] * 40 + [(2, "d e f g", "en", "t", 7, {"k": 2})] * 40, "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>")
    assert sum(len(r.text.split()) for r in corpus_pipeline.source_mix(spark, tied, where).collect()) == pytest.approx(1.5 * 280, abs=4)
