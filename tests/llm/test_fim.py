"""Ropes and the fill-in-middle transformation against plain slicing."""

import hashlib
import random
import re

import pytest
from assay.llm import fim


def plain(doc_id, text):
    """The transformation by slices."""
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize(("unit", "leaf"), [(None, 1), (None, 7), (r"\S+\s*", 5), (r"\S+\s*", 4_096), (r"(?s).", 3), (r"x*", 4)])
def test_rope(unit, leaf):
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices("ab é😀\n x", k=rng.randint(0, 60)))
        whole = fim.rope(text, unit, leaf)
        assert str(whole) == text and whole.chars == len(text)
        assert all(x.chars <= leaf or x.units == 1 for x in whole.leaves())
        ends = [0, *(range(1, len(text) + 1) if unit is None else fim._ends(text, unit))]
        assert whole.units == len(ends) - 1
        for rank in range(whole.units + 1):
            a, b = fim.split(whole, rank, unit)
            assert (str(a), str(b)) == (text[: ends[rank]], text[ends[rank] :])
            assert (a.units, b.units, a.chars + b.chars) == (rank, whole.units - rank, len(text))
        for at in range(len(text) + 1):
            assert tuple(map(str, fim.split(whole, at, unit, by_chars=True))) == (text[:at], text[at:])
        for what in ("ab", "a", "é😀\n", "zz", text[3:9] or "q"):
            assert fim.find(whole, what) == text.find(what)


def test_depth_is_logarithmic():
    def depth(x):
        return 0 if x.left is None else 1 + max(depth(x.left), depth(x.right))

    assert depth(fim.rope("x" * 100_000, leaf=10)) <= 14


def test_forms_and_inverse():
    f, seen = fim.Fim(), set()
    for i in range(400):
        text = "".join(random.Random(i).choices("<PSM>é x", k=i % 23))
        n, form, prefix, middle, out = f.apply(i, text)
        assert (n, form, prefix, middle, str(out)) == plain(i, text)
        assert str(f.invert(str(out), form)) == text
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_any_sentinels():
    """Marks that overlap themselves or each other never give an output that can't be inverted."""
    for marks in (("aa", "ab", "ba"), ("a", "aa", "aaa"), ("<P>", "<S>", "<M>")):
        f = fim.Fim(100, 50, "1", *marks)
        for i in range(200):
            text = "".join(random.Random(i).choices("abc", weights=(1, 1, 9), k=i % 15))
            _, form, _, _, out = f.apply(i, text)
            assert str(f.invert(str(out), form)) == text
    assert not fim.Fim().overlapping and fim.Fim(prefix="aa").overlapping
    with pytest.raises(ValueError):
        fim.Fim(prefix="")
    with pytest.raises(ValueError):
        fim.Fim().invert("<P>a<M>b", "psm")
    with pytest.raises(ValueError):
        fim.Fim().invert("a", "other")


def test_query(spark):
    long = "długi tekst 😀 " * 150_000
    rows = [(i, f"word {i} é\n" * (i % 9)) for i in range(120)] + [(200, None), (201, ""), (202, "holds <S> itself"), (203, long), (None, "no id"), (5, "word 5 é\n" * 5), (5, "other text")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, n string, form string, output string").repartition(5)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted([(i, *(w := plain(i, t))[:4], sha(w[4]), sha(t or "")) for i, t in rows], key=str)
    assert sorted(map(tuple, fim.fim_digest(docs).collect()), key=str) == want
    assert fim.fim_digest(docs.limit(0)).count() == 0


def test_words_as_units(spark):
    text = "one two  three four five six "
    docs = spark.createDataFrame([(str(i), text * (i % 3 + 1)) for i in range(60)], "doc_id string, text string")
    got = fim.restored(fim.fill_in_middle(docs, fim.Fim(unit=r"\S+\s*"), "doc_id", "text"), fim.Fim()).collect()
    for r in got:
        assert r["restored"] == text * (int(r["doc_id"]) % 3 + 1) and r["n"] == 6 * (int(r["doc_id"]) % 3 + 1)
        if r["form"] == "psm":
            parts = re.fullmatch(r"(?s)<P>(.*)<S>(.*)<M>(.*)", r["output"]).groups()
            assert all(not p or p.endswith(" ") for p in parts) and len(parts[0]) == r["prefix_chars"]
