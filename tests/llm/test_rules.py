"""Quality rules, language, HTML, licenses, mixing and top-k against brute force, SQL or held-out labels."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from assay.llm import html_text, language, licenses, mixing, quality, topk

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def duck(sql, name, source):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con.execute(sql)


# --- quality

def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a a a a a", "a\nb\na\n \n \na", "é\x1c\xa0|x  y\r\n", "w " * 5000]
    texts += ["".join(rng.choice("ab \n#|é\t") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(3, "one", False)], "doc_id long, text string, kept boolean")
    got = rows(quality.quality_rules(df, quality.LineField(quality.PRIOR[:-1], quality.PRIOR[-1])))
    assert [r[:7] for r in got] == sorted([(i, *plain_base(t)) for i, t in [*enumerate(texts), (3, "one")]], key=str)
    assert all(not r[-1] for r in got if r[6])
    assert quality.quality_rules(df.limit(0), quality.LineField(quality.PRIOR[:-1], 1.0)).collect() == []


def test_viterbi_by_enumeration():
    from itertools import product

    rng = random.Random(2)
    for _ in range(50):
        field = quality.LineField((1.0,), rng.random() * 2)
        f = [(rng.gauss(0, 1.5),) for _ in range(rng.randint(1, 7))]
        value = lambda y: sum(x[0] for x, b in zip(f, y) if b) - field.agree * sum(a != b for a, b in zip(y, y[1:]))
        best = max(map(value, product((False, True), repeat=len(f))))
        assert value(field.boilerplate(f)) == pytest.approx(best)


def test_without_labels():
    assert quality.fit_lines([]).agree == quality.PRIOR[-1]
    assert quality.fit_lines([(True, [(1.0,) * len(quality.FEATURES)])]).agree == quality.PRIOR[-1]


def test_sample_of_lines(spark):
    """One long document doesn't end the sample, and the order of the rows doesn't matter."""
    docs = [(0, "\n".join(f"HOME {i} | !!" for i in range(70_000)))]
    docs += [(i, f"This is a line of the text number {i}.\nIt goes on here." if i % 2 else "HOME | !! ##\nBUY $$$ NOW") for i in range(1, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    one = quality.fit_field(spark.createDataFrame(docs, "doc_id long, text string").repartition(1), labels)
    other = quality.fit_field(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(5), labels)
    assert one == other and one.weights != quality.PRIOR[:-1]
    runs = quality.some_lines(7, list(range(1_000)), 50)
    assert sum(map(len, runs)) == 50 and all(b == a + 1 for r in runs for a, b in zip(r, r[1:])) and quality.some_lines(7, [1, 2], 50) == [[1, 2]]


@needs_tables
def test_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.fit_field(docs, labels.where("doc_id % 2 = 0"))
    got = quality.quality_rules(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


# --- language

@needs_tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_mixture_and_edges(spark):
    rng = random.Random(3)
    en, fr = ["the", "thing", "and", "house", "with", "then"], ["le", "être", "dans", "maison", "avec", "nous"]
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    learn = [(i, say(en, 40), "en") if i % 2 else (i, say(fr, 40), "fr") for i in range(200)]
    test = [(1000, None, None), (1001, "12 -- 34!", "en"), (1002, "", None), (1003, say(en, 60) + " " + say(fr, 30), None), (1004, "漢字", None), (1004, "漢字", None)]
    df = spark.createDataFrame([(*r, 9) for r in learn + test], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.language_id(df).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0.0
    mixed = got[1003]
    assert mixed.lang_pred == "en" and {x.lang for x in mixed.languages} == {"en", "fr"} and mixed.score == pytest.approx(2 / 3, abs=0.05)
    assert got[1004].lang_pred in ("en", "fr")
    assert all(got[i].lang_pred == lang and len(got[i].languages) == 1 for i, _, lang in learn)
    unlearned = language.language_id(df.where("lang is null")).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and language.language_id(df.limit(0)).collect() == []


def plain_mixture(text, model):
    """Proportions by the same model, word by word in plain Python: all languages first, then nested sets of the likeliest."""
    words = re.findall(b"[a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode()))
    likes, k = [], len(model.languages)
    for w in words:
        w = b" " + w + b" "
        buckets = [(((w[i] << 16 | w[i + 1] << 8 | w[i + 2]) * 2654435761) % 2**32) >> 17 for i in range(len(w) - 2)]
        logs = [sum(float(model.log_p[b, j]) for b in buckets) for j in range(k)]
        likes.append([math.exp(max(x - max(logs), -30.0)) for x in logs])

    def step(pi):
        new = [0.0] * k
        for like in likes:
            total = sum(p * x for p, x in zip(pi, like))
            new = [n + p * x / total for n, p, x in zip(new, pi, like)]
        return [n / len(likes) for n in new]

    full = [1 / k] * k
    for _ in range(language.ROUNDS):
        full = step(full)
    order, best = sorted(range(k), key=lambda j: -full[j]), None
    for m in range(1, k + 1):
        pi = [max(full[j], 1e-12) if j in order[:m] else 0.0 for j in range(k)]
        pi = [p / sum(pi) for p in pi]
        for _ in range(language.MORE_ROUNDS if m > 1 else 1):
            pi = step(pi)
        value = sum(math.log(sum(p * x for p, x in zip(pi, like))) for like in likes) - language.PENALTY * 0.5 * (m - 1) * math.log(len(likes) + 1)
        if best is not None and value <= best[0]:
            break
        best = (value, pi)
    return best[1]


@needs_tables
def test_mixtures_by_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text for r in docs.where("text is not null and doc_id % 25 = 3").collect()]
    texts += [a[:300] + " " + b[:200] for a, b in zip(texts[::2], texts[1::2])]
    texts = [t for t in texts if re.search("[a-z]", t)]
    share, _ = model.score(texts)
    for text, row in zip(texts, share):
        assert row.tolist() == pytest.approx(plain_mixture(text, model), abs=1e-6)
    assert len(texts) > 40 and (share > 0).sum(axis=1).max() > 1


@needs_tables
def test_mixtures_of_long_texts(spark, monkeypatch):
    """By parts, with likelihoods kept and made anew, and with words longer than a part: as the text at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text for r in docs.where("text is not null and doc_id % 25 = 3").collect()]
    texts = [t for t in texts if re.search("[a-z]", t)]
    text = " ".join(a[:400] + "\n" + b[:200] for a, b in zip(texts[:24:2], texts[1:24:2])) + " " + "zxqu" * 500
    whole, _ = model.score([text])
    plain = plain_mixture(text, model)
    for part, cells in ((400_000, 1 << 23), (700, 1 << 23), (700, 4_000), (90, 2_000)):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "CELLS", cells)
        row, n = model.score_long(text)
        assert n == len(re.findall("[a-zA-Z\x80-\U0010ffff]+", text))
        assert row.tolist() == pytest.approx(whole[0].tolist(), abs=1e-9)
        assert row.tolist() == pytest.approx(plain, abs=1e-6)
    one = spark.createDataFrame([(1, text), (2, "1 2 " * 500), (3, text[:50])], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(one, model).collect()}
    assert got[1].lang_pred == model.languages[int(whole[0].argmax())] and got[2].lang_pred == "und"


def test_memory_of_a_long_text():
    """Nearly every word of 2 MB is another one: what is held doesn't grow with words times languages."""
    import tracemalloc

    model = language.LanguageModel(tuple(f"l{i:02}" for i in range(20)), np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 20).T + 1e-9))
    letters = np.random.default_rng(2).integers(97, 123, 2_000_000, dtype=np.uint8)
    letters[::7] = 32
    text = letters.tobytes().decode()
    tracemalloc.start()
    row, n = model.score_long(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text.split()) and row.sum() == pytest.approx(1) and peak < 300e6


def test_a_text_is_judged_by_itself():
    model = language.LanguageModel(tuple("abcdef"), np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 6).T + 1e-9))
    r = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 5))) for _ in range(n)) for n in (3, 40, 200, 700)]
    together, _ = model.score(texts)
    for text, row in zip(texts, together):
        assert row.tolist() == pytest.approx(model.score([text])[0][0].tolist(), abs=1e-9)
        assert row.tolist() == pytest.approx(model.score_long(text)[0].tolist(), abs=1e-9)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    docs = spark.range(60).selectExpr("id doc_id", "'some words' text", "concat('l', id % 3) lang")
    assert len(language.fit(docs).languages) == 3
    with pytest.raises(ValueError):
        language.fit(docs.withColumn("lang", docs.doc_id.cast("string")))


# --- HTML

ARTICLE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a < b) { var t = "</p>"; }</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<article><h1>A &amp; B&nbsp;C</h1><p>First <b>bold
  text</b> of it.<p>Second &#233;<br>line<!-- no --><form><input>Send</form><aside>Side</aside><div id="userComments"><p>Nice!</p></div><ul><li>one<li>two</ul></article>
<footer>&copy; 2024</footer></body></html>"""


def test_article():
    assert html_text.main_text(ARTICLE) == "A & B C\n\nFirst bold text of it.\n\nSecond é line\n\none\n\ntwo"


def test_two_passes():
    long = "This is the text of a page that is as long as it has to be for us, and it goes on with the words of a language. " * 2
    page = f"<body><div><a href=x>Home</a> <a href=y>Contact us here today</a></div><p>{long}<p>Short one.<p>{long}<div><a>Terms</a> | <a>Imprint</a></div><p>tail</body>"
    assert html_text.main_text(page) == "\n\n".join([long.strip(), "Short one.", long.strip()])
    assert html_text.second_pass([None, True, None, None, None, False, None]) == [True, True, True, False, False, False, False]
    assert html_text.second_pass([None, None]) == [False, False] and html_text.second_pass([]) == []


def test_article_is_one_feature():
    long = "This is the text of a page that is as long as it has to be for us, and it goes on with the words of a language. " * 2
    rare = "Quartz basalt gneiss; feldspar mica, olivine pyroxene: hornblende granite, obsidian pumice; rhyolite dacite andesite."
    story = "\n\n".join([long.strip(), "Short one.", long.strip()])
    teaser = "<a href=x>Another story of the day</a>"
    page = f"<body><article><h2>{teaser}</h2></article><div><p>{long}<p>Short one.<p>{long}</div><p>{rare}</body>"
    assert html_text.main_text(page) == story
    assert html_text.main_text(page.replace("article", "main")) == story
    assert html_text.main_text(f"<article><p>{teaser}<h1>Title</h1><p>{long}<p>{rare}<p>{long}</article>") == "\n\n".join(["Title", long.strip(), rare, long.strip()])
    assert html_text.main_text(f"<article><p>{teaser}<p>Share it<p>{teaser}<p>{long}</article>") == long.strip()
    assert html_text.second_pass([False, None, True], [False, True, False]) == [False, True, True]
    assert html_text.second_pass([None, None], [True, False]) == [True, False]


def test_names_of_wrappers():
    long = "This is the text of a page that is as long as it has to be for us, and it goes on with the words of a language. " * 2
    story = f"<h1>Title</h1><p>{long}<p>Short one.<p>{long}"
    want = "\n\n".join(["Title", long.strip(), "Short one.", long.strip()])
    notice = "<div class=cookie-notice>We use cookies and the data that is in them for you and for the others that we work with on it.</div>"
    aside = "<div class=sidebar><a href=x>More of it</a> <a href=y>And of that</a></div>"
    for name in ("has-sidebar", "no-sidebar", "content with-sidebar", "post share-enabled"):
        assert html_text.main_text(f"<body><div class='{name}'>{aside}{story}{notice}</div>") == want, name
        assert html_text.main_text(f"<body><div id='{name}'>{aside}<article>{story}</article></div>") == want, name
        assert html_text.main_text(f"<body><span class='{name}'><div>{story}</div></span>") == want, name
        assert html_text.main_text(f"<div class='{name}'><article><h1>Title</h1><p>Short one.</article></div>") == "Title\n\nShort one.", name
    assert html_text.main_text(f"<body><form>{story}<input><button>Send</button></form>") == want
    assert html_text.main_text("<body>" + "".join(f"<div class=x-widget>{x}</div>" for x in ("<h1>Title</h1>", f"<p>{long}", "<p>Short one.", f"<p>{long}"))) == want
    assert html_text.main_text(f"<body>{notice}{story}<div id=comments><p>{long}</div><form><p>{long[:100]}</form>{aside}") == want
    assert html_text.main_text(f"<p>It is <b class=share>Share</b> of it. {long}") == f"It is of it. {long.strip()}"


def test_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<article>a < b &lt;&bogus; <p>" + "x " * 50_000), (4, "u", ARTICLE), (5, "u", "<article></p>a</b>b<td>c</article>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = rows(html_text.extract(df))
    assert len(got) == 6 and all(r[3] == len(r[2]) for r in got)
    assert [r[2] for r in got[:2]] == ["", ""] and got[-1][2] == "a\n\nb\n\nc" or got[-1][2] == "ab\n\nc"
    assert html_text.extract(df.limit(0)).collect() == []


def test_time_grows_with_length():
    import time

    def took(unit, n):
        began = time.process_time()
        html_text.main_text(unit * n)
        return time.process_time() - began

    for unit in ("<a ", "<! ", "</ ", "<a href='x ", '<a x" ', "<script ", "<div></p>", "<div></section>", "<div class=ad>", "<p><i>", "<i><hr>", "<!--"):
        assert took(unit, 40_000) < 8 * max(took(unit, 10_000), 0.05), unit
    assert html_text.main_text("<article><p>a <b title='x<y>z'>b</b> < c</article>") == "a b < c"


@needs_tables
def test_test_pages_go_through_both_passes():
    """Every page's blocks are labelled by the passes, and its article comes out whole."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()[:50]
    for page in pages:
        blocks = html_text.without_named(html_text.blocks_of(page))
        first = [html_text.first_pass(b) for b in blocks]
        decided = [i for i, x in enumerate(first) if x is not None]
        want = []
        for i, (b, x) in enumerate(zip(blocks, first)):  # the second pass, plainly
            if x is None:
                near = min((abs(i - j) for j in decided), default=None)
                labels = {first[j] for j in decided if abs(i - j) == near}
                x = labels.pop() if len(labels) == 1 else b.inside
            want += [b.text] if x else []
        assert blocks and html_text.main_text(page) == "\n\n".join(want)
        article = re.search(r"<article.*?</article>", page, re.S)
        assert article and all(b.text in want for b in html_text.blocks_of(article[0]) if len(b.text) > 140 and not b.links and not b.parts)


def test_other_ids_and_long_texts(spark):
    df = spark.createDataFrame([("a", "the word and the line of it " * 40, "en"), ("b", "le mot et la ligne de la page " * 40, "fr"), ("c", "the end and the word of it " * 60_000, None)] + [(f"x{i}", "the word of it and so on " * 9, "en") for i in range(30)], "doc_id string, text string, lang string")
    got = {r.doc_id: r for r in language.language_id(df).collect()}
    assert got["c"].lang_pred == "en" and got["c"].score > 0.9
    kept = {r.doc_id: r.n_words for r in quality.quality_rules(df, quality.LineField(quality.PRIOR[:-1], 1.0)).collect()}
    assert kept["c"] == 420_000
    page = spark.createDataFrame([("p", "u", "<article>" + "<p>It is the text of a page and of a word that is in it for us. " * 20_000 + "</article>")], "page_id string, url string, html string")
    assert html_text.extract(page).first().n_chars > 1_000_000


# --- licenses

@needs_tables
def test_licenses_by_sql(spark):
    df = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "license", "containment", "first_word")
    assert rows(df) == sorted(duck(licenses.sql(), "documents", f"{SF}/documents.parquet").fetchall(), key=str)


def test_license_edges(spark):
    mit = licenses.TEMPLATES["mit-grant"]
    texts = [None, "", "license", f"x {mit.upper()} y", "w " * 40_000 + mit, mit.replace("documentation", "docs"), mit.replace("obtaining", "x").replace("copy", "y"), "Released\nunder -- the MIT license"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, containment int")
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.first_word) for r in licenses.scan(df).collect()}
    assert got.keys() == {(3, "mit-grant"), (4, "mit-grant"), (5, "mit-grant"), (7, "mit")} and got[3, "mit-grant"] == (1.0, 0) and got[4, "mit-grant"][0] == 1.0
    assert licenses.scan(df.limit(0)).collect() == []
    for name, text in licenses.TEMPLATES.items():
        assert licenses.bands_needed(len(licenses.template_words(text))) < 40, name


def test_licenses_by_their_own_name(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    texts = {
        "gpl-header": gpl.format(""), "lgpl-header": gpl.format("Lesser "), "agpl-header": gpl.format("Affero "), "cc-by-4.0-short": "All of it is licensed under CC BY 4.0 here.",
        "cc0-1.0": "To the extent possible under law, A. B. has waived all copyright and related or neighboring rights to this work.", "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    found = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((r.containment, r.license))
    assert [max(found[i])[1] for i in range(len(texts))] == list(texts) and [name for _, name in found[0]] == ["gpl-header"]


# --- mixing

@needs_tables
def test_mix_by_sql(spark):
    got = rows(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "size", "source_size", "target", "copies", "taken"))
    assert got == sorted(duck(mixing.SQL, "documents", f"{SF}/documents.parquet").fetchall(), key=str)


def test_mix_edges(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, "w " * rng.choice([1, 5, 50, 300]), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(400)]
    docs += [(None, "x y", "b"), (1, docs[1][1], docs[1][2]), (900, None, "empty"), (901, "", "a"), (902, "big " * 20_000, "b")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(docs) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), [0])[0] += r.taken
    assert sum(t for _, t in by) == pytest.approx(1.5 * total) and all(abs(k[0] - t) <= max(0.02 * t, 300) for (_, t), k in by.items())
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(7)))
    df.drop("size").write.parquet(f"{tmp_path}/d")
    want = sorted(duck(mixing.SQL, "documents", f"{tmp_path}/d/*.parquet").fetchall(), key=str)
    assert rows(mixing.mix(df).select("doc_id", "size", "source_size", "target", "copies", "taken")) == want
    assert mixing.mixed(df).count() == sum(r.copies for r in got) and mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []


def test_ties_and_odds(spark):
    """Equal rows share a rank, and still exactly so many are taken; in a stratum longer documents are taken less often."""
    df = spark.createDataFrame([(None, "a b c", "s", 1)] * 1000 + [(i, "x " * 4, "t", i) for i in range(6000)], "doc_id long, text string, source string, other int")
    got = mixing.mix(df).collect()
    target, taken = next(r.target for r in got if r["size"] == 3), sum(r.taken for r in got if r["size"] == 3)
    assert abs(taken - target) < 3 and len(got) == 7000 and mixing.mixed(df).where("source = 's'").count() == taken // 3
    many = spark.range(40_000).selectExpr("id doc_id", "repeat('w ', cast(64 + id % 8 as int)) text", "if(id < 30000, 'a', 'b') source")
    rate = {r["size"]: r.rate for r in mixing.mix(many).where("target < 2 * source_size").groupBy("size").agg({"copies": "avg"}).withColumnRenamed("avg(copies)", "rate").collect()}
    part = {size: x - int(min(rate.values())) for size, x in rate.items()}
    assert len(part) == 8 and part[64] / (1 - part[64]) / (part[71] / (1 - part[71])) == pytest.approx(71 / 64, rel=0.08)


# --- top-k

@needs_tables
def test_top_k_by_sql(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(duck(topk.SQL, "embeddings", f"{SF}/embeddings.parquet").fetchall(), key=str)
    assert rows(topk.top_k_of_every(vectors)) == want
    assert rows(topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, block=(2, 37))) == want


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [3.0]), (None, [9.0, 9.0]), (100, [0.0005, -0.0005])]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, score int")
    got = rows(topk.top_k_of_every(df, k=3))
    s = 1024 * 1024
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 5 * s), (0, 2, 2, 5 * s), (0, 3, 8, 3 * s)]
    assert [r[:3] for r in got if r[0] == 100] == [(100, 1, 7), (100, 2, 8), (100, 3, 0)]
    assert topk.top_k_of_every(df.limit(0)).collect() == []


def test_branch_and_bound():
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(3000, 64)) * 150)
    c[100:140] = c[7]
    ids = rng.permutation(3000)
    for q, own in zip(c[:25], ids[:25]):
        best = sorted((-int(s), int(i)) for s, i in zip(c @ q, ids) if i != own)[:10]
        assert [(i, s) for _, i, s in topk.search(q[None], np.array([own]), c, ids, 10)] == [(i, -s) for s, i in best]
    huge = np.array([[2.0**60, 1.0], [2.0**60, 2.0], [-1.0, 5.0]])
    assert topk.search(huge[:1], np.array([0]), huge, np.arange(3), 2) == [(0, 1, 2**63 - 1), (0, 2, 5 - 2**60)]
    floors = np.sort(c @ c[:25].T, axis=0)[-11]  # of all, the own one included: no query's tenth best is less
    for i in range(25):
        best = sorted((-int(s), int(j)) for s, j in zip(c @ c[i], ids) if j != ids[i])[:10]
        got = topk.search(c[i : i + 1], ids[i : i + 1], c[:1500], ids[:1500], 10, floors[i : i + 1])
        assert {(j, s) for _, j, s in got} >= {(j, -s) for s, j in best if j in ids[:1500]}


def test_vectors_of_other_lengths():
    import pyarrow as pa

    some = pa.array([[0.5, -0.25], [], [1.0, 2.0, 0.0004]], pa.list_(pa.float32()))
    assert topk.integers(some).tolist() == [[512, -256, 0], [0, 0, 0], [1024, 2048, 0]] and topk.integers(some.slice(1, 1)).shape == (1, 0)
    assert topk.integers(some.slice(0, 1)).tolist() == [[512, -256]] and topk.integers(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
