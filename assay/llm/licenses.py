"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Texts become lower-case words of letters and digits. For templates of m words, windows of
m + m // 2 words begin every m // 2 words, so that any occurrence lies whole in a window. Windows
and templates meet in MinHash bands of one row; there are as many bands as it takes for a
window that holds ``CONTAINMENT`` of a template's shingles to be missed with a probability of
``MISS`` at most. A retrieved window is verified exactly: the share of the template's
distinct five-word shingles that it holds.

Every word run that passes has one of the templates' key words, so windows without one are
passed over: key words stand in more than 1 - CONTAINMENT of each template's shingles.

One row for each document (by doc_id) and license found. Null and empty texts have none; rows
that repeat a doc_id give one row with the best of them. An empty table gives an empty one; columns other than doc_id
and text aren't read. A very long text is split into words in one task.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4

#: Notices of public licenses.
TEMPLATES = {
    "agpl-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
KEY_WORDS = ("license", "licensed", "software", "redistribution", "redistribute", "modification", "permitted", "permission", "copyright")

_BREAK = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(words: list[str], size: int = SHINGLE) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def bands_needed(words: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands for a template of so many words: (1 - similarity) ** bands <= miss."""
    own, window = words - SHINGLE + 1, words + words // 2 - SHINGLE + 1
    similarity = containment * own / (window + (1 - containment) * own)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def _words() -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower("text"), _BREAK, " "), " "), lambda w: w != "")


def _window_shingles(size: int = SHINGLE) -> Column:
    starts = F.sequence(F.lit(1), F.size("window") - (size - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("window"), i, size), " ")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key_words: tuple[str, ...] = KEY_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): the best window of each license found, and the earliest of those."""
    spark = docs.sparkSession
    coded = {name: template_words(text) for name, text in (templates or TEMPLATES).items()}
    for name, words in coded.items():
        hit = [s for s in shingles_of(words) if set(s.split()) & set(key_words)]
        if len(words) < SHINGLE or len(hit) <= (1 - containment) * len(shingles_of(words)):
            raise ValueError(f"template {name} is too short or has too few key words")
    most = {len(w): max(bands_needed(len(x), containment) for x in coded.values() if len(x) == len(w)) for w in coded.values()}
    rows = [(len(w), name, band, shingles_of(w)) for name, w in coded.items() for band in range(most[len(w)])]
    wanted = spark.createDataFrame(rows, "m int, license string, band int, own array<string>")  # as large as the templates
    wanted = wanted.withColumn("least", F.array_min(F.transform("own", lambda s: F.xxhash64(s, F.col("band")))))

    has_key = F.lit(False)
    for word in key_words:
        has_key = has_key | F.contains(F.lower("text"), F.lit(word))
    words = docs.where(has_key).select("doc_id", _words().alias("words"))
    sizes = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(b).alias("bands")) for m, b in sorted(most.items())))
    each = words.where(F.size("words") >= SHINGLE).select("doc_id", "words", F.explode(sizes).alias("x")).select("doc_id", "words", "x.m", "x.bands")
    step = F.floor(F.col("m") / 2).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - SHINGLE), step)
    windows = each.select("doc_id", "m", "bands", "words", F.explode(starts).alias("at")).select("doc_id", "m", "bands", "at", F.slice("words", F.col("at") + 1, F.col("m") + step).alias("window"))
    windows = windows.where(F.arrays_overlap("window", F.array(*map(F.lit, key_words)))).select("doc_id", "m", "at", "bands", _window_shingles().alias("shingles"))
    banded = windows.select("doc_id", "m", "at", "shingles", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
    banded = banded.withColumn("least", F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.col("band")))))
    met = banded.join(F.broadcast(wanted), ["m", "band", "least"])
    share = F.size(F.array_intersect("shingles", "own")) / F.size("own")
    found = met.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("at")).alias("before")))
    return found.groupBy("doc_id", "license").agg(best.alias("b")).select("doc_id", "license", "b.containment", (-F.col("b.before")).alias("first_word"))


def sql(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> str:
    """The same by brute force: every window against every template of its size."""
    coded = {name: template_words(text) for name, text in (templates or TEMPLATES).items()}
    values = ", ".join(f"({len(w)}, '{name}', [{', '.join(repr(s) for s in shingles_of(w))}])" for name, w in coded.items())
    keys = ", ".join(f"'{k}'" for k in KEY_WORDS)
    likes = " OR ".join(f"contains(lower(text), '{k}')" for k in KEY_WORDS)
    return rf"""
WITH t(m, license, own) AS (VALUES {values}), d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM documents WHERE {likes}
), w AS (
  SELECT doc_id, m, pos, list_slice(words, pos + 1, pos + m + m // 2) AS win FROM (
    SELECT doc_id, m, words, unnest(range(0, greatest(0, len(words) - {SHINGLE}) + 1, m // 2)) AS pos FROM d, (SELECT DISTINCT m FROM t) WHERE len(words) >= {SHINGLE})
), s AS (
  SELECT doc_id, m, pos, list_distinct(list_transform(range(1, len(win) - {SHINGLE} + 2), lambda i: array_to_string(list_slice(win, i, i + {SHINGLE} - 1), ' '))) AS shingles
  FROM w WHERE list_has_any(win, [{keys}])
), c AS (
  SELECT doc_id, license, pos, len(list_intersect(shingles, own))::DOUBLE / len(own) AS containment FROM s JOIN t USING (m)
)
SELECT doc_id, license, max(containment) AS containment, CAST(min(pos) FILTER (WHERE containment = top) AS INT) AS first_word
FROM (SELECT *, max(containment) OVER (PARTITION BY doc_id, license) AS top FROM c WHERE containment >= {containment})
GROUP BY doc_id, license
"""
