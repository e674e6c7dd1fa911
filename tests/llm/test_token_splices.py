"""Chunks of texts without white space are spliced where they agree: equal to one encoding of the whole, in bounded pieces."""

import base64
import random

import public_tokenizers as P
import pytest
from assay.llm import token_count


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(P.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(8)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    return {
        "chinese": some("这座城市的历史始于许多世纪以前当时第一批居民在河边建造房屋并开始耕种田地", 60_000),
        "chinese with stops": some("这座城市的历史始于许多世纪，。以前当时第一批居民", 30_000),
        "base64": base64.b64encode(rng.randbytes(90_000)).decode(),
        "one letter": "a" * 40_000, "two letters": "ab" * 20_000, "digits": some("0123456789", 30_000), "zeros": "0" * 30_000, "dashes": "-" * 30_000, "marks": some("=-_.!'", 20_000),
        "emoji": some("😀👍🏽é́", 60_000), "contractions": some("'slretvmd", 20_000), "letters": some("etaoinshrdlu", 40_000), "special": "<|endoftext|>".join(some("abc<|>", 900) for _ in range(60)),
        "thai": some("ประเทศไทยมีประวัติศาสตร์", 30_000), "seldom a space": " ".join(some("etaoinshrdlu", 5_000) for _ in range(20)), "spaces": " " * 20_000 + "x" + "\n" * 20_000,
    }


@pytest.mark.parametrize("name", sorted(texts()))
def test_as_the_library(counter, name, monkeypatch):
    text, sizes = texts()[name], []
    whole = len(counter.encode(text))
    encode = counter.encode
    monkeypatch.setattr(counter, "encode", lambda t: (sizes.append(len(t)), encode(t))[1])
    assert counter.count(text) == whole
    assert name in ("spaces", "dashes") or (sum(sizes) < 1.3 * len(text) and max(sizes) <= token_count.CHUNK + 64), (sum(sizes) / len(text), max(sizes))
    for chunk, overlap in ((60, 10), (200, 40)):
        part = text[:3_000]
        assert counter.count(part, chunk, overlap) == len(encode(part))


def test_only_plain_byte_merges_are_local():
    assert token_count.Counter.is_local(P.path("byte_bpe_50k.json")) and not token_count.Counter.is_local(P.path("word_bpe_49k.json"))
