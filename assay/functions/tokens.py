"""Tokens of prompts, counted by the tokenizer library in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("prompts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text by the ranks in the file ``path`` (on every executor) after a cut by ``pattern``; of a null text none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for batch in batches:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in batch], dtype="int64")

    return count(text)
