"""Answers to prompts: recorded ones by the prompt's hash, others from a function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.operators.resolve import first_of


def record_key(prompt):
    return S.content_hash(prompt)


def responses(prompts: DataFrame, recorded: DataFrame, generate: Callable[[str], str | None] | None = None, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``response``: that recorded for the same prompt (of several the first by ``seq``), else what ``generate`` says, else null.

    ``recorded``: prompt_hash, seq, response. ``generate`` runs in the executors, once for each prompt text that has no record.
    """
    known = first_of(recorded.select("prompt_hash", "seq", "response"), ["prompt_hash"], "seq").select("prompt_hash", "response")
    rows = prompts.withColumn("prompt_hash", record_key(F.col(prompt)))
    if generate is not None:
        new = rows.select("prompt_hash", F.col(prompt).alias("text")).where("text is not null").join(known, "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"prompt_hash": batch["prompt_hash"], "response": [generate(t) for t in batch["text"]]})

        known = known.unionByName(new.mapInPandas(run, "prompt_hash string, response string"))
    return rows.join(known, "prompt_hash", "left").drop("prompt_hash")
