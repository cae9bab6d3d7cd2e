"""Models behind the operators: callables that are injected, and replies that are replayed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folio.session import ship

Completion = Callable[[str, str], str]


def with_retries(call: Completion, tries: int = 3, wait: float = 0.5) -> Completion:
    """``call`` tried again after errors, with waits that double."""

    def tried(system: str, user: str) -> str:
        for n in range(tries):
            try:
                return call(system, user)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    return tried


def complete(prompts: DataFrame, call: Completion, at_once: int | None = None) -> DataFrame:
    """``prompts`` (..., system, user) with ``content`` and ``error``: one call a row on the executors, errors kept beside the rows.

    ``at_once`` bounds the number of tasks that call. Calls cost: store the result before it is read more than once.
    """
    ship(prompts.sparkSession)
    p = prompts.repartition(at_once) if at_once else prompts
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", content string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            content, error = [], []
            for s, u in zip(pdf["system"], pdf["user"]):
                try:
                    content.append(call(s, u))
                    error.append(None)
                except Exception as e:  # a failed call must not lose the others
                    content.append(None)
                    error.append(str(e))
            yield pdf.assign(content=content, error=error)

    return p.mapInPandas(run, schema)


def replay(prompts: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """``prompts`` with the stored ``content`` of the same key; prompts without one have an error."""
    r = replies.select(key, "content").dropDuplicates([key])
    return prompts.join(r, key, "left").withColumn("error", F.when(F.col("content").isNull(), "no reply"))
