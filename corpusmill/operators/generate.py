"""Row-wise model calls with a fallback and errors kept to their row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Reply = Callable[[dict], object]


def _call(model: Reply, row: dict) -> tuple[str, bool]:
    """A reply is the text, or a dict with ``text`` and ``cache_hit``."""
    reply = model(row)
    if isinstance(reply, dict):
        return reply["text"], bool(reply.get("cache_hit", False))
    return reply, False


def generate(df: DataFrame, primary: Reply, fallback: Reply | None = None) -> DataFrame:
    """Add ``suggestion, used_fallback, error, cache_hit``; a failing row never fails its batch."""
    columns = df.columns
    schema = df.schema.simpleString()[len("struct<"):-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = []
            for row in frame.to_dict("records"):
                try:
                    said, hit = _call(primary, row)
                    results.append((said, False, None, hit))
                    continue
                except Exception as problem:  # noqa: BLE001 - the fallback gets its turn
                    error = str(problem)
                try:
                    if fallback is None:
                        raise RuntimeError(error)
                    said, hit = _call(fallback, row)
                    results.append((said, True, None, hit))
                except Exception as problem:  # noqa: BLE001 - reported in the row
                    results.append((None, True, str(problem), False))
            added = pd.DataFrame(results, columns=["suggestion", "used_fallback", "error", "cache_hit"], index=frame.index)
            yield pd.concat([frame[columns], added], axis=1)

    return df.mapInPandas(run, f"{schema}, suggestion: string, used_fallback: boolean, error: string, cache_hit: boolean")


def generation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("rows"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if("used_fallback").alias("fallback_count"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
