"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import scratch_path, ship_package

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """The session with the package on its workers and Arrow batches bounded by bytes."""
    return ship_package(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives executors.

    ``corpusmill.session.clear_scratch`` deletes these tables when no result reads them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which leaves no freed memory with the worker: the next stage reuses it."""

    @functools.wraps(run)
    def wrapped(batches):
        release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, whatever the letter case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that nothing learns from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_blocks(texts, limit: int):
    """Ranges of a batch whose texts hold about ``limit`` characters, each at least one text."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union by pairs: every label becomes the smallest position reachable so far."""
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return labels
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def first_by_hash(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Of each group the row (``columns``) with the smallest hash of its columns, so that reruns agree; maps are not hashed."""
    kinds = dict(rows.dtypes)
    order = F.xxhash64(*[F.col(name) for name in columns if "map<" not in kinds[name] and kinds[name] != "variant"])
    row = own_name(rows, "row")
    return rows.groupBy(*group).agg(F.min_by(F.struct(*columns), order).alias(row)).select(f"{row}.*")
