"""Repeated passages by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes has its top bits zero, so borders depend on the bytes
around them alone and come back in step right after an insertion. Chunks are compared by digest, then windows of
them; windows that other documents hold too make up the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.llm.common import row_blocks, staged

#: A chunk has 2^TOP bytes on average; MOST bytes end one wherever it is (text that never gives a border).
TOP, MOST = 5, 1_024
#: Code points of the shortest passage that counts, between its first and its last border.
LEAST = 80
BLOCK = 4_000_000
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([byte]), seed=1) & 0xFFFF for byte in range(256)], dtype=np.uint16)
_ROWS = "doc_id {}, part_row long, start int, length int, digest long, first boolean"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The sum of gear(byte k places back) * 2^k over the last 16 bytes, modulo 2^16, at every byte."""
    hashes = _GEAR[data]
    for span in (1, 2, 4, 8):
        shifted = hashes[:-span] << np.uint16(span) if len(hashes) > span else hashes[:0]
        hashes = hashes.copy()
        hashes[len(hashes) - len(shifted) :] += shifted
    return hashes


def borders(data: bytes) -> np.ndarray:
    """Ends of the chunks of one text, in bytes; never inside a character."""
    octets = np.frombuffer(data, dtype=np.uint8)
    if not len(octets):
        return np.zeros(0, dtype=np.int64)
    begins = np.append((octets[1:] & 0xC0) != 0x80, True)
    ends = np.flatnonzero(((gear_hashes(octets) >> np.uint16(16 - TOP)) == 0) & begins) + 1
    if not len(ends) or ends[-1] != len(octets):
        ends = np.append(ends, len(octets))
    starts = np.concatenate(([0], ends[:-1]))
    if (ends - starts).max() > MOST:
        safe = np.flatnonzero(begins) + 1
        extra = []
        for start, end in zip(starts[ends - starts > MOST], ends[ends - starts > MOST]):
            while end - start > MOST:
                start = safe[np.searchsorted(safe, start + MOST)]
                if start < end:
                    extra.append(start)
        ends = np.union1d(ends, np.array(extra, dtype=np.int64))
    return ends


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunk rows of all documents: ``doc_id, part_row`` (of the document), ``start, length`` (code points), ``digest``,
    ``first`` (the first chunk of the document with this digest)."""
    key = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for begin, stop in row_blocks(texts, BLOCK):
                owner, starts, lengths, digests = [], [], [], []
                for at in range(begin, stop):
                    data = texts[at].encode("utf-8", "surrogatepass")
                    ends = borders(data)
                    if not len(ends):
                        continue
                    edges = np.concatenate(([0], ends))
                    places = edges
                    if len(data) != len(texts[at]):
                        octets = np.frombuffer(data, dtype=np.uint8)
                        places = np.concatenate(([0], np.cumsum((octets & 0xC0) != 0x80)))[edges]
                    cuts = edges.tolist()
                    digests.extend(xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(cuts, cuts[1:]))
                    starts.append(places[:-1])
                    lengths.append(np.diff(places))
                    owner.append(np.full(len(ends), at))
                if owner:
                    owners, digest = np.concatenate(owner), np.array(digests, dtype=np.uint64).view(np.int64)
                    pairs = np.stack([owners, digest], axis=1)
                    first = np.zeros(len(pairs), dtype=bool)
                    first[np.unique(pairs, axis=0, return_index=True)[1]] = True
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(owners + row, pa.int64()),
                         pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(lengths), pa.int32()),
                         pa.array(digest, pa.int64()), pa.array(first)],
                        ["doc_id", "part_row", "start", "length", "digest", "first"])
            row += len(texts)

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut_rows = chosen.mapInArrow(cut, _ROWS.format(key))
    row = F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("part_row")
    return cut_rows.select("doc_id", row.alias("row"), "start", "length", "digest", "first")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, start, end, copies, first_doc_id, removed``, one row per stretch of a repeated passage; code points, end exclusive.

    A passage is a run of chunks of ``least`` code points or more that at least one other document (row) holds as
    well, in the same order. Of each window of a passage (the fewest chunks that reach ``least``) the smallest id among
    its holders is the first, and keeps it whole. A passage is cut into stretches where the first holder or the place
    there changes, so every removed stretch stays, as it is and in one piece, in ``first_doc_id``; a stretch may be
    shorter than ``least``. ``copies`` is the largest number of documents that hold one of its windows. Repeats inside
    one document alone do not count. Null and empty texts have no chunks; repeated rows are repeats of each
    other, but rows of the first id all keep it; null ids are holders, too, but are never first while another is.
    Other columns are not read.
    """
    found = _passages(staged(chunks(docs, doc_id, text), "chunks"), least)
    return found.drop("row")


def _released(df: DataFrame, label: str) -> DataFrame:
    """``staged``, and the shuffle files of the write are deleted with its end."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return staged(df, label)
    finally:
        conf.set(name, before)


def _long_runs(cut: DataFrame, least: int) -> DataFrame:
    """Chunks in long runs of shared chunks, with the window that starts there and the one that ends there.

    ``ahead`` and ``behind`` are digests of these windows, null where the run is too short for it; ``back`` is the start
    of the latter.
    """
    counts = cut.where("first").groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest")
    shared = cut.drop("first").join(counts, "digest").withColumn("end", F.col("start") + F.col("length"))
    # A run begins where the chunk before is not shared.
    own, run = W.partitionBy("row").orderBy("start"), W.partitionBy("row", "run")
    begun = shared.withColumn("begins", F.coalesce(F.lag("end").over(own) != F.col("start"), F.lit(True)))
    runs = begun.withColumn("run", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    kept = runs.withColumn("size", F.sum("length").over(run)).where(F.col("size") >= least)
    ahead, behind = run.orderBy("start").rangeBetween(0, least - 1), run.orderBy("end").rangeBetween(1 - least, 0)
    digest = lambda frame: F.xxhash64(F.collect_list("digest").over(frame))
    back = F.min("start").over(behind)
    return kept.select(
        "doc_id", "row", "start", "end", F.when(F.max("end").over(ahead) - F.col("start") >= least, digest(ahead)).alias("ahead"),
        F.when(F.col("end") - back >= least, digest(behind)).alias("behind"), back.alias("back"))


def _passages(cut: DataFrame, least: int) -> DataFrame:
    runs = _released(_long_runs(cut, least), "runs")
    sides = F.array(
        F.struct(F.lit(True).alias("forth"), F.col("ahead").alias("window"), F.col("start").alias("opens")),
        F.struct(F.lit(False).alias("forth"), F.col("behind").alias("window"), F.col("back").alias("opens")))
    windows = runs.select("doc_id", "row", "start", "end", F.inline(sides)).where("window IS NOT NULL")
    held = windows.groupBy("window", "row").agg(F.first("doc_id").alias("doc_id"), F.min("opens").alias("opens"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "opens")
    firsts = held.groupBy("window").agg(F.count("*").alias("copies"), F.min(place).alias("keeper")).where("copies > 1")
    known = windows.join(_released(firsts, "firsts"), "window")
    source = F.struct("keeper.unknown", "keeper.doc_id", "keeper.row", (F.col("keeper.opens") - F.col("opens")).alias("shift"))
    mine = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id"))
    # Of a window of the first holder only that matters: its source is never asked for.
    known = known.select("row", "start", "end", "forth", "copies", F.when(~mine, source).alias("source"), mine.alias("mine"))
    rows = runs.select("doc_id", "row", "start", "end", F.lit(True).alias("chunk")).unionByName(_released(known, "known"), allowMissingColumns=True)

    # The windows that hold a chunk start less than ``least`` before it, or end less than ``least`` after it.
    own = W.partitionBy("row").orderBy("start")
    ahead, behind = own.rangeBetween(1 - least, 0), W.partitionBy("row").orderBy("end").rangeBetween(0, least - 1)

    def over_windows(pick, fold, name: str) -> Column:
        return pick(fold(F.when(F.col("forth"), F.col(name))).over(ahead), fold(F.when(~F.col("forth"), F.col(name))).over(behind))

    covered = rows.select(
        "doc_id", "row", "start", "end", "chunk", over_windows(F.greatest, F.max, "copies").alias("copies"),
        over_windows(F.least, F.min, "source").alias("source"), over_windows(F.greatest, F.max, "mine").alias("mine"),
    ).where("chunk AND copies IS NOT NULL")
    # Rows of the first holder keep the chunk, whichever other windows of theirs hold it.
    covered = covered.withColumn("source", F.when(~F.col("mine"), F.col("source")))
    apart = (F.lag("end").over(own) != F.col("start")) | ~F.lag("source").over(own).eqNullSafe(F.col("source"))
    begun = covered.withColumn("begins", F.coalesce(apart, F.lit(True)))
    cuts = begun.withColumn("stretch", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    spans = cuts.groupBy("row", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
        F.max("copies").alias("copies"), F.first(F.col("source.doc_id")).alias("other"), F.first("mine").alias("mine"))
    first = F.when(F.col("mine"), F.col("doc_id")).otherwise(F.col("other")).alias("first_doc_id")
    return spans.select("row", "doc_id", "start", "end", "copies", first, (~F.col("mine")).alias("removed"))


@F.pandas_udf(StringType())
def without_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the (start, end) pairs given as one flat list each."""
    made = []
    for text, flat in zip(texts, spans):
        if text is not None and flat is not None:
            pairs = sorted(zip(flat[::2], flat[1::2]))
            edges = [0, *(edge for pair in pairs for edge in pair), len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        made.append(text)
    return pd.Series(made, dtype=object)
