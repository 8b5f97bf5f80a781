"""Documents to ordered, content-addressed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import ids, text

# Default chunk budget and overlap in estimated tokens.
MAX_TOKENS = 256
OVERLAP_TOKENS = 32


def pack(tokens: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Chunk bounds ``array<struct<first, end>>`` (end exclusive) over an array of segment sizes.

    Segments are added while they fit ``max_tokens``; on overflow the chunk closes and the next one
    starts with the trailing segments that fit ``overlap_tokens`` (at least one when it is above 0).
    A segment larger than the budget stays whole. One fold over integers per document: the text
    itself is not touched, and the look-back on overflow spans at most ``overlap_tokens`` segments.
    """
    overlap = min(overlap_tokens, max(0, max_tokens - 1))
    empty = F.array().cast("array<struct<first:int,end:int>>")

    def state(first: Column, at: Column, used: Column, done: Column) -> Column:
        return F.struct(
            first.cast("int").alias("first"), at.cast("int").alias("at"),
            used.cast("int").alias("used"), done.alias("done"),
        )

    def tail(s: Column) -> Column:
        """How many trailing segments the next chunk repeats, and their size."""
        if overlap == 0:
            return F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("open"))
        low = F.greatest(s["first"], s["at"] - F.lit(overlap))
        recent = F.reverse(F.slice(tokens, low + 1, s["at"] - low))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("open"))

        def extend(acc: Column, size: Column) -> Column:
            fits = acc["open"] & ((acc["n"] == 0) | (acc["sum"] + size <= overlap))
            return F.struct(
                F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(fits, acc["sum"] + size).otherwise(acc["sum"]).alias("sum"),
                fits.alias("open"),
            )

        return F.aggregate(recent, start, extend)

    def closed(s: Column) -> Column:
        bound = F.struct(s["first"].alias("first"), s["at"].alias("end"))
        return F.array_append(s["done"], bound)

    def step(s: Column, size: Column) -> Column:
        overflow = (s["at"] > s["first"]) & (s["used"] + size > max_tokens)

        def reopened() -> Column:
            return text.let(
                tail(s), lambda t: state(s["at"] - t["n"], s["at"] + 1, t["sum"] + size, closed(s))
            )

        kept = state(s["first"], s["at"] + 1, s["used"] + size, s["done"])
        return F.when(overflow, reopened()).otherwise(kept)

    start = state(F.lit(0), F.lit(0), F.lit(0), empty)
    return F.aggregate(tokens, start, step, lambda s: F.when(s["at"] > 0, closed(s)).otherwise(s["done"]))


def segment_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add ``segments`` (sentences in order) and their ``tokens``."""
    parts = docs.withColumn("segments", text.segments(text.clean_text(F.col(text_column))))
    return parts.withColumn("tokens", F.transform("segments", text.estimate_tokens))


def chunk_texts(raw: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """The chunk contents of one text, in order."""

    def cut(parts: Column) -> Column:
        def join(bounds: Column) -> Column:
            return F.transform(
                bounds, lambda b: F.array_join(F.slice(parts, b["first"] + 1, b["end"] - b["first"]), " ")
            )

        sizes = F.transform(parts, text.estimate_tokens)
        return join(text.let(sizes, lambda tokens: pack(tokens, max_tokens, overlap_tokens)))

    return text.let(text.segments(text.clean_text(raw)), cut)


def chunk_documents(
    docs: DataFrame,
    *,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    layer_version: int | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Clean, segment, pack, number and identify; blank documents give no rows.

    ``docs`` has ``doc_id, source_id, filename, text`` and, unless ``layer_version`` is given, that
    column too. The whole job is one narrow stage: no shuffle.
    """
    version = F.col("layer_version") if layer_version is None else F.lit(layer_version)
    stamped = F.current_timestamp() if ingested_at is None else ingested_at
    exploded = docs.select(
        "doc_id", "source_id", "filename", version.cast("int").alias("layer_version"),
        stamped.alias("ingested_at"),
        F.posexplode(chunk_texts(F.col("text"), max_tokens, overlap_tokens)).alias("ordinal", "content"),
    )
    return exploded.select(
        ids.chunk_id(F.col("doc_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"),
        "doc_id",
        "source_id",
        F.col("ordinal").cast("int").alias("ordinal"),
        "content",
        F.length("content").alias("char_count"),
        "layer_version",
        ids.era(F.col("layer_version")).alias("geological_age"),
        "ingested_at",
        F.create_map(
            F.lit("filename"), F.col("filename"),
            F.lit("tokens_est"), text.estimate_tokens(F.col("content")).cast("string"),
        ).alias("metadata"),
    )


def ingest_summary(docs: DataFrame, chunks: DataFrame, indexed: DataFrame, *, model_id: str, embed_dim: int) -> DataFrame:
    """Per document and layer: chunks made and chunks indexed; 0 and 0 for blank text."""
    made = chunks.groupBy("doc_id", "layer_version").agg(F.count("*").alias("made"))
    stored = (
        indexed.filter((F.col("model_id") == model_id) & (F.col("embed_dim") == embed_dim))
        .groupBy("doc_id", "layer_version").agg(F.count("*").alias("stored"))
    )
    keys = ["doc_id", "layer_version"]
    return (
        docs.select("doc_id", "filename", "layer_version").distinct()
        .join(made, keys, "left").join(stored, keys, "left")
        .select(
            "doc_id", "filename",
            F.coalesce("made", F.lit(0)).alias("chunks_total"),
            F.coalesce("stored", F.lit(0)).alias("chunks_indexed"),
            "layer_version", F.lit(model_id).alias("embed_model"), F.lit(embed_dim).alias("embed_dim"),
        )
    )
