"""Document layers: listing, time travel, next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER_COLUMNS = ["chunk_id", "doc_id", "source_id", "ordinal", "content", "layer_version", "geological_age"]


def provenance(vectors: DataFrame, model_id: str, embed_dim: int, source_id: str | None = None) -> DataFrame:
    """Rows of one model's vector space, optionally of one source."""
    scoped = vectors.filter((F.col("model_id") == model_id) & (F.col("embed_dim") == embed_dim))
    return scoped if source_id is None else scoped.filter(F.col("source_id") == source_id)


def list_layers(chunks: DataFrame) -> DataFrame:
    """Per source: ascending distinct versions and the latest one."""
    return chunks.groupBy("source_id").agg(
        F.sort_array(F.collect_set("layer_version")).alias("available_versions"),
        F.max("layer_version").alias("latest_version"),
    )


def layer(chunks: DataFrame, layer_version: int, source_id: str | None = None) -> DataFrame:
    """One layer's chunks; order by ``ordinal`` to read them."""
    chosen = chunks.filter(F.col("layer_version") == layer_version)
    if source_id is not None:
        chosen = chosen.filter(F.col("source_id") == source_id).orderBy("ordinal")
    return chosen.select(*LAYER_COLUMNS)


def time_travel(chunks: DataFrame, version: int | None = None) -> DataFrame:
    """Every source at a chosen version, or at its latest, with how that relates to the others.

    Sources without that version give no rows. The versions of a source come from an aggregate that
    is joined back, so a source with very many chunks is not gathered in one task.
    """
    wanted = F.col("latest_version") if version is None else F.lit(version)
    return (
        chunks.select(*LAYER_COLUMNS).join(list_layers(chunks), "source_id")
        .filter(F.col("layer_version") == wanted)
        .select(
            *LAYER_COLUMNS, "latest_version", "available_versions",
            (F.col("layer_version") == F.col("latest_version")).alias("is_latest"),
        )
    )


def latest_layer(chunks: DataFrame) -> DataFrame:
    return time_travel(chunks).select(*LAYER_COLUMNS)


def next_versions(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """``source_id`` with the version its next text will get: latest + 1, or 1."""
    latest = chunks.groupBy("source_id").agg(F.max("layer_version").alias("latest_version"))
    return sources.join(latest, "source_id", "left").withColumn(
        "layer_version", (F.coalesce("latest_version", F.lit(0)) + 1).cast("int")
    ).drop("latest_version")


def persisted_versions(requested: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The version each source reports: null where its text gave no chunk."""
    stored = new_chunks.select("source_id", F.col("layer_version").alias("persisted_version")).distinct()
    return requested.select("source_id").distinct().join(stored, "source_id", "left")
