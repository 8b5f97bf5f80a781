"""Embedding text, and the idempotent batch that embeds only what is new."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import ids
from corpusmill.operators.ledger import Ledger, claim_counters
from corpusmill.operators.upsert import KeyedTable
from corpusmill.session import checkpointed

# Default model name and size of the deterministic embedder; texts per model call.
MODEL_ID = "mock-deterministic-v1"
DIMENSIONS = 384
BATCH = 64


class HashEmbedder:
    """Unit vectors drawn from a generator seeded by the text's hash: equal texts, equal vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, model_id: str = MODEL_ID) -> None:
        if dimensions < 2:
            raise ValueError("dimensions must be at least 2")
        self.dimensions, self.model_id = dimensions, model_id

    def encode(self, texts: list[str]) -> np.ndarray:
        vectors = np.empty((len(texts), self.dimensions), dtype=np.float32)
        for row, text in enumerate(texts):
            seed = int(hashlib.sha256(text.encode()).hexdigest()[8:16], 16)
            drawn = np.random.default_rng(seed).standard_normal(self.dimensions).astype(np.float32)
            length = np.linalg.norm(drawn)
            if length == 0:
                drawn[0] = length = np.float32(1)
            vectors[row] = drawn / length
        return vectors


Factory = Callable[[], object]


def embed(df: DataFrame, factory: Factory = HashEmbedder, *, text: str = "content", embedding: str = "embedding",
          batch: int = BATCH) -> DataFrame:
    """Add ``embedding`` and ``embed_error`` columns.

    ``factory`` builds an object with ``encode(list[str]) -> array[n, dim]`` once per task. It is
    called with ``batch`` texts at a time; when a call fails its rows get the error and no vector.
    """
    schema = df.schema.simpleString()[len("struct<"):-1]
    columns = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            vectors: list = []
            errors: list = []
            for at in range(0, len(frame), batch):
                texts = frame[text].iloc[at:at + batch].tolist()
                try:
                    found = np.asarray(model.encode(texts), dtype=np.float32)
                    if found.shape[0] != len(texts):
                        raise ValueError(f"{found.shape[0]} vectors for {len(texts)} texts")
                    vectors += list(found)
                    errors += [None] * len(texts)
                except Exception as problem:  # noqa: BLE001 - reported per row
                    vectors += [None] * len(texts)
                    errors += [f"{type(problem).__name__}: {problem}"] * len(texts)
            yield frame[columns].assign(**{embedding: vectors, "embed_error": errors})

    return df.mapInPandas(run, f"{schema}, {embedding}: array<float>, embed_error: string")


def embed_and_store(chunks: DataFrame, vectors: KeyedTable, factory: Factory, model_id: str, embed_dim: int, batch: int = BATCH) -> DataFrame:
    """Embed once, upsert what worked, and return the input keys with an ``embedded`` flag."""
    made = checkpointed(embed(chunks, factory, batch=batch))
    worked = F.col("embed_error").isNull() & (F.size("embedding") == embed_dim)
    named = made.withColumn("model_id", F.lit(model_id)).withColumn("embed_dim", F.lit(embed_dim))
    vectors.upsert(named.filter(worked))
    return made.withColumn("embedded", F.coalesce(worked, F.lit(False))).drop("embedding", "content")


def embed_chunks(chunks: DataFrame, *, ledger: Ledger | None, vectors: KeyedTable, now: Column, factory: Factory = HashEmbedder,
                 model_id: str = MODEL_ID, embed_dim: int = DIMENSIONS, batch: int = BATCH) -> DataFrame:
    """Embed and store the chunks whose ``model:dim:chunk`` key is free; returns the counters.

    Finished and claimed keys are joined away before the Python stage. Failed batches give their
    claims back. Without a ledger everything is embedded and the keyed upsert keeps one row per key.
    """
    from corpusmill.operators.upsert import latest_per_key

    keyed = chunks.withColumn("key", ids.ledger_key(F.lit(model_id), F.lit(embed_dim), F.col("chunk_id")))
    if ledger is None:
        outcomes = keyed.groupBy("key").agg(F.count("*").alias("requests")).withColumn("outcome", F.lit("claimed"))
        work = keyed
    else:
        outcomes = ledger.claim(keyed.select("key"), now)
        work = keyed.join(outcomes.filter(F.col("outcome") == "claimed").select("key"), "key", "left_semi")
    done = embed_and_store(latest_per_key(work, ["key"]), vectors, factory, model_id, embed_dim, batch)
    good, wrong = done.filter("embedded"), done.filter("NOT embedded")
    if ledger is not None:
        ledger.commit(good.select("key", F.concat(F.lit("vector:"), "chunk_id").alias("ref")), now)
        ledger.release(wrong.select("key"))
    failed = done.agg(F.count_if(~F.col("embedded")).alias("failed"))
    both = claim_counters(outcomes).unionByName(failed, allowMissingColumns=True)
    names = ("total", "claimed", "skipped_processed", "skipped_locked", "failed")
    return both.agg(*[F.max(name).alias(name) for name in names]).select(
        "total", (F.col("claimed") - F.col("failed")).alias("embedded"), "skipped_processed", "skipped_locked", "failed"
    )
