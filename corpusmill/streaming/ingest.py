"""Queue-driven ingest: messages to silver documents, and on to vectors when asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import ids
from corpusmill.operators.chunking import chunk_documents
from corpusmill.operators.embed import DIMENSIONS, MODEL_ID, HashEmbedder, embed_and_store
from corpusmill.operators.ledger import Ledger, skip_processed
from corpusmill.operators.metrics import message_outcomes
from corpusmill.session import checkpointed
from corpusmill.sources.scans import extract_documents
from corpusmill.sources.sinks import silver_table, vector_table
from corpusmill.streaming.messages import DEAD, TASK, parse_messages

# Fixed value: receives before a message is a dead letter.
MAX_RECEIVES = 5

QUEUE = "message_id string, body string, attempt int"
Fetch = Callable[[DataFrame], DataFrame]


def object_store(root: str) -> Fetch:
    """Read ``root/bucket/key`` for each task, one object at a time, where the task runs."""

    def fetch(tasks: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            for frame in frames:
                for bucket, key in zip(frame["bucket"], frame["key"]):
                    try:
                        store, path = fs.FileSystem.from_uri(f"{root}/{bucket}/{key}" if "://" in root else f"file://{root}/{bucket}")
                        with store.open_input_stream(path if "://" in root else f"{path}/{key}") as stream:
                            row = (bucket, key, stream.read(), None)
                    except (OSError, ValueError) as problem:
                        row = (bucket, key, None, str(problem))
                    yield pd.DataFrame([row], columns=["bucket", "key", "content", "fetch_error"])

        return tasks.select("bucket", "key").mapInPandas(run, "bucket string, key string, content binary, fetch_error string")

    return fetch


def table_store(objects: DataFrame) -> Fetch:
    """Objects kept in a table ``(bucket, key, content)``."""

    def fetch(tasks: DataFrame) -> DataFrame:
        # The tasks' side is hashed: objects are not sorted, which would spill their contents.
        found = tasks.select("bucket", "key").hint("shuffle_hash").join(objects, ["bucket", "key"], "left")
        missing = F.when(F.col("content").isNull(), F.lit("no such object"))
        return found.select("bucket", "key", "content", missing.alias("fetch_error"))

    return fetch


def split_failures(messages: DataFrame, failed_ids: DataFrame, max_receives: int = MAX_RECEIVES) -> tuple[DataFrame, DataFrame]:
    """(messages to receive again with ``attempt + 1``, dead letters with their whole body)."""
    failed = messages.join(failed_ids.select("message_id").distinct(), "message_id", "left_semi")
    exhausted = F.col("attempt") >= max_receives
    again = failed.filter(~exhausted).withColumn("attempt", F.col("attempt") + 1)
    dead = failed.filter(exhausted).select("message_id", "body", "attempt")
    return again, dead


@dataclass
class QueueIngest:
    """A micro-batch job over a queue folder, with everything it keeps below ``root``.

    ``inbox`` holds new messages as JSON lines; failed ones are written to ``retry``, which is read
    by the same stream, and end in ``dead``. Paths carry the batch id, so a batch that runs again
    after a failure writes the same files.
    """

    spark: SparkSession
    root: str
    fetch: Fetch
    index: bool = False
    embedder: Callable[[], object] = HashEmbedder
    model_id: str = MODEL_ID
    embed_dim: int = DIMENSIONS
    buckets: int = 16
    max_receives: int = MAX_RECEIVES
    ledger: Ledger = field(init=False)

    def __post_init__(self) -> None:
        self.ledger = Ledger(self.spark, f"{self.root}/ledger", buckets=self.buckets)
        self.silver = silver_table(self.spark, f"{self.root}/silver", buckets=self.buckets)
        self.vectors = vector_table(self.spark, f"{self.root}/vectors", buckets=self.buckets)

    def source(self) -> DataFrame:
        """New messages and retries as one stream."""
        return self.spark.readStream.schema(QUEUE).json(f"{self.root}/queue/*")

    def start(self, checkpoint: str) -> StreamingQuery:
        return (
            self.source().writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. A message fails when any of its objects fails; finished objects are in
        the ledger, so they are skipped when the message comes again."""
        now = F.current_timestamp()
        messages = checkpointed(batch.withColumn("attempt", F.coalesce("attempt", F.lit(1))))
        parsed = parse_messages(messages)
        uri = F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key")
        tasks = parsed.filter(F.col("parsed") == TASK).withColumns(
            {"ledger_key": ids.task_key(F.col("bucket"), F.col("key")), "source_uri": uri}
        )
        open_tasks = skip_processed(tasks, self.ledger.read(), "ledger_key")
        wanted = open_tasks.select("bucket", "key", "ledger_key", "source_uri").distinct()
        objects = checkpointed(self.fetch(wanted))
        silver, rejected = extract_documents(
            objects.filter(F.col("content").isNotNull()),
            filename=F.col("key"), content_type=F.lit(""), source_uri=uri, uploaded_at=now,
        )
        stored = self.silver.upsert(silver)
        lost = objects.filter(F.col("content").isNull()).select(uri.alias("source_uri"))
        failed = lost.unionByName(rejected.select("source_uri"))
        if self.index:
            chunks = chunk_documents(stored, layer_version=1, ingested_at=now)
            embedded = embed_and_store(chunks, self.vectors, self.embedder, self.model_id, self.embed_dim)
            broken = embedded.filter("NOT embedded").select("doc_id")
            failed = failed.unionByName(silver.join(broken, "doc_id", "left_semi").select("source_uri"))
        failures = checkpointed(failed.distinct())
        done = wanted.join(failures, "source_uri", "left_anti")
        prefix = "indexed:" if self.index else "silver:"
        self.ledger.commit(done.select(F.col("ledger_key").alias("key"), F.concat(F.lit(prefix), "key").alias("ref")), now)
        per_object = open_tasks.join(failures.withColumn("failed", F.lit(True)), "source_uri", "left").select(
            "message_id", F.coalesce("failed", F.lit(False)).alias("failed")
        )
        failed_ids = message_outcomes(per_object).filter("failed").select("message_id").unionByName(
            parsed.filter(F.col("parsed") == DEAD).select("message_id")
        )
        again, dead = split_failures(messages, failed_ids, self.max_receives)
        again.write.mode("overwrite").json(f"{self.root}/queue/retry-{batch_id}")
        dead.write.mode("overwrite").json(f"{self.root}/dead/batch={batch_id}")


def without_redeliveries(messages: DataFrame, sent_at: str = "sent_at", horizon: str = "10 minutes") -> DataFrame:
    """Drop a message id seen before within the horizon; the ledger covers anything older."""
    return messages.withWatermark(sent_at, horizon).dropDuplicatesWithinWatermark(["message_id"])
