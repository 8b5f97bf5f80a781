"""Claims on work as a stream: each key is granted to one asker until it is done or the claim is 3600 seconds old.

Entries are keyed state of the stream, so a batch that runs again starts from the state before it and decides the
same. Every request counts at its own time, not at that of its micro-batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.ledger import CLAIM_TTL, PENDING, PROCESSED
from corpusmill.operators.upsert import AppendTable

#: ``claim`` asks for a key, ``finish`` asks and is done once granted, ``commit`` says that it is done, ``release`` gives a claim back.
ACTIONS = ("claim", "finish", "commit", "release")
REQUESTS = "key string, asked_at timestamp, action string"
OUTCOMES = "key string, action string, requests long, outcome string, decided_at timestamp"
_DECIDED = "key string, action string, requests long, outcome string, at long"
_STATE = "claim"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(entry: tuple | None, action: str, at: int, ttl: int) -> tuple[str, tuple | None]:
    """Outcome of one request at time ``at`` (microseconds), and the key's entry (status, since) after it."""
    status, since = entry or (None, 0)
    if action == "commit":
        return "committed", (PROCESSED, at)
    if action == "release":
        return ("released", None) if status == PENDING else ("nothing", entry)
    if status == PROCESSED:
        return "processed", entry
    if status == PENDING and at - since < ttl * 1_000_000:
        return "locked", entry
    return "claimed", (PROCESSED if action == "finish" else PENDING, at)


class _Claims(StatefulProcessor):
    """One entry per key. A timer in event time frees it when the claim, or with ``keep`` the finished work, is too old."""

    def __init__(self, ttl: int, keep: int | None) -> None:
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState(_STATE, "status string, since long")

    def _expiry(self, entry: tuple | None) -> int | None:
        """The millisecond from which the entry no longer counts."""
        life = entry and (self.ttl if entry[0] == PENDING else self.keep)
        return None if life is None else -(-entry[1] // 1000) + life * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = entry = tuple(self.entry.get()) if self.entry.exists() else None
        asked: Counter[tuple[int, int]] = Counter()
        for row in rows:
            asked[row.at, ACTIONS.index(row.action)] += row.requests
        for (at, number), requests in sorted(asked.items()):
            action = ACTIONS[number]
            if entry and entry[0] == PROCESSED and self.keep is not None and at >= entry[1] + self.keep * 1_000_000:
                entry = None
            outcome, entry = decide(entry, action, at, self.ttl)
            first = 1 if outcome in ("claimed", "released") else requests
            yield Row(key=key[0], action=action, requests=first, outcome=outcome, at=at)
            if requests > first:
                outcome, entry = decide(entry, action, at, self.ttl)
                yield Row(key=key[0], action=action, requests=requests - first, outcome=outcome, at=at)
        if entry != before:
            old, new = self._expiry(before), self._expiry(entry)
            if old is not None:
                self.handle.deleteTimer(old)
            if entry:
                self.entry.update(entry)
            else:
                self.entry.clear()
            if new is not None:
                self.handle.registerTimer(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists() and self._expiry(tuple(self.entry.get())) == expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def _combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal requests of an Arrow batch as one row with a count, before anything is shuffled."""
    for frame in frames:
        yield frame.groupby(["key", "asked_at", "action"], as_index=False).size().rename(columns={"size": "requests"})


class ClaimStream:
    """Requests ``key, asked_at, action`` to outcomes, one row per distinct request with how many were alike.

    Requests of a key are decided in order of time; alike ones count one by one, so the first may be granted and the
    others locked. ``lateness`` is how far requests may arrive behind the latest one; older ones are dropped, as are
    requests without key or time or with another action. Claims are freed after ``ttl`` seconds, finished keys stay
    unless ``keep`` seconds are given. Outcomes are appended by batch, and a batch that runs again replaces its own.
    """

    def __init__(self, spark: SparkSession, root: str, *, ttl: int = CLAIM_TTL, keep: int | None = None, lateness: str = "1 hour") -> None:
        self.spark, self.ttl, self.keep, self.lateness = spark, ttl, keep, lateness
        self.outcomes = AppendTable(spark, f"{root}/outcomes", OUTCOMES, "decided_at")

    def decided(self, requests: DataFrame) -> DataFrame:
        known = requests.where(F.col("key").isNotNull() & F.col("asked_at").isNotNull() & F.col("action").isin(*ACTIONS))
        counted = known.select("key", "asked_at", "action").mapInPandas(_combined, f"{REQUESTS}, requests long")
        counted = counted.withColumn("at", F.unix_micros("asked_at")).withWatermark("asked_at", self.lateness)
        found = counted.groupBy("key").transformWithState(_Claims(self.ttl, self.keep), _DECIDED, "Append", "EventTime")
        return found.select("key", "action", "requests", "outcome", F.timestamp_micros("at").alias("decided_at"))

    def start(self, requests: DataFrame, checkpoint: str) -> StreamingQuery:
        conf, before = self.spark.conf, self.spark.conf.get(_PROVIDER)
        conf.set(_PROVIDER, _ROCKS)  # the only store with timers; a query keeps the one it starts with
        try:
            return (
                self.decided(requests).writeStream.foreachBatch(self.outcomes.append).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start()
            )
        finally:
            conf.set(_PROVIDER, before)

    def entries(self, checkpoint: str) -> DataFrame:
        """``key, status, since`` as the last finished batch left them, read from the stream's state."""
        state = self.spark.read.format("statestore").option("stateVarName", _STATE).load(checkpoint)
        return state.select(F.col("key.key").alias("key"), F.col("value.status").alias("status"), F.timestamp_micros("value.since").alias("since"))
