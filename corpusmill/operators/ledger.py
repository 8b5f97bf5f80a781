"""The processing ledger: which keys are done, claimed, or free, as a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.upsert import KeyedTable
from corpusmill.schemas import LEDGER

# Claim and document-skip lifetimes in seconds.
CLAIM_TTL = 3600
DOCUMENT_TTL = 30 * 24 * 3600

PROCESSED, PENDING, RELEASED = "PROCESSED", "PENDING", "RELEASED"


def skip_processed(work: DataFrame, ledger: DataFrame, key: str = "key") -> DataFrame:
    """Work whose key is not processed yet."""
    done = ledger.filter(F.col("status") == PROCESSED).select(F.col("key").alias(key))
    return work.join(done, key, "left_anti")


def skip_recent(work: DataFrame, ledger: DataFrame, now: Column, ttl: int = DOCUMENT_TTL, key: str = "key") -> DataFrame:
    """Document-level skip: an entry counts until its lifetime is over."""
    alive = F.col("processed_at") + F.make_dt_interval(secs=F.lit(ttl)) > now
    return skip_processed(work, ledger.filter(alive), key)


def claim_outcomes(work: DataFrame, ledger: DataFrame, now: Column, ttl: int = CLAIM_TTL) -> DataFrame:
    """One row per distinct key with ``requests`` (how often it was asked for) and ``outcome``.

    ``processed``: done before. ``locked``: somebody's claim is younger than ``ttl``. ``claimed``:
    free, or the old claim has expired. Duplicates within the batch collapse on the map side, so a
    hot key costs one row per task.
    """
    asked = work.groupBy("key").agg(F.count("*").alias("requests"))
    held = ledger.filter(F.col("status") != RELEASED).select("key", "status", "claimed_at")
    fresh = F.col("claimed_at") + F.make_dt_interval(secs=F.lit(ttl)) > now
    return asked.join(held, "key", "left").select(
        "key",
        "requests",
        F.when(F.col("status") == PROCESSED, "processed")
        .when((F.col("status") == PENDING) & fresh, "locked")
        .otherwise("claimed")
        .alias("outcome"),
    )


def claim_counters(outcomes: DataFrame) -> DataFrame:
    """total, claimed, skipped_processed, skipped_locked; repeats of a claimed key count as locked."""
    n = F.col("requests")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")

    return outcomes.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total"),
        total(F.col("outcome") == "claimed", F.lit(1)).alias("claimed"),
        total(F.col("outcome") == "processed", n).alias("skipped_processed"),
        (total(F.col("outcome") == "locked", n) + total(F.col("outcome") == "claimed", n - 1)).alias("skipped_locked"),
    )


def claim_rows(keys: DataFrame, now: Column) -> DataFrame:
    return keys.select(
        "key", F.lit(PENDING).alias("status"), F.lit(None).cast("string").alias("ref"),
        now.alias("claimed_at"), F.lit(None).cast("timestamp").alias("processed_at"),
    )


def commit_rows(done: DataFrame, now: Column) -> DataFrame:
    """PROCESSED entries for ``(key, ref)``."""
    return done.select(
        "key", F.lit(PROCESSED).alias("status"), "ref",
        F.lit(None).cast("timestamp").alias("claimed_at"), now.alias("processed_at"),
    )


def released(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """The ledger without the named keys' claims; processed entries stay."""
    claims = F.col("status") == PENDING
    return ledger.filter(~claims).unionByName(ledger.filter(claims).join(keys, "key", "left_anti"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.count_if(F.col("status") == PROCESSED).alias("processed"),
        F.count_if(F.col("status") == PENDING).alias("pending"),
    )


def null_ledger(spark: SparkSession) -> DataFrame:
    """Nothing is ever skipped; the keyed upsert downstream keeps results right."""
    return spark.createDataFrame([], LEDGER)


class Ledger:
    """The ledger kept in a keyed table. A release is stored as a RELEASED row, which reads hide."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64) -> None:
        self.table = KeyedTable(spark, path, LEDGER, ["key"], buckets=buckets)

    def read(self) -> DataFrame:
        return self.table.read().filter(F.col("status") != RELEASED)

    def claim(self, work: DataFrame, now: Column, ttl: int = CLAIM_TTL) -> DataFrame:
        """Decide the batch's outcomes and record its claims; returns the outcomes.

        Of two claimers of a key at one time one wins: the other's commit fails, and it decides again.
        """
        from corpusmill.session import checkpointed

        decided: list[DataFrame] = []

        def decide(ledger: DataFrame) -> DataFrame:
            decided.append(checkpointed(claim_outcomes(work, ledger.filter(F.col("status") != RELEASED), now, ttl)))
            return claim_rows(decided[-1].filter(F.col("outcome") == "claimed"), now)

        self.table.transact(decide)
        return decided[-1]

    def commit(self, done: DataFrame, now: Column) -> None:
        self.table.upsert(commit_rows(done, now))

    def release(self, keys: DataFrame) -> None:
        wanted = keys.select("key").distinct()
        pending = F.col("status") == PENDING
        self.table.transact(
            lambda ledger: ledger.filter(pending).join(wanted, "key", "left_semi").withColumn("status", F.lit(RELEASED)))

    def stats(self) -> DataFrame:
        return ledger_stats(self.read())
