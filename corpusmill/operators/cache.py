"""The prompt cache: look up, answer each distinct miss once, write back, bound the size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.upsert import KeyedTable, latest_per_key
from corpusmill.schemas import PROMPT_CACHE
from corpusmill.session import scratch_path

# Entries kept in memory by the bounded cache, and lifetime in seconds.
CAPACITY = 4096
TTL = 604800


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached ``value`` (null on a miss) and a ``cached`` flag."""
    return requests.join(cache.select("key", "value"), "key", "left").withColumn("cached", F.col("value").isNotNull())


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One request per key that the cache does not hold.

    Equal keys stand for equal prompts, so any of their requests will do.
    """
    return latest_per_key(requests.join(cache.select("key"), "key", "left_anti"), ["key"])


def answer(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(requests with ``value`` and ``cached``, new cache rows ``key, value``).

    ``compute`` turns distinct misses into ``key, value``.
    """
    fresh = compute(misses(requests, cache)).select("key", "value")
    known = cache.select("key", "value", F.lit(True).alias("cached"))
    everything = known.unionByName(fresh.withColumn("cached", F.lit(False)))
    return requests.join(everything, "key", "left"), fresh


def cache_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The stored cache, one row per key."""
    return KeyedTable(spark, path, PROMPT_CACHE, ["key"], buckets=buckets)


def serve(store: KeyedTable, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """Answer ``requests`` and keep what they did: new answers are stored, and hits count as used ``now``.

    The answers are written before the table is, so they do not see their own rows as hits.
    """
    known = store.read()
    answered, fresh = answer(requests, known, compute)
    path = scratch_path(store.spark, "answered")
    answered.write.parquet(path)
    answered = store.spark.read.schema(answered.schema).parquet(path)
    added = answered.filter("NOT cached").select("key", "value", now.alias("put_at"), now.alias("last_used"))
    used = answered.filter("cached").select("key").distinct()
    touched = known.join(used, "key", "left_semi").withColumn("last_used", now)
    store.upsert(added.unionByName(touched))
    return answered


def evict(cache: DataFrame, now: Column, capacity: int = CAPACITY, ttl: int = TTL) -> DataFrame:
    """Entries still alive, the ``capacity`` most recently used of them."""
    alive = F.col("put_at") + F.make_dt_interval(secs=F.lit(ttl)) >= now
    return cache.filter(alive).orderBy(F.col("last_used").desc(), F.col("key")).limit(capacity)
