"""Claims as keyed state: replays, requests of one key at different times, expiry."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.session import scratch_path
from corpusmill.streaming import claims

HOUR = 3600


def ask(spark, root, part, rows):
    """Rows (key, second, action) as one file of requests."""
    frame = spark.createDataFrame(rows, "key string, second long, action string")
    frame.select("key", F.timestamp_seconds(F.lit(1_706_745_600) + F.col("second")).alias("asked_at"), "action").repartition(3).write.parquet(f"{root}/in/{part}")


def drain(spark, root, **options):
    job = claims.ClaimStream(spark, f"{root}/state", **options)
    job.start(spark.readStream.schema(claims.REQUESTS).parquet(f"{root}/in/*"), f"{root}/progress").awaitTermination()
    return job


def outcomes(job):
    rows = job.outcomes.read().select("key", (F.unix_seconds("decided_at") - 1_706_745_600).alias("second"), "action", "outcome", "requests")
    return sorted(tuple(row) for row in rows.collect())


@pytest.mark.parametrize("entry, action, at, outcome, after", [
    (None, "claim", 5, "claimed", ("PENDING", 5)), (None, "finish", 5, "claimed", ("PROCESSED", 5)), (None, "release", 5, "nothing", None),
    (("PENDING", 0), "claim", 9_999_999, "locked", ("PENDING", 0)), (("PENDING", 0), "claim", 10_000_000, "claimed", ("PENDING", 10_000_000)),
    (("PENDING", 0), "release", 5, "released", None), (("PENDING", 0), "commit", 5, "committed", ("PROCESSED", 5)),
    (("PROCESSED", 0), "claim", 10**15, "processed", ("PROCESSED", 0)), (("PROCESSED", 0), "release", 1, "nothing", ("PROCESSED", 0)),
])
def test_one_request(entry, action, at, outcome, after):
    assert claims.decide(entry, action, at, 10) == (outcome, after)


def test_requests_of_one_batch_count_at_their_own_time(spark):
    root = scratch_path(spark, "claims")
    ask(spark, root, 0, [("a", 2 * HOUR, "claim"), ("a", 0, "claim"), ("a", 60, "claim"), ("b", 0, "claim"), ("b", 0, "claim"), ("b", 0, "claim"),
                         ("c", 0, "finish"), ("c", 0, "finish"), ("c", 5 * HOUR, "claim"), ("d", 0, "claim"), ("d", 10, "release"), ("d", 20, "claim"),
                         (None, 0, "claim"), ("e", None, "claim"), ("e", 1, "unknown")])
    assert outcomes(drain(spark, root)) == [
        ("a", 0, "claim", "claimed", 1), ("a", 60, "claim", "locked", 1), ("a", 2 * HOUR, "claim", "claimed", 1), ("b", 0, "claim", "claimed", 1),
        ("b", 0, "claim", "locked", 2), ("c", 0, "finish", "claimed", 1), ("c", 0, "finish", "processed", 1), ("c", 5 * HOUR, "claim", "processed", 1),
        ("d", 0, "claim", "claimed", 1), ("d", 10, "release", "released", 1), ("d", 20, "claim", "claimed", 1)]


def test_a_batch_that_runs_again_decides_the_same(spark):
    root = scratch_path(spark, "claims")
    ask(spark, root, 0, [("a", 0, "claim"), ("b", 0, "finish")])
    drain(spark, root)
    ask(spark, root, 1, [("a", 60, "commit"), ("c", 60, "claim"), ("c", 61, "claim"), ("b", 70, "claim")])
    job = drain(spark, root)
    first, entries = outcomes(job), sorted(map(tuple, job.entries(f"{root}/progress").select("key", "status").collect()))
    assert [row[3] for row in first if row[1] >= 60] == ["committed", "processed", "claimed", "locked"]
    # The driver died before it could note that the last batches were done: they run again.
    commits = Path(root.removeprefix("file:")) / "progress/commits"
    numbers = sorted(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for number in numbers[1:]:
        (commits / str(number)).unlink()
        (commits / f".{number}.crc").unlink(missing_ok=True)
    job = drain(spark, root)
    assert outcomes(job) == first
    assert sorted(map(tuple, job.entries(f"{root}/progress").select("key", "status").collect())) == entries
    assert not (Path(root.removeprefix("file:")) / "state/ledger").exists()


def test_old_entries_leave_the_state(spark):
    root = scratch_path(spark, "claims")
    ask(spark, root, 0, [("a", 0, "claim"), ("b", 0, "finish")])
    drain(spark, root, keep=3 * HOUR)
    ask(spark, root, 1, [("z", 10 * HOUR, "claim")])
    job = drain(spark, root, keep=3 * HOUR)
    assert [row.key for row in job.entries(f"{root}/progress").collect()] == ["z"]
    ask(spark, root, 2, [("a", 10 * HOUR, "claim"), ("b", 10 * HOUR, "claim"), ("late", 0, "claim")])
    assert [row[:4] for row in outcomes(drain(spark, root, keep=3 * HOUR)) if row[1] == 10 * HOUR or row[0] == "late"] == [
        (key, 10 * HOUR, "claim", "claimed") for key in "abz"]


def test_many_askers_of_one_key_are_counted_before_the_shuffle(spark):
    root = scratch_path(spark, "claims")
    spark.range(60_000).select(
        F.lit("hot").alias("key"), F.timestamp_seconds(F.lit(1_706_745_600) + F.col("id") % 5).alias("asked_at"), F.lit("claim").alias("action")).write.parquet(f"{root}/in/0")
    found = outcomes(drain(spark, root))
    assert sum(row[4] for row in found) == 60_000
    assert [row[4] for row in found if row[3] == "claimed"] == [1]
