"""Streams, run to completion with an available-now trigger."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ann
from corpusmill.operators.embed import HashEmbedder
from corpusmill.operators.upsert import AppendTable
from corpusmill.session import scratch_path
from corpusmill.streaming import ingest, messages, metrics, refresh, sketches


def event(*keys, bucket="raw"):
    return json.dumps({"Records": [{"s3": {"bucket": {"name": bucket}, "object": {"key": key}}} for key in keys]})


@pytest.mark.parametrize("body,state,tasks", [
    ('{"bucket":"b","key":"my+file.txt"}', "task", [("b", "my+file.txt")]),
    (event("a.txt"), "task", [("raw", "a.txt")]),
    (event("a.txt", "b.txt"), "task", [("raw", "a.txt"), ("raw", "b.txt")]),
    (event("my+report%20final.txt"), "task", [("raw", "my report final.txt")]),
    (event("a%zz%20c+d"), "task", [("raw", "a%zz c d")]),
    (event("50%"), "task", [("raw", "50%")]),
    ('{"Event":"s3:TestEvent","Bucket":"b"}', "nothing", []),
    ('{"Records":[{"nope":1}]}', "nothing", []),
    ('{"Records":[{"nope":1},{"s3":{"bucket":{"name":"raw"},"object":{"key":"k"}}}]}', "task", [("raw", "k")]),
    ('{"foo":1}', "dead", []),
    ('["a"]', "dead", []),
    ("{bad", "dead", []),
    ('"text"', "dead", []),
])
def test_message_shapes(spark, body, state, tasks):
    frame = spark.createDataFrame([("m", body)], "message_id string, body string")
    found = messages.parse_messages(frame).collect()
    assert {row.parsed for row in found} == {state}
    assert [(row.bucket, row.key) for row in found if row.key is not None] == tasks


def picky():
    """An embedder that fails on texts that say so."""

    class Picky(HashEmbedder):
        def encode(self, texts):
            if any("explode" in text for text in texts):
                raise RuntimeError("model failed")
            return super().encode(texts)

    return lambda: Picky(8)


def run_queue(spark, root, bodies, number):
    folder = f"{root}/queue/inbox-{number}"
    spark.createDataFrame(bodies, "message_id string, body string").write.json(folder)


def test_ingest_stream_retries_and_dead_letters(spark, tmp_path):
    store = tmp_path / "store" / "raw"
    store.mkdir(parents=True)
    (store / "a.txt").write_text("Alpha fact. Beta fact.")
    (store / "b.md").write_text("Bravo.")
    (store / "x.bin").write_bytes(b"\x00")
    root = scratch_path(spark, "ingest")
    job = ingest.QueueIngest(
        spark, root, ingest.object_store(str(tmp_path / "store")), index=True, embedder=picky(), embed_dim=8, buckets=2, max_receives=2)
    run_queue(spark, root, [
        ("m1", event("a.txt")), ("m2", event("b.md", "gone.txt")), ("m3", '{"foo":1}'), ("m4", '{"Event":"s3:TestEvent"}'), ("m5", event("x.bin"))], 1)
    checkpoint = scratch_path(spark, "checkpoint")
    job.start(checkpoint).awaitTermination()
    assert {r.filename for r in job.silver.read().collect()} == {"a.txt", "b.md"}
    assert job.silver.read().filter("filename = 'a.txt'").first().source_uri == "s3://raw/a.txt"
    assert {r.key for r in job.ledger.read().filter("status = 'PROCESSED'").collect()} == {"sqs:raw:a.txt", "sqs:raw:b.md"}
    assert job.vectors.read().count() == 2
    retry = spark.read.schema(ingest.QUEUE).json(f"{root}/queue/retry-0")
    assert {(r.message_id, r.attempt) for r in retry.collect()} == {("m2", 2), ("m3", 2), ("m5", 2)}
    (store / "gone.txt").write_text("Found after all.")
    run_queue(spark, root, [("m1", event("a.txt"))], 2)
    job.start(checkpoint).awaitTermination()
    assert {r.filename for r in job.silver.read().collect()} == {"a.txt", "b.md", "gone.txt"}
    dead = spark.read.schema(ingest.QUEUE).json(f"{root}/dead/*")
    assert {r.message_id for r in dead.collect()} == {"m3", "m5"}
    assert job.vectors.read().count() == 3


def test_dead_letters_keep_their_whole_body(spark):
    body = "{bad" + "x" * 2_000
    queue = spark.createDataFrame([("m", body, 5), ("n", body, 4)], ingest.QUEUE)
    again, dead = ingest.split_failures(queue, queue)
    assert [tuple(row) for row in dead.collect()] == [("m", body, 5)]
    assert [tuple(row) for row in again.collect()] == [("n", body, 5)]


def test_failed_embedding_fails_its_message_only(spark):
    root = scratch_path(spark, "ingest")
    objects = spark.createDataFrame(
        [("raw", "good.txt", bytearray(b"fine")), ("raw", "bad.txt", bytearray(b"explode"))], "bucket string, key string, content binary")
    job = ingest.QueueIngest(
        spark, root, ingest.table_store(objects), index=True, embedder=picky(), embed_dim=8, buckets=2)
    batch = spark.createDataFrame([("m1", event("good.txt"), None), ("m2", event("bad.txt"), None)], ingest.QUEUE)
    job.process(batch, 0)
    retry = {r.message_id for r in spark.read.schema(ingest.QUEUE).json(f"{root}/queue/retry-0").collect()}
    assert "m2" in retry and retry <= {"m1", "m2"}
    assert job.vectors.read().filter("content = 'explode'").count() == 0


def test_windows_and_alarms_over_late_data(spark):
    root = scratch_path(spark, "metrics")
    rows = [("read", minute * 60 + second, 1, 5.0) for minute in range(6) for second in range(5)] + [("read", 3600, 0, 1.0)]
    late = [("read", 10, 1, 1.0)]

    def write(data, part):
        frame = spark.createDataFrame(data, "stage string, at long, errors int, latency double")
        frame.select("stage", F.timestamp_seconds(F.lit(1704067200) + F.col("at")).alias("ts"), "errors", "latency").coalesce(1).write.parquet(f"{root}/in/{part}")

    write(rows, "a")
    records = lambda: spark.readStream.schema("stage string, ts timestamp, errors int, latency double").parquet(f"{root}/in/*")
    job = metrics.StreamingAlarms(spark, f"{root}/state")
    checkpoint = scratch_path(spark, "checkpoint")
    job.start(records(), checkpoint, lateness="1 minute").awaitTermination()
    states = [(r.value, r.alarm) for r in job.states.read().filter("alarm_name = 'stage_errors'").orderBy("period").limit(6).collect()]
    assert states == [(5, False), (5, False), (5, True), (5, True), (5, True), (5, True)]
    write(late, "b")
    job.start(records(), checkpoint, lateness="1 minute").awaitTermination()
    assert job.windows.read().orderBy("period").first().errors == 5


def test_a_small_batch_rewrites_no_old_file(spark):
    path = scratch_path(spark, "appended")
    stored = AppendTable(spark, path, "k string, at timestamp, v int", "at", ["k", "at"])
    rows = lambda v, days: spark.createDataFrame([("a", d, v) for d in days], "k string, d int, v int").select(
        "k", F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400).alias("at"), "v")
    stored.append(rows(1, range(5)), 0)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    stored.append(rows(2, [4]), 1)
    assert {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if p in before} == before
    stored.append(rows(2, [4]), 1)
    assert sorted(r.v for r in stored.read().collect()) == [1, 1, 1, 1, 2]
    since = F.timestamp_seconds(F.lit(1704067200 + 3 * 86400))
    assert stored.read(since).count() == 2
    stored.fold("2024-01-06")
    assert sorted(r.v for r in stored.read().collect()) == [1, 1, 1, 1, 2]
    assert all("batch=-1" in str(p) for p in Path(path).rglob("*.parquet"))


def test_redelivered_messages_are_dropped_within_the_horizon(spark):
    root = scratch_path(spark, "again")
    frame = spark.createDataFrame([("m1", 0), ("m1", 5), ("m2", 6)], "message_id string, at long")
    frame.select("message_id", F.timestamp_seconds("at").alias("sent_at")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("message_id string, sent_at timestamp").parquet(f"{root}/in")
    query = ingest.without_redeliveries(stream).writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(f"{root}/out").collect()) == ["m1", "m2"]


def test_refresh_reads_only_new_files(spark):
    data = np.random.default_rng(3).standard_normal((60, 8)).astype(np.float32)
    root = scratch_path(spark, "refresh")

    def write(low, high, part):
        rows = [(n, [float(x) for x in data[n]]) for n in range(low, high)]
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{root}/in/{part}")

    write(0, 40, "a")
    lists = ann.train_inverted_lists(spark.read.parquet(f"{root}/in/a"), dim=8, subvectors=2, code_bits=3)
    job = refresh.IndexRefresh(spark, f"{root}/in/*", f"{root}/index", lists)
    for expected, more in ((40, None), (40, None), (60, (40, 60, "b"))):
        if more:
            write(*more)
        query = job.start(f"{root}/cp")
        query.awaitTermination()
        assert job.index.read().count() == expected


def test_tails_of_windows_are_exact_and_nulls_have_none(spark):
    rng = np.random.default_rng(5)
    values = rng.lognormal(3, 2, 30_000).round(3)
    rows = [("a", int(i % 7), float(v)) for i, v in enumerate(values)] + [("b", 0, None), ("b", 0, float("nan")), (None, 0, 4.0), (None, 0, 2.0)]
    counts = spark.createDataFrame(rows, "stage string, h int, latency double").selectExpr(
        "stage", "timestamp_seconds(h * 3600) AS period", "latency", "1L AS samples", "0L AS errors", "0D AS rows_ingested")
    found = {(r.stage, r.period): r for r in metrics.windows_of(counts).collect()}
    assert len(found) == 9
    for h in range(7):
        own = np.sort(values[h::7])
        row = next(r for (stage, period), r in found.items() if stage == "a" and r.samples == len(own) and r.latency_p99 == own[int(np.ceil(len(own) * 0.99)) - 1])
        assert row.latency_max == own[-1]
    assert [r.latency_p99 for (stage, _), r in found.items() if stage == "b"] == [None]
    assert [r.latency_p99 for (stage, _), r in found.items() if stage is None] == [4.0]
    assert metrics.windows_of(counts.limit(0)).count() == 0


def test_sketches_merge_to_wider_windows_within_their_error(spark):
    rng = np.random.default_rng(9)
    job = sketches.LatencySketches(spark, scratch_path(spark, "sketches"), period="1 minute", size=200)
    batches = [rng.lognormal(3, 2, 20_000) for _ in range(3)]

    def frame(values):
        rows = [("a", int(i), float(v)) for i, v in enumerate(values)] + [("a", 0, None), ("a", 0, float("nan")), ("few", 0, 7.0)]
        return spark.createDataFrame(rows, "stage string, at int, latency double").selectExpr(
            "stage", "timestamp_seconds(1704067200 + at % 3600) AS ts", "latency")

    for at, values in enumerate(batches):
        job.process(frame(values), at)
    job.process(frame(batches[1]), 1)  # a batch that runs again counts once
    everything = np.sort(np.concatenate(batches))
    found = {r.stage: r for r in job.windows("1 hour", {"p50": "50", "p99": "99"}).collect()}
    assert found["a"].samples == 60_000 and found["few"].samples == 3 and found["few"].p99 == 7.0 and found["few"].rank_error == 0
    assert 0.012 < found["a"].rank_error < 0.015
    for name, share in (("p50", 0.5), ("p99", 0.99)):
        rank = np.searchsorted(everything, found["a"][name], side="right") / len(everything)
        assert abs(rank - share) <= 2 * found["a"].rank_error
    assert job.windows("15 minutes", {"p50": "50"}).filter("stage = 'a'").count() == 4
    empty = sketches.LatencySketches(spark, scratch_path(spark, "sketches"))
    empty.process(frame([]).limit(0), 0)
    assert empty.windows("1 hour", {"p50": "50"}).count() == 0


def test_small_windows_of_sketches_are_exact(spark):
    values = np.random.default_rng(3).permutation(900).astype(float)
    job = sketches.LatencySketches(spark, scratch_path(spark, "sketches"), size=1024)
    for at in range(3):
        rows = [("a", int(i), float(v)) for i, v in enumerate(values[at::3])]
        job.process(spark.createDataFrame(rows, "stage string, at int, latency double").selectExpr("stage", "timestamp_seconds(at) AS ts", "latency"), at)
    row = job.windows("1 hour", {"p50": "50", "p99": "99"}).first()
    assert (row.samples, row.p50, row.p99, row.rank_error) == (900, 449.0, 890.0, 0.0)
