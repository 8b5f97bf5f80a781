"""Keyed tables, ledger, cache, contracts, sinks."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import cache, contract, embed, ledger, snapshots, upsert
from corpusmill.session import list_names, scratch_path, spread
from corpusmill.sources import scans, sinks

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")
TEXTS = "doc_id string, chunk_id string, text string"


def stored(spark, buckets=4):
    return upsert.KeyedTable(spark, scratch_path(spark, "t"), TEXTS, ["doc_id", "chunk_id"], buckets=buckets)


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_upsert_twice_updates_adds_and_ignores_empty(spark):
    table = stored(spark)
    first = spark.createDataFrame([("d1", "c1", "hello"), ("d1", "c2", "world")], TEXTS)
    table.upsert(first)
    table.upsert(first)
    assert len(rows(table.read())) == 2
    table.upsert(spark.createDataFrame([("d1", "c1", "new text"), ("d2", "c9", "more")], TEXTS))
    expected = [("d1", "c1", "new text"), ("d1", "c2", "world"), ("d2", "c9", "more")]
    assert rows(table.read()) == expected
    table.upsert(first.limit(0))
    assert rows(table.read()) == expected


def test_duplicates_in_a_batch_keep_the_greatest_in_order(spark):
    table = stored(spark)
    table.upsert(spark.createDataFrame([("d1", "c1", "v1"), ("d1", "c1", "v2")], TEXTS), ["text"])
    assert rows(table.read()) == [("d1", "c1", "v2")]


def test_missing_key_column_is_named(spark):
    with pytest.raises(ValueError, match="chunk_id"):
        stored(spark).upsert(spark.createDataFrame([("d1", "x")], "doc_id string, text string"))


def test_upsert_reads_and_writes_the_same_table_at_size(spark):
    table = upsert.KeyedTable(spark, scratch_path(spark, "big"), "k bigint, v string", ["k"], buckets=8)
    table.upsert(spark.range(150000).selectExpr("id AS k", "'old' AS v"))
    table.upsert(spark.range(0, 300000, 3).selectExpr("id AS k", "'new' AS v"))
    counts = {row.v: row["count"] for row in table.read().groupBy("v").count().collect()}
    assert counts == {"old": 100000, "new": 100000}
    assert table.read().select("k").distinct().count() == 200000


def test_only_touched_buckets_are_rewritten(spark):
    table = upsert.KeyedTable(spark, scratch_path(spark, "touch"), "k bigint, v string", ["k"], buckets=8)
    table.upsert(spark.range(1000).selectExpr("id AS k", "'old' AS v"))
    before = set(table.read().inputFiles())
    table.upsert(spark.range(1).selectExpr("id AS k", "'new' AS v"))
    after = set(table.read().inputFiles())
    gone = {path.split(f"{upsert.BUCKET}=")[1].split("/")[0] for path in before - after}
    assert len(gone) == 1


def pairs(spark, low, high, value):
    return spark.range(low, high).selectExpr("id AS k", f"'{value}' AS v")


def test_generations_stay_readable_until_they_are_vacuumed(spark):
    table = upsert.KeyedTable(spark, scratch_path(spark, "gens"), "k bigint, v string", ["k"], buckets=4)
    assert not table.exists() and table.read().count() == 0 and table.generations() == []
    table.upsert(pairs(spark, 0, 20, "a"))
    table.upsert(pairs(spark, 0, 10, "b"))
    table.upsert(pairs(spark, 0, 0, "c"))
    assert table.generations() == [0, 1]
    assert {r.v for r in table.read(0).collect()} == {"a"} and table.read(1).filter("v = 'b'").count() == 10
    with pytest.raises(ValueError, match="no generation 7"):
        table.read(7)
    table.vacuum(1)
    assert table.generations() == [1] and sorted(r.v for r in table.read().collect()) == ["a"] * 10 + ["b"] * 10


def test_a_failed_writer_leaves_the_table_as_it_was(spark, monkeypatch):
    table = upsert.KeyedTable(spark, scratch_path(spark, "fail"), "k bigint, v string", ["k"], buckets=4)
    table.upsert(pairs(spark, 0, 20, "a"))
    folders = set(list_names(spark, f"{table.path}/data"))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots.SnapshotLog, "commit", die)
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(pairs(spark, 0, 20, "b"))
    assert {r.v for r in table.read().collect()} == {"a"} and table.generations() == [0]
    assert len(set(list_names(spark, f"{table.path}/data"))) == 2
    table.vacuum(5)
    assert set(list_names(spark, f"{table.path}/data")) == folders


@pytest.mark.parametrize("theirs, merges", [((3, 4), 1), ((0, 20), 2)])
def test_a_writer_that_comes_second_keeps_both(spark, monkeypatch, theirs, merges):
    path = scratch_path(spark, "race")
    open_ = lambda: upsert.KeyedTable(spark, path, "k bigint, v string", ["k"], buckets=64)
    mine, other = open_(), open_()
    mine.upsert(pairs(spark, 0, 20, "a"))
    commit, seen = mine._commit_folder, []

    def late(*arguments):
        if not seen:
            other.upsert(pairs(spark, *theirs, "theirs"))
        seen.append(1)
        return commit(*arguments)

    monkeypatch.setattr(mine, "_commit_folder", late)
    mine.upsert(pairs(spark, 7, 8, "mine"))
    found = {r.k: r.v for r in mine.read().collect()}
    assert found == {k: "mine" if k == 7 else "theirs" if theirs[0] <= k < theirs[1] else "a" for k in range(20)}
    assert len(seen) == merges and mine.generations() == [0, 1, 2]


def test_one_of_many_concurrent_claimers_wins_each_key(spark):
    path, now = scratch_path(spark, "claimers"), F.lit("2024-02-01").cast("timestamp")
    work = spark.range(30).selectExpr("concat('k', id) AS key")

    def claim(_):
        outcomes = ledger.Ledger(spark, path, buckets=4).claim(work, now)
        return [row.key for row in outcomes.filter("outcome = 'claimed'").collect()]

    with ThreadPoolExecutor(4) as pool:
        won = [key for keys in pool.map(claim, range(4)) for key in keys]
    assert sorted(won) == sorted(f"k{n}" for n in range(30))


def test_a_file_is_created_once(spark):
    path = scratch_path(spark, "once")
    assert snapshots.create_file(spark, f"{path}/a", "first") and not snapshots.create_file(spark, f"{path}/a", "second")
    assert snapshots.read_file(spark, f"{path}/a") == "first" and [n for n in list_names(spark, path) if not n.endswith(".crc")] == ["a"]


def test_latest_per_key_on_a_hot_key_is_combined_before_the_shuffle(spark):
    frame = spark.range(100000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id AS string)) AS k", "id AS v")
    found = upsert.latest_per_key(frame, ["k"], ["v"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    assert found.filter("k = 'hot'").first().v == 99999


def test_claims_commits_and_releases(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=2)
    work = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert {(r.key, r.requests, r.outcome) for r in book.claim(work, now()).collect()} == {("a", 2, "claimed"), ("b", 1, "claimed")}
    again = {r.key: r.outcome for r in book.claim(work, now()).collect()}
    assert again == {"a": "locked", "b": "locked"}
    book.commit(spark.createDataFrame([("a", "vector:a")], "key string, ref string"), now())
    book.release(spark.createDataFrame([("a",), ("b",)], "key string"))
    assert {(r.key, r.status) for r in book.read().collect()} == {("a", "PROCESSED")}
    later = F.lit("2024-02-01 02:00:00").cast("timestamp")
    assert {r.key: r.outcome for r in book.claim(work, later).collect()} == {"a": "processed", "b": "claimed"}
    assert tuple(book.stats().first()) == (1, 1)


def test_an_expired_claim_is_free(spark):
    entries = spark.createDataFrame([("a", "PENDING", None, "2024-01-31 22:59:59", None)],
                                    "key string, status string, ref string, claimed_at string, processed_at string")
    book = entries.withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    work = spark.createDataFrame([("a",)], "key string")
    assert ledger.claim_outcomes(work, book, now()).first().outcome == "claimed"
    assert ledger.claim_outcomes(work, book, now(), ttl=7200).first().outcome == "locked"


CHUNK = "chunk_id string, doc_id string, source_id string, ordinal int, content string, layer_version int, geological_age string"


def chunk_rows(spark, names):
    rows_ = [(name, "d", "s", at, f"text {name}", 1, "Holocene") for at, name in enumerate(names)]
    return spark.createDataFrame(rows_, CHUNK).withColumns({"ingested_at": now(), "metadata": F.create_map(F.lit("a"), F.lit("b"))})


def test_embedding_is_idempotent_and_heals(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=2)
    vectors = sinks.vector_table(spark, scratch_path(spark, "vectors"), buckets=2)

    class Broken:
        def encode(self, texts):
            raise ConnectionError("no model")

    def run(names, factory=lambda: embed.HashEmbedder(8)):
        return tuple(embed.embed_chunks(
            chunk_rows(spark, names), ledger=book, vectors=vectors, now=now(), factory=factory, embed_dim=8).first())

    assert run("abc", Broken) == (3, 0, 0, 0, 3)
    assert run("abca") == (4, 3, 0, 1, 0)
    assert run("abcd") == (4, 1, 3, 0, 0)
    found = vectors.read().orderBy("chunk_id").collect()
    assert [row.chunk_id for row in found] == list("abcd") and found[0].metadata == {"a": "b"}
    assert embed.embed_chunks(chunk_rows(spark, "abcd"), ledger=None, vectors=vectors, now=now(),
                              factory=lambda: embed.HashEmbedder(8), embed_dim=8).first().embedded == 4
    assert vectors.read().count() == 4


def test_equal_texts_get_equal_unit_vectors():
    import numpy as np

    one, two, other = embed.HashEmbedder(16).encode(["x", "x", "y"])
    assert np.array_equal(one, two) and not np.array_equal(one, other)
    assert abs(np.linalg.norm(one) - 1) < 1e-6


def test_same_content_in_two_layers_and_two_models(spark):
    vectors = sinks.vector_table(spark, scratch_path(spark, "vectors"), buckets=2)
    base = chunk_rows(spark, "ab").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    for model in ("m", "n"):
        both = base.unionByName(base.withColumn("layer_version", F.lit(2)))
        assert sinks.upsert_vectors(vectors, both, model, 2).count() == 0
    assert sinks.upsert_vectors(vectors, base, "m", 3).count() == 2
    assert vectors.read().count() == 8


def test_cache_answers_each_miss_once(spark):
    asked = spark.createDataFrame([(1, "k1", "q"), (2, "k2", "q"), (3, "k2", "q")], "n int, key string, query string")
    kept = spark.createDataFrame([("k1", "old")], "key string, value string")
    answered, fresh = cache.answer(asked, kept, lambda missing: missing.withColumn("value", F.lit("new")))
    assert {(r.n, r.value, r.cached) for r in answered.collect()} == {(1, "old", True), (2, "new", False), (3, "new", False)}
    assert fresh.count() == 1


def test_eviction_by_age_and_use(spark):
    entries = spark.createDataFrame(
        [("a", "1", "2024-01-30", "2024-01-30"), ("b", "2", "2024-01-31", "2024-01-31"), ("c", "3", "2024-01-01", "2024-02-01")],
        "key string, value string, put_at string, last_used string",
    ).withColumns({name: F.col(name).cast("timestamp") for name in ("put_at", "last_used")})
    assert [r.key for r in cache.evict(entries, now(), capacity=1).collect()] == ["b"]
    assert {r.key for r in cache.evict(entries, now()).collect()} == {"a", "b"}


def test_contract_fill_and_drift(spark):
    old = spark.createDataFrame([("1", None, 66.0, "x")], "specimen_id string, species string, age_ma double, location string")
    row = contract.fill(old).first()
    assert (row.species, row.discoverer, row.age_ma) == ("unknown", "unknown", 66.0)
    assert contract.compatible("double", "bigint") and not contract.compatible("int", "bigint")
    kinds = {(r.kind, r.column) for r in contract.drift_report(old.withColumn("extra", F.lit(1))).collect()}
    assert ("new_field", "extra") in kinds and ("missing_field", "discoverer") in kinds
    with pytest.raises(ValueError, match="age_ma"):
        contract.validate(old.withColumn("age_ma", F.lit("text")))


def test_reading_groups_whose_types_differ(spark):
    root = scratch_path(spark, "groups")
    fields = (contract.Field("id", "int"), contract.Field("name", "string", "unknown"))
    spark.range(2).selectExpr("CAST(id AS int) AS id").write.parquet(f"{root}/a")
    spark.range(2).selectExpr("id + 10 AS id", "'n' AS name").write.parquet(f"{root}/b")
    table = contract.fill(contract.read_evolving(spark, [[f"{root}/a"], [f"{root}/b"]], fields), fields)
    assert sorted(map(tuple, table.select("id", "name").collect())) == [(0, "unknown"), (1, "unknown"), (10, "n"), (11, "n")]


def test_csv_nulls_and_normalising(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Species,Age_MYA\nTrex,66.0\n Raptor ,70.0\n,80.0\nNone,1\nnull,2\nStego,NA\n\"  \",5\n")
    raw = scans.read_csv(spark, str(tmp_path))
    assert rows(contract.normalise_records(raw)) == [("raptor", 70.0), ("trex", 66.0)]
    assert tuple(contract.normalise_counts(raw).first()) == (2, 5)
    with pytest.raises(ValueError, match="age_mya"):
        contract.normalise_records(raw.drop("Age_MYA"))


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Species,Age_MYA\n"He said ""hi""",1\n"two\nlines, one cell",2\nplain,3\n')
    assert rows(scans.read_csv(spark, str(tmp_path))) == [('He said "hi"', 1.0), ("plain", 3.0), ("two\nlines, one cell", 2.0)]


def test_a_table_refuses_another_number_of_buckets(spark):
    table = stored(spark, buckets=4)
    table.upsert(spark.createDataFrame([("d", "c", "t")], TEXTS))
    with pytest.raises(ValueError, match="buckets"):
        upsert.KeyedTable(spark, table.path, TEXTS, ["doc_id", "chunk_id"], buckets=8).read()
    assert upsert.KeyedTable(spark, table.path, TEXTS, ["doc_id", "chunk_id"], buckets=4).read().count() == 1


def test_served_answers_are_stored_and_hits_count_as_used(spark):
    store = cache.cache_table(spark, scratch_path(spark, "cache"), buckets=2)
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = spark.createDataFrame([("a", "A"), ("z", "Z")], "key string, value string")
    store.upsert(known.withColumns({"put_at": old, "last_used": old}))
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, n int")
    fresh = lambda missing: missing.withColumn("value", F.upper("key"))
    assert rows(cache.serve(store, asked, fresh, now()).select("key", "n", "value", "cached")) == [
        ("a", 1, "A", True), ("b", 2, "B", False), ("b", 3, "B", False)]
    shown = store.read().select("key", (F.col("last_used") == now()).alias("used"), (F.col("put_at") == now()).alias("put"))
    assert rows(shown) == [("a", True, False), ("b", True, True), ("z", False, False)]
    assert all(r.cached for r in cache.serve(store, asked, fresh, now()).collect())


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from corpusmill.session import shared_folder

    unset = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_missing_parquet_is_no_error(spark):
    assert scans.read_parquet_if_present(spark, scratch_path(spark, "nothing")) is None


def test_gold_rewrites_one_layer_only(spark):
    path = scratch_path(spark, "gold")
    base = chunk_rows(spark, "ab").withColumn("char_count", F.length("content"))
    sinks.write_gold(base.unionByName(base.withColumn("layer_version", F.lit(2))), path, "jsonl")
    sinks.write_gold(base.limit(1).withColumn("layer_version", F.lit(2)), path, "jsonl")
    counts = {r.layer_version: r["count"] for r in spark.read.json(path).groupBy("layer_version").count().collect()}
    assert counts == {1: 2, 2: 1}
    with pytest.raises(ValueError, match="format"):
        sinks.write_gold(base, path, "xml")
    with pytest.raises(ValueError, match="no chunks"):
        sinks.write_gold(base.limit(0), path)


def test_metric_lines_round_trip(spark):
    frame = spark.createDataFrame([("read", 'r "1"', 12.5, 1)], "Stage string, request_id string, Latency double, Errors int").withColumn("ts", now())
    lines = sinks.metric_lines(frame, namespace="N", metrics={"Latency": "Milliseconds", "Errors": "Count"}, dimensions=["Stage"], properties=["request_id"])
    record = json.loads(lines.first().value)
    assert record["_aws"] == {"Timestamp": 1706745600000, "CloudWatchMetrics": [{
        "Namespace": "N", "Dimensions": [["Stage"]],
        "Metrics": [{"Name": "Latency", "Unit": "Milliseconds"}, {"Name": "Errors", "Unit": "Count"}]}]}
    assert (record["Stage"], record["request_id"], record["Latency"], record["Errors"]) == ("read", 'r "1"', 12.5, 1)
    back = scans.parse_metric_lines(lines).first()
    assert (back.stage, back.latency, back.errors) == ("read", 12.5, 1)


def test_an_upsert_that_replaces_all_rows_leaves_none_to_be_moved(spark):
    table = upsert.KeyedTable(spark, scratch_path(spark, "replaced"), "k bigint, v string", ["k"], buckets=4)
    for value in ("a", "b"):
        table.upsert(pairs(spark, 0, 200, value))
        assert not any(table.log.read().parts["kept"].values())
    table.upsert(pairs(spark, 0, 1, "c"))
    assert len([place for place in table.log.read().parts["kept"].values() if place]) == 1
    assert sorted(r.v for r in table.read().collect()) == ["b"] * 199 + ["c"]


def test_repeated_and_null_keys_of_a_batch_are_told_from_single_ones(spark):
    table = stored(spark)
    table.upsert(spark.createDataFrame([("d1", None, "v1"), ("d1", None, "v2"), ("d2", "c", "v3"), ("d2", "c", "v4"), (None, None, "v5")], TEXTS), ["text"])
    assert sorted(r.text for r in table.read().collect()) == ["v2", "v4", "v5"]


def test_work_is_spread_by_rows_where_asked(spark):
    assert spread(spark.range(1000).coalesce(1), 10).rdd.getNumPartitions() == 100
    assert spread(spark.range(1000).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    long = spark.range(64, numPartitions=1).selectExpr("id", "repeat('x', 1000000) AS t")
    sizes = long.mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]] for f in frames), "n long").agg(F.max("n")).first()[0]
    assert sizes <= 16
