"""Vector and substring search, percentiles, alarms, generation."""

from __future__ import annotations

import gc
import math
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import alarms, ann, generate, metrics, search, topk
from corpusmill.session import scratch_path

VECTORS = "chunk_id string, source_id string, embedding array<float>"


def stored(spark, matrix, copies=0):
    rows = [(f"c{at:05d}", f"s{at % 3}", [float(x) for x in row]) for at, row in enumerate(matrix)]
    rows += [(f"z{at:05d}", "s0", rows[0][2]) for at in range(copies)]
    return spark.createDataFrame(rows, VECTORS).repartition(8), rows


def asked(spark, matrix, scopes=None):
    rows = [(f"q{at}", [float(x) for x in row], scopes[at] if scopes else None) for at, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "query_id string, query_embedding array<double>, scope string"), rows


def brute(rows, query, k, scope=None):
    q = np.asarray(query) / np.linalg.norm(query)
    scored = []
    for name, source, vector in rows:
        if scope is None or source == scope:
            v = np.asarray(vector, dtype=np.float32).astype(float)
            scored.append((-round(float(q @ v / np.linalg.norm(v)), 9), name))
    return [name for _, name in sorted(scored)[:k]]


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(5).standard_normal((300, 16)).astype(np.float32)


@pytest.mark.parametrize("size", [4096, 1])
def test_top_k_equals_brute_force_with_a_third_of_copies(spark, matrix, size):
    vectors, rows = stored(spark, matrix, copies=150)
    scopes = [None, "s1", "s0", None]
    queries, listed = asked(spark, [matrix[0], matrix[7], matrix[0], matrix[40]], scopes)
    found = topk.top_k(vectors, queries, 7, scope="source_id", query_scope="scope", round_size=size)
    by_query: dict[str, list] = {}
    for row in found.orderBy("query_id", "rank").collect():
        by_query.setdefault(row.query_id, []).append(row.chunk_id)
    for name, vector, scope in listed:
        assert by_query[name] == brute(rows, vector, 7, scope), name


def test_top_k_edges(spark, matrix):
    vectors, _ = stored(spark, matrix[:5])
    queries, _ = asked(spark, matrix[:1])
    assert topk.top_k(vectors, queries, 0).count() == 0
    assert topk.top_k(vectors, queries.limit(0), 3).count() == 0
    assert topk.top_k(vectors, queries, 50).count() == 5
    assert topk.top_k(vectors, queries, 1).first().score == pytest.approx(1.0)
    with pytest.raises(ValueError, match="metric"):
        topk.top_k(vectors, queries, 1, metric="l1")


@pytest.mark.parametrize("bad", [3, 40])
@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_vectors_with_gaps_take_no_place_among_the_best(spark, matrix, bad, metric):
    _, rows = stored(spark, matrix)
    odd = [[float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]
    mixed = [(f"n{at}", f"s{at % 3}", odd[at % 3]) for at in range(bad)]
    vectors = spark.createDataFrame(mixed + rows, VECTORS).coalesce(1)
    queries, _ = asked(spark, matrix[:3], [None, "s1", None])
    scope = {"scope": "source_id", "query_scope": "scope"}
    clean = topk.top_k(spark.createDataFrame(rows, VECTORS), queries, 7, metric=metric, **scope)
    found = topk.top_k(vectors, queries, 7, metric=metric, **scope)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, clean.collect())) and found.count() == 21


@pytest.mark.parametrize("size", [4096, 1])
def test_queries_of_two_dimensions_are_refused(spark, matrix, size):
    vectors, _ = stored(spark, matrix[:5])
    queries, _ = asked(spark, [matrix[0], matrix[1][:3]])
    with pytest.raises(ValueError, match="different dimensions"):
        topk.top_k(vectors, queries, 1, round_size=size)


def test_no_pair_rows_and_no_shuffle_of_the_vectors(spark, matrix):
    vectors, _ = stored(spark, matrix)
    path = scratch_path(spark, "v")
    vectors.write.parquet(path)
    queries, _ = asked(spark, matrix[:3])
    plan = topk.top_k(spark.read.parquet(path), queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
    assert plan.index("Exchange") < plan.index("MapInArrow")


def test_approximate_indexes_find_most_neighbours(spark, matrix):
    centres = np.random.default_rng(1).standard_normal((12, 16)) * 3
    data = (centres[np.arange(600) % 12] + np.random.default_rng(2).standard_normal((600, 16)) * 0.4).astype(np.float32)
    vectors, _ = stored(spark, data)
    queries, _ = asked(spark, data[:20])
    exact = topk.top_k(vectors, queries, 5).cache()
    codes = ann.HyperplaneCodes(16)
    path = scratch_path(spark, "planes")
    ann.write_cells(ann.hyperplane_index(vectors, codes), path, "chunk_id")
    found = ann.hyperplane_search(spark.read.parquet(path), codes, queries, 5)
    assert ann.recall(found, exact).first().recall >= 0.9
    lists = ann.train_inverted_lists(vectors, dim=16, subvectors=4, code_bits=5)
    assert len(lists.centres) == math.isqrt(600)
    path = scratch_path(spark, "lists")
    ann.write_cells(ann.inverted_index(vectors, lists), path, "chunk_id")
    index = spark.read.parquet(path)
    assert index.count() == 600
    assert ann.recall(ann.inverted_search(index, lists, queries, 5, nprobe=6), exact).first().recall >= 0.9
    assert ann.recall(ann.coded_search(index, lists, queries, 5, nprobe=6), exact).first().recall >= 0.85


def test_substring_and_trigram_search_agree(spark):
    names = ["Tyrannosaurus rex", "Allosaurus", "Brontosaurus", "saur", "RAPTOR", "rap_tor", "100% bone", "", "au"]
    table = spark.createDataFrame(list(enumerate(names)), "id int, species string")
    postings = search.trigram_postings(table, "species")
    for query in ("saur", "RAP", "ap_or", "au", "a%s", "'; DROP TABLE", "100%", "nosaurus", "%"):
        scan = search.substring_search(table, "species", query, 50).collect()
        assert search.indexed_search(table, postings, "species", query, 50).collect() == scan, query
    assert [r.species for r in search.substring_search(table, "species", "SAURUS", 2).collect()] == ["Allosaurus", "Brontosaurus"]
    assert search.query_grams("ab%cdef") == ["cde", "def"]


def nearest_rank(values, percent):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(percent * len(ordered) / 100)) - 1]


def test_latency_summary(spark):
    def summary(values):
        frame = spark.createDataFrame([(float(v),) for v in values], "latency double")
        return metrics.latency_summary(frame).first().asDict()

    whole = summary(range(1, 101))
    assert (whole["count"], whole["p50"], whole["p90"], whole["p95"], whole["p99"], whole["max"], whole["mean"]) == (100, 50, 90, 95, 99, 100, 50.5)
    assert set(summary([]).values()) == {0.0}
    one = summary([12.5])
    assert one.pop("count") == 1 and set(one.values()) == {12.5}


@pytest.mark.parametrize("accuracy", [20, 10000])
def test_percentiles_are_exact_with_a_coarse_sketch_and_a_hot_group(spark, accuracy):
    rng = np.random.default_rng(4)
    values = [("hot", float(v)) for v in rng.exponential(10, 6000)] + [("flat", 7.0)] * 3000 + [(f"g{n % 5}", float(n)) for n in range(100)]
    frame = spark.createDataFrame(values, "g string, v double").repartition(8)
    found = metrics.exact_percentiles(frame, ["g"], "v", {"p1": "1", "p50": "50", "p999": "99.9"}, accuracy=accuracy).collect()
    assert len(found) == 7
    for row in found:
        mine = [v for g, v in values if g == row.g]
        assert row.samples == len(mine)
        assert (row.p1, row.p50, row.p999) == tuple(nearest_rank(mine, p) for p in (1, 50, 99.9))


def series(spark, values):
    rows = [("s", minute, value) for minute, value in enumerate(values) if value is not None]
    frame = spark.createDataFrame(rows, "stage string, minute int, value int")
    return frame.select("stage", F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60).alias("period"), "value")


def test_three_of_five_periods(spark):
    states = alarms.alarm(series(spark, [4, 0, 5, None, 9, 1, 1, 1]), "stage", "60 seconds", ">", 3, datapoints=3, evaluation_periods=5)
    assert [r.alarm for r in states.orderBy("period").collect()] == [False, False, False, False, True, False, False, False]


def test_missing_periods_breach_only_when_told_to(spark):
    quiet = alarms.alarm(series(spark, [1, None, 1]), "stage", "60 seconds", "<", 1)
    loud = alarms.alarm(series(spark, [1, None, 1]), "stage", "60 seconds", "<", 1, missing=alarms.BREACHING)
    assert [r.alarm for r in quiet.orderBy("period").collect()] == [False] * 3
    assert [r.alarm for r in loud.orderBy("period").collect()] == [False, True, False]


def test_generation_keeps_errors_in_their_row(spark):
    def primary(row):
        if row["n"] in (1, 2):
            raise TimeoutError("slow")
        return {"text": f"ok {row['n']}", "cache_hit": row["n"] == 3}

    def fallback(row):
        if row["n"] == 2:
            raise RuntimeError("down")
        return "backup"

    results = generate.generate(spark.range(4).selectExpr("CAST(id AS int) AS n"), primary, fallback).cache()
    assert {(r.n, r.suggestion, r.used_fallback, r.error) for r in results.collect()} == {
        (0, "ok 0", False, None), (1, "backup", True, None), (2, None, True, "down"), (3, "ok 3", False, None)}
    assert tuple(generate.generation_summary(results).first()) == (4, 1, 2, 1)


@pytest.mark.parametrize("groups, bins", [(1_000, 1_024), (0, 3)])
def test_percentiles_by_every_way(spark, monkeypatch, groups, bins):
    """Broadcast or salted sketches, many or few ranges: nearest rank, NaN and null left out."""
    monkeypatch.setattr(metrics, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(metrics, "BINS", bins)
    rng = np.random.default_rng(9)
    values = {"hot": np.round(rng.gamma(2, 50, 4000), 1), "one": np.array([7.0]), "same": np.full(50, 3.0), "wide": np.array([-1e300, 0.0, 1e300])}
    rows = [(name, float(v)) for name, held in values.items() for v in held] + [("hot", float("nan")), ("hot", None), ("void", None)]
    frame = spark.createDataFrame(rows, "stage string, v double")
    found = {r.stage: r for r in metrics.exact_percentiles(frame, ["stage"], "v", {"p50": "50", "p999": "99.9"}, accuracy=100).collect()}
    for name, held in values.items():
        ordered = np.sort(held)
        for share, column in ((0.5, "p50"), (0.999, "p999")):
            assert found[name][column] == ordered[max(1, math.ceil(round(share * len(held), 6))) - 1], (name, column)
    total = metrics.latency_summary(frame.withColumnRenamed("v", "latency")).first()
    everything = np.sort(np.concatenate(list(values.values())))
    assert total["count"] == len(everything) and total.p50 == everything[math.ceil(len(everything) / 2) - 1]


def test_percentiles_do_not_shuffle_rows_by_group(spark):
    frame = spark.range(5_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS stage", "id * 1.0 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        found = metrics.exact_percentiles(frame, ["stage"], "v", {"p50": "50"})
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index("Range (")]
    assert "BroadcastHashJoin" in scan and "SinglePartition" not in plan


def test_a_rare_query_filters_the_scan_by_id(spark):
    path, base = scratch_path(spark, "grams"), scratch_path(spark, "ranged")
    table = spark.range(2_000).selectExpr("id", "CASE WHEN id = 77 THEN 'needle' ELSE 'hay' || id END AS species")
    search.write_postings(search.trigram_postings(table, "species"), path)
    search.write_ranged(table, base)
    found = search.candidate_rows(spark.read.parquet(base), spark.read.parquet(path), "species", "NEEDLE")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "= 77)" in plan and "Join" not in plan
    assert [r.id for r in found.collect()] == [77]
    common = search.candidate_rows(spark.read.parquet(base), spark.read.parquet(path), "species", "hay1")
    assert common.count() == table.filter("species LIKE 'hay1%'").count()


def test_one_round_of_queries_is_held_at_a_time(spark, monkeypatch):
    alive, scan = [], topk.scan_top_k

    def watched(vectors, matrix, *arguments, **options):
        gc.collect()
        assert not [ref for ref in alive if ref() is not None]
        alive.append(weakref.ref(matrix))
        return scan(vectors, matrix, *arguments, **options)

    monkeypatch.setattr(topk, "scan_top_k", watched)
    data = np.random.default_rng(8).standard_normal((50, 4))
    vectors = spark.createDataFrame([(f"c{n}", [float(x) for x in v]) for n, v in enumerate(data)], "chunk_id string, embedding array<double>")
    queries = vectors.selectExpr("chunk_id AS query_id", "embedding AS query_embedding")
    found = topk.top_k(vectors, queries, 1, round_size=10).collect()
    assert len(alive) >= 4 and sorted(r.query_id for r in found) == sorted(r.chunk_id for r in found) and len(found) == 50
