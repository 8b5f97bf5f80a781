"""Equal query vectors travel once."""

import numpy as np

from corpusmill.operators import topk


def test_equal_query_vectors_are_scored_once(spark, monkeypatch):
    asked, scan = [], topk.scan_top_k
    monkeypatch.setattr(topk, "scan_top_k", lambda vectors, matrix, *a, **o: asked.append(len(matrix)) or scan(vectors, matrix, *a, **o))
    data = np.random.default_rng(5).standard_normal((30, 8))
    vectors = spark.createDataFrame([(f"c{n:02}", [float(x) for x in v]) for n, v in enumerate(data)], "chunk_id string, embedding array<double>")
    queries = vectors.selectExpr("explode(sequence(0, 8)) AS n", "*").selectExpr("concat(chunk_id, '-', n) AS query_id", "embedding AS query_embedding")
    found = topk.top_k(vectors, queries, 3, round_size=10).collect()
    assert sum(asked) == 30 and len(found) == 30 * 9 * 3
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    for row in found:
        query = int(row.query_id[1:3])
        best = sorted(range(30), key=lambda n: (-scores[query, n], n))[row["rank"] - 1]
        assert row.chunk_id == f"c{best:02}" and abs(row.score - scores[query, best]) < 2e-9


def test_query_scopes_null_and_repeated_ids_keep_their_rows(spark):
    vectors = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.9, 0.1]), ("c", "y", [0.0, 1.0])], "chunk_id string, s string, embedding array<double>")
    queries = spark.createDataFrame(
        [("q", "x", [1.0, 0.0]), ("q", "y", [1.0, 0.0]), (None, None, [1.0, 0.0]), ("q", "y", [1.0, 0.0])], "query_id string, qs string, query_embedding array<double>")
    found = topk.top_k(vectors, queries, 1, scope="s", query_scope="qs").collect()
    assert sorted((r.query_id or "", r.chunk_id) for r in found) == [("", "a"), ("q", "a"), ("q", "b"), ("q", "b")]
