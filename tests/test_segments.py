"""The cell index: refreshes, merges, repeated ids, splits, and the files a search reads."""

from __future__ import annotations

import numpy as np
import pytest

from corpusmill.operators import ann, segments, topk
from corpusmill.session import scratch_path

DIM = 8


def rows(spark, data, ids):
    return spark.createDataFrame([(int(n), [float(x) for x in data[k]]) for k, n in enumerate(ids)], "id bigint, embedding array<float>").repartition(3)


def index_of(spark, data, **options):
    index = segments.CellIndex(spark, scratch_path(spark, "cells"), **options)
    index.create(ann.train_inverted_lists(rows(spark, data, range(len(data))), dim=DIM, cells=4, subvectors=2, code_bits=2))
    return index


def test_refreshes_are_merged_by_level_and_searched_by_cell(spark):
    data = np.random.default_rng(1).standard_normal((120, DIM)).astype(np.float32)
    index = index_of(spark, data, fanout=2)
    for part in range(3):
        ids = range(part * 40, part * 40 + 40)
        index.add(rows(spark, data[list(ids)], ids), part)
    parts = index._parts()
    assert sorted(segment["level"] for segment in parts["segments"]) == [0, 1] and parts["seq"] == 3
    assert sorted(r.id for r in index.read().collect()) == list(range(120))
    index.add(rows(spark, data[:40], range(40)), 2)  # the batch is in already
    assert index._parts() == parts
    queries = rows(spark, data[::10], range(0, 120, 10)).selectExpr("id AS query_id", "embedding AS query_embedding")
    found = index.search(queries, 3, nprobe=4, round_size=5).collect()
    exact = topk.top_k(index.read(), queries, 3, vector_id="id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, exact))
    lists = index.lists(parts)
    reached, members = index.probed(parts, lists, topk.query_matrix([data[0]], "cosine"), 1)
    files = reached.inputFiles()
    assert files and {int(path.split("/at=")[1].split("/")[0]) for path in files} == set(members) and len(members) == 1
    assert len(files) < len(index.read().inputFiles())
    assert all(r.id == r.query_id for r in index.search(queries, 1, nprobe=1).collect())


def test_the_latest_row_of_an_id_counts(spark):
    data = np.random.default_rng(2).standard_normal((30, DIM)).astype(np.float32)
    index = index_of(spark, data, fanout=3)
    index.add(rows(spark, data, range(30)))
    index.add(rows(spark, -data[:10], range(10)))
    held = {r.id: r.embedding for r in index.read().collect()}
    assert len(held) == 30 and index.read().count() == 30 and len(index._parts()["gone"]) == 1
    assert np.allclose(held[3], -data[3]) and np.allclose(held[20], data[20])
    index.add(rows(spark, 2 * data[:5], range(5)))  # the third segment: all are merged and cleaned
    held = {r.id: r.embedding for r in index.read().collect()}
    assert index._parts()["gone"] == [] and len(index._parts()["segments"]) == 1 and index.read().count() == 30
    assert np.allclose(held[3], 2 * data[3]) and np.allclose(held[7], -data[7])
    index.add(rows(spark, data, range(30)).limit(0))
    assert index.read().count() == 30


def test_large_cells_are_split_and_nothing_is_lost(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((200, DIM)).astype(np.float32)
    index = index_of(spark, data[:20], cell_rows=30)
    index.add(rows(spark, data, range(200)))
    parts = index._parts()
    sizes = {}
    for segment in parts["segments"]:
        for cell, n in segment["cells"].items():
            sizes[int(cell)] = sizes.get(int(cell), 0) + n
    assert len(index.lists(parts).centres) > 4 and sum(sizes.values()) == 200 and max(sizes.values()) < 100
    assert sorted(r.id for r in index.read().collect()) == list(range(200))
    queries = rows(spark, data[::20], range(0, 200, 20)).selectExpr("id AS query_id", "embedding AS query_embedding")
    assert all(r.id == r.query_id for r in index.search(queries, 1, nprobe=3).collect())


def test_equal_vectors_stay_in_one_cell(spark):
    data = np.ones((60, DIM), dtype=np.float32)
    index = index_of(spark, np.random.default_rng(4).standard_normal((20, DIM)).astype(np.float32), cell_rows=10)
    index.add(rows(spark, data, range(60)))
    assert index.read().count() == 60 and len(index.lists(index._parts()).centres) == 4
    with pytest.raises(ValueError, match="exists"):
        index.create(index.lists(index._parts()))
