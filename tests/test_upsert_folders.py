"""Rows that an upsert does not replace stay in their files."""

from pathlib import Path

from corpusmill.operators.upsert import KeyedTable
from corpusmill.session import scratch_path


def _files(path):
    return {str(file): file.stat().st_mtime_ns for file in Path(path).rglob("*.parquet")}


def test_layers_beside_each_other_are_not_written_again(spark):
    path = scratch_path(spark, "layers")
    table = KeyedTable(spark, path, "k int, layer int, v string", ["k", "layer"], buckets=2)

    def batch(layer, value, low=0):
        return spark.createDataFrame([(k, layer, value) for k in range(low, 20)], "k int, layer int, v string")

    table.upsert(batch(1, "one"))
    first = _files(path)
    table.upsert(batch(2, "two"))
    second = _files(path)
    assert first.items() <= second.items() and not [name for name in second if "_kept-" in name]
    table.upsert(batch(1, "new"))
    assert not [name for name in _files(path) if "_kept-" in name]
    assert sorted(tuple(r) for r in table.read().collect()) == sorted([(k, 1, "new") for k in range(20)] + [(k, 2, "two") for k in range(20)])
    # A folder that loses some of its rows is written again, and old folders go with their generations.
    table.upsert(batch(2, "half", low=10))
    want = sorted([(k, 1, "new") for k in range(20)] + [(k, 2, "half" if k >= 10 else "two") for k in range(20)])
    table.vacuum()
    assert sorted(tuple(r) for r in table.read().collect()) == want


def test_folders_of_a_bucket_are_merged_in_time(spark):
    table = KeyedTable(spark, scratch_path(spark, "many"), "k int, v int", ["k"], buckets=1)
    table.FOLDERS = 2
    for k in range(6):
        table.upsert(spark.createDataFrame([(k, k)], "k int, v int"))
        assert len(table.log.read().parts["kept"]["0"]) <= 2
    table.vacuum()
    assert sorted(r.k for r in table.read().collect()) == list(range(6))
