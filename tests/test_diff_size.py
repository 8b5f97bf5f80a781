"""What a diff writes and moves."""

import pytest

from corpusmill.operators import diff
from corpusmill.session import scratch_path
from corpusmill.sources import sinks

ROWS = [("s", n, f"line {n}", v) for v in (1, 2) for n in range(12) if not (v == 2 and n == 5)] + [("t", 0, "only old", 1)]


def test_counts_write_no_contents(spark, monkeypatch):
    written, plain = [], diff.checkpointed
    monkeypatch.setattr(diff, "checkpointed", lambda df: written.append(df.columns) or plain(df))
    chunks = spark.createDataFrame([(s, n if v == 1 or n < 5 else n - 1, c, v) for s, n, c, v in ROWS], "source_id string, ordinal int, content string, layer_version int")
    row = diff.layer_diff_counts(chunks, 1, 2).collect()
    assert [(r.source_id, r.added_lines, r.removed_lines) for r in row] == [("s", 0, 1)]
    assert written and not [columns for columns in written if "content" in columns]
    written.clear()
    rows = diff.diff_lines(chunks, 1, 2)
    new = diff.apply_diff(chunks.filter("layer_version = 1 AND source_id = 's'"), rows).orderBy("ordinal").collect()
    assert [r.content for r in new] == [f"line {n}" for n in range(12) if n != 5]
    # Contents are written once for each side's lines, not in every step.
    assert len([columns for columns in written if "content" in columns]) == 2


def test_gold_is_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    schema = "layer_version int, metadata map<string,string>"
    chunks = spark.createDataFrame([(1, {"a": "b"}), (2, None)], schema).repartition(1).mapInArrow(counted, schema)
    path = scratch_path(spark, "gold")
    sinks.write_gold(chunks, path)
    assert runs.value == 2 and spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="no chunks"):
        sinks.write_gold(chunks.limit(0), path)
    assert spark.read.parquet(path).count() == 2
