"""Steps of the queue ingest, raw files: what is written and how it is found."""

from pathlib import Path

from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.plans import QUERIES
from corpusmill.sources import scans, sinks
from corpusmill.streaming import ingest


def test_steps_are_written_compressed(spark, monkeypatch):
    paths, scratch = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    kept = session.checkpointed(spark.range(10).selectExpr("id", "repeat('text ', 1000) AS content"))
    assert kept.count() == 10 and list(Path(paths[0].removeprefix("file:")).glob("*.zstd.parquet"))


def test_objects_are_not_sorted(spark):
    objects = spark.createDataFrame([("b", "k", b"x")], "bucket string, key string, content binary")
    tasks = spark.createDataFrame([("b", "k"), ("b", "none")], "bucket string, key string")
    found = ingest.table_store(objects)(tasks)
    assert "ShuffledHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.key, r.fetch_error) for r in found.collect()) == [("k", None), ("none", "no such object")]


def test_raw_files_are_written_by_their_tasks_and_read_in_few(spark, tmp_path):
    rows = [(f"n{n}.txt", f"text {n}") for n in range(400)] + [("a:b=c%.txt", "é"), ("none.txt", None), ("twice.txt", "x"), ("twice.txt", "x"), (None, "unnamed")]
    frame, path = spark.createDataFrame(rows, "filename string, value string"), f"{tmp_path}/raw"
    sinks.write_raw_files(frame.repartition(3, "filename"), path)
    frame.coalesce(1).write.partitionBy("filename").text(f"{tmp_path}/spark")
    kept = {at.name: at.read_bytes() for at in Path(path).rglob("*.txt")}
    assert kept == {f"{at.parent.name}.txt": at.read_bytes() for at in Path(f"{tmp_path}/spark").rglob("part-*.txt")} and len(kept) == 404
    # Neither hidden files nor checksums, and no folder for each file.
    assert not list(Path(path).rglob(".*")) and sum(at.is_dir() for at in Path(path).rglob("*")) == 2 * 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a split per file
    try:
        raw = scans.read_raw_files(spark, path, "*.txt")
        assert raw.rdd.getNumPartitions() <= scans.READING * spark.sparkContext.defaultParallelism < 404
        named = sinks.raw_name(F.col("path")).alias("name")
        assert {f"filename={r.name}.txt": bytes(r.content) for r in raw.select(named, "content").collect()} == kept
        by_spark = scans.read_raw_files(spark, f"{tmp_path}/spark", "*.txt").select(named)
        assert {f"filename={r.name}.txt" for r in by_spark.collect()} == {*kept}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get(scans._LISTING_KEY, None) is None
    sinks.write_raw_files(frame.limit(0), f"{tmp_path}/empty")
    assert scans.read_raw_files(spark, f"{tmp_path}/empty").count() == 0


def test_raw_documents_are_scanned_from_a_file_each(spark, tmp_path):
    rows = [(n, f"body {n}\nmore", "en", "web") for n in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["SRC4_raw_document_scan"](spark, str(tmp_path)).collect()
    assert sorted((r.filename, r.char_count, r.bytes) for r in found) == sorted((f"doc-{n}.txt", len(f"body {n}\nmore") + 1, str(len(f"body {n}\nmore") + 4)) for n in range(20))
