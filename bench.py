"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from corpusmill.functions import markers  # noqa: E402
from corpusmill.operators import chunking, embed, ledger, metrics, search, topk, upsert  # noqa: E402
from corpusmill.plans import inputs  # noqa: E402
from corpusmill.session import build_session, clear_scratch, scratch_path  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "bench", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    now = F.lit("2024-02-01").cast("timestamp")

    vectors = table("embeddings").select("vec_id", "embedding")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    # At least 4,096 queries: every vector several times.
    times = -(-4_096 // vectors.count())
    many = vectors.select(F.explode(F.sequence(F.lit(1), F.lit(times))).alias("n"), "vec_id", "embedding")
    many = many.select(F.concat_ws("-", "vec_id", "n").alias("query_id"), F.col("embedding").alias("query_embedding")).limit(4_096)
    lines = table("lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS k", "l_partkey AS p", "l_extendedprice AS v")
    stored = upsert.KeyedTable(spark, scratch_path(spark, "bench"), "k bigint, p bigint, v double", ["k"], buckets=16)
    stored.upsert(lines)
    chunks = chunking.chunk_documents(inputs.documents(spark, FOLDER), layer_version=1)
    chunk_path = scratch_path(spark, "chunks")
    chunks.write.parquet(chunk_path)
    chunks = spark.read.parquet(chunk_path)
    key = F.concat_ws(":", F.lit(embed.MODEL_ID), F.lit("64"), "chunk_id")
    done = ledger.commit_rows(chunks.select(key.alias("key"), F.lit("x").alias("ref")), now)
    ledger_path = scratch_path(spark, "ledger")
    done.write.parquet(ledger_path)
    postings_path = scratch_path(spark, "postings")
    parts = table("part").select("p_partkey", "p_name")
    search.write_postings(search.trigram_postings(parts, "p_name", "p_partkey"), postings_path, "p_partkey")

    def skip_all():
        work = chunks.withColumn("key", key)
        free = ledger.skip_processed(work, spark.read.parquet(ledger_path))
        run(embed.embed(free, lambda: embed.HashEmbedder(64)))

    jobs = {
        "clean_and_chunk": lambda: run(chunking.chunk_documents(inputs.documents(spark, FOLDER), layer_version=1)),
        "extract_markers": lambda: run(inputs.log_lines(spark, FOLDER).select(markers.extract_markers(F.col("text")))),
        "exact_top_k": lambda: run(topk.top_k(vectors, queries, 10, vector_id="vec_id")),
        "exact_top_k_4096": lambda: run(topk.top_k(vectors, many, 10, vector_id="vec_id")),
        "embed_chunks": lambda: run(embed.embed(chunks, lambda: embed.HashEmbedder(64))),
        "rerun_nothing_new": skip_all,
        "upsert_tenth": lambda: stored.upsert(lines.filter("k % 10 = 0").withColumn("v", F.col("v") + 1)),
        "stage_percentiles": lambda: run(metrics.stage_percentiles(inputs.metric_records(spark, FOLDER))),
        "hourly_windows": lambda: run(metrics.dashboard_series(inputs.metric_records(spark, FOLDER), "1 hour")),
        "trigram_search": lambda: run(search.indexed_search(parts, spark.read.parquet(postings_path), "p_name", "ring", 50, "p_partkey")),
    }
    times = {}
    for name, job in jobs.items():
        spent = []
        for _ in range(2):
            begin = time.perf_counter()
            job()
            spent.append(time.perf_counter() - begin)
        times[name] = round(min(spent), 3)
    sizes = {
        "documents": table("documents").count(), "chunks": chunks.count(), "vectors": vectors.count(), "lineitem": lines.count(),
        "events": table("events").count(),
    }
    rates = {
        "documents_per_sec": round(sizes["documents"] / times["clean_and_chunk"]),
        "chunks_per_sec": round(sizes["chunks"] / times["clean_and_chunk"]),
        "pairs_scored_per_sec": round(sizes["vectors"] ** 2 / times["exact_top_k"]),
    }
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1], "sizes": sizes, "rates": rates,
    }))
    clear_scratch(spark)


if __name__ == "__main__":
    main()
