"""Queries over keyed state: upserts, ledger, prompt cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import ids
from corpusmill.operators import cache, embed, ledger, upsert
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, shown, sql_shown, table, with_sql
from corpusmill.session import scratch_path
from corpusmill.sources import sinks

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# --- upserts --------------------------------------------------------------------------------------


def _gold(spark, folder):
    """Even orders as the stored table."""
    return table(spark, folder, "orders").filter("o_orderkey % 2 = 0").select(
        "o_orderkey", F.lit("stored").alias("origin"), "o_totalprice")


def _batch(spark, folder):
    """Orders that are odd or divisible by three as the batch, each of them twice."""
    orders = table(spark, folder, "orders").filter("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0")
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    return orders.select("o_orderkey", copies, "o_totalprice").select(
        "o_orderkey", F.concat(F.lit("batch-"), F.col("copy").cast("string")).alias("origin"),
        (F.col("o_totalprice") + F.col("copy")).alias("o_totalprice"))


_UPSERT_SQL = (
    "gold AS (SELECT o_orderkey, 'stored' AS origin, o_totalprice FROM orders WHERE o_orderkey % 2 = 0), "
    "batch AS (SELECT o_orderkey, 'batch-1' AS origin, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0), "
    "merged AS (SELECT * FROM gold WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_orderkey = gold.o_orderkey) UNION ALL SELECT * FROM batch)"
)


@query("SNK4_keyed_upsert", with_sql(_UPSERT_SQL, select="SELECT * FROM merged"))
def keyed_upsert(spark, folder):
    stored = upsert.KeyedTable(
        spark, scratch_path(spark, "upsert"), "o_orderkey bigint, origin string, o_totalprice double", ["o_orderkey"], buckets=8)
    stored.upsert(_gold(spark, folder))
    for _ in range(2):
        stored.upsert(_batch(spark, folder), ["origin"])
    return stored.read()


@query("SNK5_merge_plan", with_sql(_UPSERT_SQL, select="SELECT * FROM merged"))
def merge_plan(spark, folder):
    batch = upsert.latest_per_key(_batch(spark, folder), ["o_orderkey"], ["origin"])
    return upsert.merge(_gold(spark, folder), batch, ["o_orderkey"])


_VECTOR_SQL = "SELECT 'v' || vec_id AS chunk_id, 'm' || label % 2 AS model_id, len(embedding)::INTEGER AS embed_dim, layer_version, 'text ' || layer_version || CASE WHEN vec_id % 3 = 0 THEN ' again' ELSE '' END AS content, round(embedding[1], 6) AS head FROM embeddings, (SELECT unnest([1, 2])::INTEGER AS layer_version)"


@query("SNK6_vector_upsert", _VECTOR_SQL)
def vector_upsert(spark, folder):
    vectors = table(spark, folder, "embeddings")
    rows = vectors.select(
        F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.lit("d").alias("doc_id"), F.concat(F.lit("s"), "label").alias("source_id"),
        F.lit(0).alias("ordinal"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer_version"), "vec_id", "label", "embedding",
    ).withColumns({
        "content": F.concat(F.lit("text "), F.col("layer_version").cast("string")), "geological_age": ids.era(F.col("layer_version")),
        "ingested_at": now(), "metadata": F.create_map(F.lit("filename"), F.lit("f")),
    })
    stored = sinks.vector_table(spark, scratch_path(spark, "vectors"), buckets=8)
    again = rows.filter("vec_id % 3 = 0").withColumn("content", F.concat("content", F.lit(" again")))
    short = rows.withColumn("embedding", F.slice("embedding", 1, 3))
    for model in (0, 1):
        chosen = F.col("label") % 2 == model
        sinks.upsert_vectors(stored, rows.filter(chosen), f"m{model}", 64)
        sinks.upsert_vectors(stored, again.filter(chosen).unionByName(short), f"m{model}", 64)
    return stored.read().select(
        "chunk_id", "model_id", "embed_dim", "layer_version", "content", F.round(F.col("embedding")[0], 6).alias("head"))


@query("SNK8_vector_files", "SELECT 'v' || vec_id AS chunk_id, round(embedding[1], 6) AS head FROM embeddings")
def vector_files(spark, folder):
    stored = sinks.vector_file_table(spark, scratch_path(spark, "files"), buckets=8)
    rows = table(spark, folder, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding")
    stored.upsert(rows.withColumn("embedding", F.reverse("embedding")))
    stored.upsert(rows)
    return stored.read().select("chunk_id", F.round(F.col("embedding")[0], 6).alias("head"))


@query("AGG9_latest_per_key", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_event(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return upsert.latest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("WIN2_one_row_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1")
def dearest_order(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return upsert.latest_per_key(orders, ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("SET1_union_by_name", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers)


@query("SET2_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark, folder):
    return table(spark, folder, "documents").select("lang", "source").distinct()


@query("SET3_column_difference", "SELECT count(*) AS rows, 'lang,n_chars,source,text' AS only_documents, 'quality,toxic' AS only_labels FROM documents JOIN labels USING (doc_id)")
def column_difference(spark, folder):
    left, right = table(spark, folder, "documents"), table(spark, folder, "labels")
    both = left.select("doc_id").join(right.select("doc_id"), "doc_id")
    return both.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(",".join(sorted(set(left.columns) - set(right.columns)))).alias("only_documents"),
        F.lit(",".join(sorted(set(right.columns) - set(left.columns)))).alias("only_labels"))


# --- ledger ---------------------------------------------------------------------------------------


def _ledger(spark, folder):
    """A ledger entry per document: done, claimed lately, claimed long ago, or none."""
    n = F.col("doc_id")
    entries = table(spark, folder, "documents").filter(n % 4 != 3)
    done = n % 4 == 0
    return entries.select(
        F.concat(F.lit("k"), n.cast("string")).alias("key"), F.when(done, "PROCESSED").otherwise("PENDING").alias("status"),
        F.when(done, F.concat(F.lit("vector:"), n.cast("string"))).alias("ref"),
        F.when(n % 4 == 1, F.lit("2024-01-31 23:30:00")).when(n % 4 == 2, F.lit("2024-01-31 22:00:00")).cast("timestamp").alias("claimed_at"),
        F.when(done, F.when(n % 8 == 0, F.lit("2024-01-20 00:00:00")).otherwise(F.lit("2023-12-01 00:00:00"))).cast("timestamp").alias("processed_at"),
    )


_LEDGER_SQL = (
    "ledger AS (SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'PROCESSED' ELSE 'PENDING' END AS status, "
    "CASE WHEN doc_id % 4 = 0 THEN 'vector:' || doc_id END AS ref, "
    "CASE doc_id % 4 WHEN 1 THEN TIMESTAMP '2024-01-31 23:30:00' WHEN 2 THEN TIMESTAMP '2024-01-31 22:00:00' END AS claimed_at, "
    "CASE WHEN doc_id % 8 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' WHEN doc_id % 4 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' END AS processed_at "
    "FROM documents WHERE doc_id % 4 <> 3)"
)


def _work(spark, folder):
    """Every document asked for by its key; keys of long documents several times."""
    copies = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 2000))).alias("copy")
    return table(spark, folder, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), copies)


_WORK_SQL = "work AS (SELECT 'k' || doc_id AS key, unnest(range(0, n_chars // 2000 + 1)) AS copy FROM documents)"
_OUTCOME_SQL = (
    f"outcomes AS (SELECT w.key, w.requests, CASE WHEN l.status = 'PROCESSED' THEN 'processed' WHEN l.status = 'PENDING' AND "
    f"l.claimed_at + INTERVAL 3600 SECOND > TIMESTAMP '{NOW}' THEN 'locked' ELSE 'claimed' END AS outcome FROM "
    "(SELECT key, count(*) AS requests FROM work GROUP BY key) w LEFT JOIN ledger l ON w.key = l.key)"
)


@query("LED1_skip_processed", with_sql(_LEDGER_SQL, _WORK_SQL, select="SELECT key, copy FROM work WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.key = work.key AND status = 'PROCESSED')"))
def skip_processed(spark, folder):
    return ledger.skip_processed(_work(spark, folder), _ledger(spark, folder))


@query("LED2_claim_outcomes", with_sql(_LEDGER_SQL, _WORK_SQL, _OUTCOME_SQL, select="SELECT * FROM outcomes"))
def claim_outcomes(spark, folder):
    return ledger.claim_outcomes(_work(spark, folder), _ledger(spark, folder), now())


@query("LED3_commit", with_sql(_LEDGER_SQL, _WORK_SQL, _OUTCOME_SQL, select=f"""
SELECT key, 'PROCESSED' AS status, 'vector:' || key AS ref, '{NOW}' AS processed FROM outcomes WHERE outcome = 'claimed'
UNION ALL SELECT key, status, ref, {sql_shown('processed_at')} FROM ledger WHERE key NOT IN (SELECT key FROM outcomes WHERE outcome = 'claimed')"""))
def commit(spark, folder):
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=8)
    book.table.upsert(_ledger(spark, folder))
    outcomes = book.claim(_work(spark, folder), now())
    won = outcomes.filter("outcome = 'claimed'").select("key", F.concat(F.lit("vector:"), "key").alias("ref"))
    book.commit(won, now())
    return book.read().select("key", "status", "ref", shown("processed_at", "processed"))


@query("LED4_release", with_sql(_LEDGER_SQL, select="SELECT key, status FROM ledger WHERE status = 'PROCESSED' OR length(key) % 2 = 1"))
def release(spark, folder):
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=8)
    entries = _ledger(spark, folder)
    book.table.upsert(entries)
    book.release(entries.filter(F.length("key") % 2 == 0).select("key"))
    return book.read().select("key", "status")


@query("LED5_stats", with_sql(_LEDGER_SQL, select="SELECT count(*) FILTER (status = 'PROCESSED') AS processed, count(*) FILTER (status = 'PENDING') AS pending FROM ledger"))
def ledger_stats(spark, folder):
    return ledger.ledger_stats(_ledger(spark, folder))


@query("LED6_null_ledger", with_sql(_WORK_SQL, select="SELECT key, count(*) AS requests, 'claimed' AS outcome FROM work GROUP BY key"))
def null_ledger(spark, folder):
    return ledger.claim_outcomes(_work(spark, folder), ledger.null_ledger(spark), now())


@query("LED7_document_skip", with_sql(_LEDGER_SQL, _WORK_SQL, select=f"SELECT key, copy FROM work WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.key = work.key AND status = 'PROCESSED' AND processed_at + INTERVAL 30 DAY > TIMESTAMP '{NOW}')"))
def document_skip(spark, folder):
    return ledger.skip_recent(_work(spark, folder), _ledger(spark, folder), now())


@query("VEC11_batch_counters", with_sql(_LEDGER_SQL, _WORK_SQL, _OUTCOME_SQL, select="""
SELECT sum(requests)::BIGINT AS total, count(*) FILTER (outcome = 'claimed') AS embedded, sum(requests) FILTER (outcome = 'processed')::BIGINT AS skipped_processed,
 (sum(requests) FILTER (outcome = 'locked') + sum(requests - 1) FILTER (outcome = 'claimed'))::BIGINT AS skipped_locked, 0::BIGINT AS failed FROM outcomes"""))
def batch_counters(spark, folder):
    """Embed every document once, with a ledger that has finished, fresh and expired entries."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    chunks = _work(spark, folder).join(docs, F.col("key") == F.concat(F.lit("k"), F.col("doc_id").cast("string"))).select(
        F.col("key").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("source_id"),
        F.lit(0).alias("ordinal"), F.col("text").alias("content"), F.lit(1).alias("layer_version"),
        ids.era(F.lit(1)).alias("geological_age"), now().alias("ingested_at"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"), buckets=8)
    model = F.concat(F.lit(f"{embed.MODEL_ID}:32:"), "key")
    book.table.upsert(_ledger(spark, folder).withColumn("key", model))
    stored = sinks.vector_table(spark, scratch_path(spark, "vectors"), buckets=8)
    return embed.embed_chunks(
        chunks, ledger=book, vectors=stored, now=now(), factory=lambda: embed.HashEmbedder(32), embed_dim=32)


# --- prompt cache ---------------------------------------------------------------------------------


def _requests(spark, folder):
    """A request per conversation turn; repeats of a text share the key."""
    turns = table(spark, folder, "conversations")
    hits = F.array(F.struct(
        F.sha2("role", 256).alias("chunk_id"), (F.col("turn") % 3 + 1).cast("int").alias("layer_version"),
        ids.era(F.col("turn") % 3 + 1).alias("geological_age")))
    asked = turns.select(
        "conv_id", "turn", F.col("text").alias("query"), F.when(F.col("turn") % 2 == 0, "Be \"brief\"").alias("instruction"), hits.alias("hits"))
    return asked.withColumn("key", ids.prompt_key(F.lit("mock"), F.col("query"), F.col("instruction"), F.col("hits")))


_REQUESTS_SQL = (
    "requests AS (SELECT conv_id, turn, text AS query, CASE WHEN turn % 2 = 0 THEN 'Be \"brief\"' END AS instruction, "
    "sha256('{\"hits\": [[\"' || sha256(role) || '\", ' || (turn % 3 + 1) || ', \"' || " + I.sql_era("(turn % 3 + 1)") + " || '\"]], \"instruction\": ' || "
    "to_json(CASE WHEN turn % 2 = 0 THEN 'Be \"brief\"' ELSE '' END)::VARCHAR || ', \"model\": \"mock\", \"query\": ' || to_json(text)::VARCHAR || '}') AS key FROM conversations)"
)


def _cache(requests):
    """Answers kept for requests of even conversations, put and used at different times."""
    day = lambda n: F.timestamp_seconds(F.lit(1706745600) - n * 86400)
    return upsert.latest_per_key(
        requests.filter("conv_id % 2 = 0").select(
            "key", F.concat(F.lit("known "), F.length("query").cast("string")).alias("value"),
            day(F.col("turn") * 3).alias("put_at"), day(F.col("conv_id") % 5).alias("last_used")), ["key"], ["value", "put_at", "last_used"])


_CACHE_SQL = (
    "cache AS (SELECT key, value, put_at, last_used FROM (SELECT key, 'known ' || length(query) AS value, TIMESTAMP '2024-02-01' - (turn * 3) * INTERVAL 1 DAY AS put_at, "
    "TIMESTAMP '2024-02-01' - (conv_id % 5) * INTERVAL 1 DAY AS last_used FROM requests WHERE conv_id % 2 = 0) "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY value DESC, put_at DESC, last_used DESC) = 1)"
)


@query("CCH1_prompt_keys", with_sql(_REQUESTS_SQL, select="SELECT conv_id, turn, key FROM requests"))
def prompt_keys(spark, folder):
    return _requests(spark, folder).select("conv_id", "turn", "key")


@query("CCH2_cached_answers", with_sql(_REQUESTS_SQL, _CACHE_SQL, select=f"""
SELECT conv_id, turn, coalesce(value, 'fresh ' || length(query)) AS value, value IS NOT NULL AS cached, coalesce(value, 'fresh ' || length(query)) AS stored,
 '{NOW}' AS used, CASE WHEN value IS NULL THEN '{NOW}' ELSE {sql_shown('put_at')} END AS put FROM requests LEFT JOIN cache USING (key)"""))
def cached_answers(spark, folder):
    """Answer all requests, and show what the cache then holds for each."""
    requests = _requests(spark, folder)
    store = cache.cache_table(spark, scratch_path(spark, "cache"), buckets=8)
    store.upsert(_cache(requests))
    compute = lambda missing: missing.withColumn("value", F.concat(F.lit("fresh "), F.length("query").cast("string")))
    answered = cache.serve(store, requests, compute, now())
    kept = store.read().select("key", F.col("value").alias("stored"), shown("last_used", "used"), shown("put_at", "put"))
    return answered.join(kept, "key").select("conv_id", "turn", "value", "cached", "stored", "used", "put")


@query("CCH3_bounded_cache", with_sql(_REQUESTS_SQL, _CACHE_SQL, select=f"""
SELECT key, value FROM cache WHERE put_at + INTERVAL 604800 SECOND >= TIMESTAMP '{NOW}' ORDER BY last_used DESC, key LIMIT 40"""))
def bounded_cache(spark, folder):
    return cache.evict(_cache(_requests(spark, folder)), now(), capacity=40).select("key", "value")
