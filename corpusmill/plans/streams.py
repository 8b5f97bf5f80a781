"""Streaming jobs run over the given tables until nothing is left to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.vectors import cosine
from corpusmill.operators import ann, topk
from corpusmill.operators.embed import HashEmbedder
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, shown, sql_shown, table, with_sql
from corpusmill.plans.metrics import _alarm_select, _calendar
from corpusmill.session import scratch_path
from corpusmill.streaming import claims, ingest, metrics, refresh, sketches


def _ingested(spark, folder, index):
    """Queue and object store of all documents, drained by the ingest stream."""
    root = scratch_path(spark, "ingest")
    queue = I.queue_messages(spark, folder)
    # Shapes that name no stored object get a second, plain message, so that every document is asked for.
    plain = queue.filter("number % 9 NOT IN (0, 1, 2, 5)").select(
        F.concat("message_id", F.lit("-again")).alias("message_id"),
        F.concat(F.lit('{"bucket":"raw","key":"in/doc-'), F.col("number").cast("string"), F.lit('.txt"}')).alias("body"),
        F.lit(1).alias("attempt"), "number")
    queue.unionByName(plain).drop("number").write.json(f"{root}/queue/inbox")
    objects = table(spark, folder, "documents").select(
        F.lit("raw").alias("bucket"), F.concat(F.lit("in/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.encode("text", "UTF-8").alias("content"))
    job = ingest.QueueIngest(
        spark, root, ingest.table_store(objects), index=index, embedder=lambda: HashEmbedder(16), embed_dim=16, buckets=8)
    job.start(scratch_path(spark, "progress")).awaitTermination()
    return job


_FOUND = (
    "found AS (SELECT sha256('in/doc-' || doc_id || '.txt' || chr(0) || text) AS doc_id, 'in/doc-' || doc_id || '.txt' AS source_id, "
    "'in/doc-' || doc_id || '.txt' AS filename, text, 1 AS layer_version FROM documents)"
)


@query("STR2_ingest_stream", with_sql(_FOUND, select="SELECT doc_id, source_id, 's3://raw/' || filename AS source_uri, length(text)::INTEGER AS char_count FROM found"))
def ingest_stream(spark, folder):
    return _ingested(spark, folder, False).silver.read().select("doc_id", "source_id", "source_uri", "char_count")


@query("STR3_index_stream", with_sql(_FOUND, *I.sql_chunks("found"), recursive=True, select="SELECT chunk_id, source_id, ordinal, content, 16 AS embed_dim FROM chunks"))
def index_stream(spark, folder):
    return _ingested(spark, folder, True).vectors.read().select("chunk_id", "source_id", "ordinal", "content", "embed_dim")


@query("STR6_redelivered_messages", "SELECT DISTINCT event_type || '-' || user_id || '-' || time_bucket(INTERVAL '1 hour', ts)::DATE AS message_id FROM events")
def redelivered(spark, folder):
    """Events of one user, type and day as deliveries of one message."""
    root = scratch_path(spark, "again")
    day = F.date_format("ts", "yyyy-MM-dd")
    name = F.concat_ws("-", "event_type", F.col("user_id").cast("string"), day)
    table(spark, folder, "events").select(name.alias("message_id"), F.col("ts").cast("timestamp").alias("sent_at")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("message_id string, sent_at timestamp").parquet(f"{root}/in")
    query_ = ingest.without_redeliveries(stream, horizon="2 days").writeStream.format("parquet").option(
        "path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("message_id")


def _refreshed(spark, folder, parts, cells, **options):
    """An index trained on the first part of the vectors; every part arrives as files of its own."""
    root = scratch_path(spark, "refresh")
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    lists = ann.train_inverted_lists(vectors.filter(F.col("vec_id") % parts == 0), dim=64, cells=cells, code_bits=3)
    job = refresh.IndexRefresh(spark, f"{root}/in/*", f"{root}/index", lists, **options)
    for part in range(parts):
        vectors.filter(F.col("vec_id") % parts == part).write.parquet(f"{root}/in/{part}")
        job.start(f"{root}/progress").awaitTermination()
    return job


@query("STR8_index_refresh", "SELECT vec_id, len(embedding)::INTEGER AS dim, 8 AS codes FROM embeddings")
def index_refresh(spark, folder):
    """Index half of the vectors, then let the other half arrive."""
    job = _refreshed(spark, folder, 2, 8)
    return job.index.read().select(F.col("id").alias("vec_id"), F.size("embedding").alias("dim"), F.octet_length("codes").alias("codes"))


@query("VEC9_search_after_refresh", """SELECT vec_id AS query_id, 5::BIGINT AS hits, true AS scores_right, true AS own_cells_only, true AS recalled, true AS split, 3::BIGINT AS refreshes
 FROM embeddings WHERE vec_id % 50 = 0""")
def search_after_refresh(spark, folder):
    """Three refreshes with splits of cells that grew, then a search: at least 0.9 of the queries, all indexed themselves, come back first.

    The files that the search lists lie in the cells it probes, half of all.
    """
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    job = _refreshed(spark, folder, 3, 4, cell_rows=max(20, vectors.count() // 6))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    parts = job.index._parts()
    lists = job.index.lists(parts)
    probes = len(lists.centres) // 2
    first = queries.limit(1).collect()  # one query, so that its cells are told apart from the others
    rows, members = job.index.probed(parts, lists, topk.query_matrix([row["query_embedding"] for row in first], "cosine"), probes)
    own = {int(path.split("/at=")[1].split("/")[0]) for path in rows.inputFiles()} <= set(members) and len(members) <= probes
    found = job.index.search(queries, 5, nprobe=probes)
    share = found.filter("rank = 1").agg((F.avg((F.col("id") == F.col("query_id")).cast("double")) >= 0.9).alias("recalled"))
    scored = found.join(queries, "query_id").join(vectors.withColumnRenamed("vec_id", "id"), "id")
    right = F.abs(cosine(F.col("query_embedding"), F.col("embedding")) - F.col("score")) < 1e-6
    per_query = scored.groupBy("query_id").agg(F.bool_and(right).alias("scores_right"), F.count("*").alias("hits")).join(F.broadcast(share))
    return per_query.select(
        "query_id", "hits", "scores_right", F.lit(own).alias("own_cells_only"), "recalled",
        F.lit(len(lists.centres) > 4).alias("split"), F.lit(parts["seq"]).cast("long").alias("refreshes"))


def _streamed(spark, folder):
    """Stage records, and run summaries under a stage of their own."""
    root = scratch_path(spark, "records")
    records = I.metric_records(spark, folder).filter("event IN ('stage_done', 'pipeline_done')")
    stage = F.when(F.col("event") == "stage_done", F.col("stage")).otherwise(metrics.SUMMARY)
    records.select("ts", stage.alias("stage"), "latency", "errors", F.col("rows_ingested").cast("double").alias("rows_ingested")).write.parquet(root)
    return spark.readStream.schema("ts timestamp, stage string, latency double, errors int, rows_ingested double").parquet(root)


def _alarms(spark, folder):
    job = metrics.StreamingAlarms(spark, scratch_path(spark, "alarms"), period="6 hours", latency_threshold=150)
    job.start(_streamed(spark, folder), scratch_path(spark, "progress")).awaitTermination()
    return job


# A window is closed once the watermark, the latest time minus the lateness, has passed its end.
_WINDOWS = (
    "windows AS (SELECT CASE WHEN event = 'stage_done' THEN stage ELSE 'summary' END AS stage, time_bucket(INTERVAL '6 hours', ts) AS period, count(*) AS samples, sum(errors)::BIGINT AS errors, "
    "round(sum(latency), 6) AS latency_sum, max(latency) AS latency_max, quantile_disc(latency, 0.99) AS latency_p99, sum(rows_ingested)::DOUBLE AS rows_ingested "
    "FROM records WHERE event IN ('stage_done', 'pipeline_done') GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', min(ts)) + INTERVAL '6 hours' <= "
    "(SELECT max(ts) - INTERVAL '10 minutes' FROM records WHERE event IN ('stage_done', 'pipeline_done')))"
)


@query("STR9_windowed_metrics", with_sql(
    I.METRICS_SQL, _WINDOWS, select=f"SELECT stage, {sql_shown('period')} AS period, samples, errors, latency_sum, latency_max, latency_p99, rows_ingested FROM windows"))
def windowed(spark, folder):
    found = _alarms(spark, folder).windows.read().withColumn("period", shown("period")).withColumn("latency_sum", F.round("latency_sum", 6))
    return found.select("stage", "period", "samples", "errors", "latency_sum", "latency_max", "latency_p99", "rows_ingested")


@query("STR9_daily_percentiles", with_sql(
    I.METRICS_SQL, _WINDOWS, select=f"""SELECT r.stage, {sql_shown("date_trunc('day', r.ts)")} AS period, count(r.latency) AS samples,
 quantile_disc(r.latency, 0.5) AS p50, quantile_disc(r.latency, 0.99) AS p99 FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS bucket FROM records) r
 JOIN windows w ON w.stage = r.stage AND w.period = r.bucket WHERE r.event IN ('stage_done', 'pipeline_done') GROUP BY r.stage, date_trunc('day', r.ts)"""))
def daily_percentiles(spark, folder):
    """Days from the stored counts of closed six-hour windows; the records are not read again."""
    found = _alarms(spark, folder).percentiles("1 day", {"p50": "50", "p99": "99"})
    return found.select("stage", shown("period", "period"), "samples", "p50", "p99")


@query("STR9_sketched_windows", with_sql(I.METRICS_SQL, select=f"""SELECT stage, {sql_shown("date_trunc('day', ts)")} AS period, count(latency) AS samples, true AS p50_within, true AS p99_within
 FROM records WHERE event IN ('stage_done', 'pipeline_done') AND latency IS NOT NULL GROUP BY 1, 2"""))
def sketched_windows(spark, folder):
    """Days merged from stored sketches of an hour; the ranks of their percentiles, counted in the records, lie within the stated error.

    The error holds in 99 of 100 cases; twice of it is allowed here.
    """
    stream = _streamed(spark, folder)
    job = sketches.LatencySketches(spark, scratch_path(spark, "sketches"), period="1 hour", size=1024)
    job.start(stream, scratch_path(spark, "progress")).awaitTermination()
    days = job.windows("1 day", {"p50": "50", "p99": "99"}).withColumnRenamed("samples", "n")
    records = I.metric_records(spark, folder).filter("event IN ('stage_done', 'pipeline_done') AND latency IS NOT NULL")
    records = records.select("stage", F.window("ts", "1 day")["start"].alias("period"), "latency")

    def within(name, share):
        below, upto = (F.sum(test.cast("long")) / F.max("n") for test in (F.col("latency") < F.col(name), F.col("latency") <= F.col(name)))
        margin = 2 * F.max("rank_error") + 1e-9
        return ((below - margin <= share) & (upto + margin >= share)).alias(f"{name}_within")

    found = records.join(days, ["stage", "period"]).groupBy("stage", "period").agg(
        F.max("n").alias("samples"), within("p50", 0.5), within("p99", 0.99))
    return found.withColumn("period", shown("period"))


_KINDS = (
    ("stage_errors", "we", "errors", "stage <> 'summary'", "coalesce(value > 3, false)", 3, 5),
    ("stage_latency", "wl", "latency_p99", "stage <> 'summary'", "coalesce(value > 150, false)", 1, 1),
    ("empty_output", "wr", "rows_ingested", "stage = 'summary'", "coalesce(value < 1, true)", 1, 1),
)
_STATE_PARTS = [
    part for _, short, value, which, _, _, _ in _KINDS
    for part in (f"{short} AS (SELECT stage, period, {value}::DOUBLE AS value FROM windows WHERE {which})", _calendar(short, "stage", "6 hours", f"{short}_full"))
]
_STATES = " UNION ALL ".join(
    f"SELECT '{name}' AS alarm_name, * FROM ({_alarm_select(f'{short}_full', 'stage', breach, m, n)})" for name, short, _, _, breach, m, n in _KINDS)


@query("STR10_streaming_alarms", with_sql(I.METRICS_SQL, _WINDOWS, *_STATE_PARTS, select=_STATES))
def streaming_alarms(spark, folder):
    return _alarms(spark, folder).states.read().withColumn("period", shown("period")).select("alarm_name", "stage", "period", "value", "breach", "alarm")


@query("STR10_streaming_health", with_sql(
    I.METRICS_SQL, _WINDOWS, *_STATE_PARTS,
    select=f"SELECT {sql_shown('day')} AS period, bool_or(alarm) AS alarm FROM (SELECT date_trunc('day', strptime(period, '%Y-%m-%d %H:%M:%S')) AS day, alarm FROM ({_STATES})) GROUP BY 1"))
def streaming_health(spark, folder):
    return _alarms(spark, folder).health("1 day").withColumn("period", shown("period"))


@query("STR7_claim_stream", """
SELECT 'k' || doc_id AS key, outcome, decided_at FROM (
 SELECT doc_id, unnest(['claimed', CASE WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'locked' END, CASE WHEN doc_id % 3 = 0 THEN 'processed' ELSE 'claimed' END]) AS outcome,
  unnest(['2024-02-01 00:00:00', '2024-02-01 00:30:00', '2024-02-01 02:00:00']) AS decided_at FROM documents)""")
def claim_stream(spark, folder):
    """Every document is asked for three times; a third of them is finished with the first claim, the others' claims expire.

    The later two requests come in one batch, 90 minutes apart.
    """
    root = scratch_path(spark, "claims")
    start = F.lit("2024-02-01 00:00:00").cast("timestamp")
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key")
    action = F.when(F.col("doc_id") % 3 == 0, "finish").otherwise("claim").alias("action")
    job = claims.ClaimStream(spark, f"{root}/state")
    for part, minutes in enumerate(((0,), (30, 120))):
        times = F.explode(F.array(*[start + F.make_dt_interval(mins=F.lit(minute)) for minute in minutes])).alias("asked_at")
        table(spark, folder, "documents").select(key, times, action).write.parquet(f"{root}/in/{part}")
        asked = spark.readStream.schema(claims.REQUESTS).parquet(f"{root}/in/*")
        job.start(asked, f"{root}/progress").awaitTermination()
    return job.outcomes.read().select("key", "outcome", shown("decided_at", "decided_at"))
