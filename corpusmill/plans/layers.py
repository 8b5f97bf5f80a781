"""Queries over document layers, datasets, markers and queue messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import ids, markers, text
from corpusmill.operators import chunking, dataset, diff, layers, ledger, metrics
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, table, with_sql
from corpusmill.session import scratch_path
from corpusmill.sources import sinks
from corpusmill.streaming import ingest, messages


def _chunks(spark, folder):
    return chunking.chunk_documents(I.layered(spark, folder))


def _sql(select: str, *ctes: str) -> str:
    return with_sql(*I.LAYER_CHUNKS_SQL, *ctes, recursive=True, select=select)


@query("LAY1_list_layers", _sql("SELECT source_id, array_to_string(list_sort(list(DISTINCT layer_version)), ',') AS versions, max(layer_version) AS latest FROM chunks GROUP BY source_id"))
def list_layers(spark, folder):
    found = layers.list_layers(_chunks(spark, folder))
    return found.select(
        "source_id", F.array_join(F.transform("available_versions", lambda v: v.cast("string")), ",").alias("versions"), F.col("latest_version").alias("latest"))


@query("LAY2_latest_layer", _sql("SELECT source_id, ordinal, layer_version, chunk_id FROM chunks QUALIFY layer_version = max(layer_version) OVER (PARTITION BY source_id)"))
def latest(spark, folder):
    return layers.latest_layer(_chunks(spark, folder)).select("source_id", "ordinal", "layer_version", "chunk_id")


@query("LAY3_layer_content", _sql("SELECT chunk_id, doc_id, source_id, ordinal, content, layer_version, geological_age FROM chunks WHERE layer_version = 2"))
def layer_content(spark, folder):
    return layers.layer(_chunks(spark, folder), 2)


@query("LAY4_time_travel", _sql(
    "SELECT c.source_id, c.ordinal, c.content, c.layer_version, l.latest AS latest_version, c.layer_version = l.latest AS is_latest FROM chunks c JOIN "
    "(SELECT source_id, max(layer_version) AS latest FROM chunks GROUP BY 1) l ON c.source_id = l.source_id WHERE c.layer_version = 2"))
def time_travel(spark, folder):
    found = layers.time_travel(_chunks(spark, folder), 2)
    return found.select("source_id", "ordinal", "content", "layer_version", "latest_version", "is_latest")


_DIFF = """
SELECT source_id, 1 AS from_version, 2 AS to_version, sum(greatest(n - o, 0)) + sum(greatest(o - n, 0)) > 0 AS changed,
 sum(greatest(n - o, 0))::BIGINT AS added_lines, sum(greatest(o - n, 0))::BIGINT AS removed_lines FROM
 (SELECT source_id, content, count(*) FILTER (layer_version = 1) AS o, count(*) FILTER (layer_version = 2) AS n FROM chunks WHERE layer_version <= 2 GROUP BY 1, 2)
GROUP BY source_id HAVING sum(o) > 0 AND sum(n) > 0"""


@query("LAY5_layer_diff_counts", _sql(_DIFF))
def diff_counts(spark, folder):
    return diff.layer_diff_counts(_stored_chunks(spark, folder), 1, 2)


def _stored_chunks(spark, folder):
    """The chunks as a written gold table, which is what a diff that reads them several times gets."""
    path = scratch_path(spark, "gold")
    sinks.write_gold(_chunks(spark, folder), path)
    return spark.read.parquet(path)


@query("LAY6_diff_lines", _sql(
    "SELECT source_id, ordinal::BIGINT AS ordinal, content FROM chunks WHERE layer_version = 2 AND source_id IN (SELECT source_id FROM chunks WHERE layer_version = 1)"))
def diff_lines(spark, folder):
    """Layer 1 with the rows of the diff applied to it is layer 2."""
    chunks = _stored_chunks(spark, folder)
    rows = diff.diff_lines(chunks, 1, 2)
    both = chunks.filter("layer_version = 2").select("source_id").distinct()
    return diff.apply_diff(chunks.filter("layer_version = 1").join(both, "source_id", "left_semi"), rows)


_LINES = "string_split(regexp_replace(%s, '\\n$', ''), chr(10))"


@query("LAY7_text_diff_counts", f"""
SELECT doc_id, sum(greatest(n - o, 0)) + sum(greatest(o - n, 0)) > 0 AS changed, sum(greatest(n - o, 0))::BIGINT AS added_lines, sum(greatest(o - n, 0))::BIGINT AS removed_lines FROM
 (SELECT doc_id, line, count(*) FILTER (NOT is_new) AS o, count(*) FILTER (is_new) AS n FROM
  (SELECT doc_id, unnest({_LINES % 'text'}) AS line, false AS is_new FROM documents UNION ALL SELECT doc_id, unnest({_LINES % 'edited'}), true FROM (SELECT doc_id, {I.sql_half('text')} AS edited FROM documents)) GROUP BY 1, 2)
GROUP BY doc_id""")
def text_diff(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", text.keep_first_half(F.col("text")).alias("edited"))
    return diff.text_diff_counts(docs, "doc_id", "text", "edited")


@query("LAY8_next_versions", _sql(
    "SELECT n.source_id, CASE WHEN n.number % 5 <> 0 THEN n.next END AS persisted_version FROM (SELECT d.source_id, d.number, coalesce(max(c.layer_version), 0) + 1 AS next FROM docs d "
    "LEFT JOIN (SELECT * FROM chunks WHERE layer_version <= 2) c ON c.source_id = d.source_id GROUP BY 1, 2) n"))
def next_versions(spark, folder):
    """Store an edit of every document as its next layer; a blank edit gets no version."""
    docs = I.documents(spark, folder)
    older = _chunks(spark, folder).filter("layer_version <= 2")
    edited = F.when(F.col("number") % 5 != 0, text.keep_first_half(F.col("text"))).otherwise(F.lit("  "))
    numbered = layers.next_versions(docs.withColumn("text", edited).select("doc_id", "source_id", "filename", "text"), older)
    path = scratch_path(spark, "layers")
    sinks.write_gold(chunking.chunk_documents(numbered), path)
    return layers.persisted_versions(numbered, spark.read.parquet(path))


@query("LAY9_layers_side_by_side", _sql("SELECT content, count(DISTINCT layer_version) AS layers, count(*) AS rows FROM chunks GROUP BY content HAVING count(DISTINCT layer_version) > 1"))
def side_by_side(spark, folder):
    grouped = _chunks(spark, folder).groupBy("content").agg(F.count_distinct("layer_version").alias("layers"), F.count("*").alias("rows"))
    return grouped.filter("layers > 1")


@query("WIN3_latest_version", _sql("SELECT DISTINCT source_id, max(layer_version) OVER (PARTITION BY source_id) AS latest_version FROM chunks"))
def latest_version(spark, folder):
    return layers.list_layers(_chunks(spark, folder)).select("source_id", "latest_version")


@query("SRT1_order_by_name", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 100")
def order_by_name(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(100)


@query("SRT3_order_by_ordinal", _sql("SELECT source_id, layer_version, ordinal, chunk_id FROM chunks ORDER BY source_id, layer_version, ordinal"))
def order_by_ordinal(spark, folder):
    return _chunks(spark, folder).select("source_id", "layer_version", "ordinal", "chunk_id").orderBy("source_id", "layer_version", "ordinal")


@query("SET4_chunk_difference", _sql(
    "SELECT source_id, content, 'removed' AS side FROM (SELECT source_id, content FROM chunks WHERE layer_version = 1 EXCEPT ALL SELECT source_id, content FROM chunks WHERE layer_version = 2) "
    "UNION ALL SELECT source_id, content, 'added' FROM (SELECT source_id, content FROM chunks WHERE layer_version = 2 EXCEPT ALL SELECT source_id, content FROM chunks WHERE layer_version = 1)"))
def chunk_difference(spark, folder):
    chunks = _chunks(spark, folder)
    old, new = [chunks.filter(F.col("layer_version") == v).select("source_id", "content") for v in (1, 2)]
    return old.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))


@query("AGG15_ingest_summary", _sql(
    "SELECT d.doc_id, d.filename, coalesce(n, 0) AS chunks_total, coalesce(s, 0) AS chunks_indexed, d.layer_version, 'm' AS embed_model, 8 AS embed_dim FROM "
    "(SELECT DISTINCT doc_id, filename, layer_version FROM layered) d LEFT JOIN (SELECT doc_id, layer_version, count(*) AS n, count(*) FILTER (ordinal % 3 <> 2) AS s FROM chunks GROUP BY 1, 2) c "
    "ON c.doc_id = d.doc_id AND c.layer_version = d.layer_version"))
def ingest_summary(spark, folder):
    docs, chunks = I.layered(spark, folder).withColumn("layer_version", F.col("layer_version")), _chunks(spark, folder)
    indexed = chunks.filter("ordinal % 3 <> 2").withColumns({"model_id": F.lit("m"), "embed_dim": F.lit(8)})
    return chunking.ingest_summary(docs, chunks, indexed, model_id="m", embed_dim=8)


# --- datasets -------------------------------------------------------------------------------------

_FIRST = f"coalesce(({I.sql_sentences('content')})[1], {I.sql_strip('content')})"
_PAIRS = (
    "pairs AS (SELECT source_id, layer_version, ordinal, chunk_id, t.no::INTEGER AS template_no, t.name AS template, t.instruction, content AS input, "
    f"CASE t.name WHEN 'age' THEN geological_age ELSE {_FIRST} END AS output FROM chunks CROSS JOIN (VALUES (0, 'summarise', 'Summarise this fossil record concisely.'), "
    "(1, 'age', 'From which geological age is this fossil layer?'), (2, 'qa', 'What is the main fact recorded in this fossil?')) t(no, name, instruction))"
)
_LATEST = "chunks_latest AS (SELECT source_id AS sid, max(layer_version) AS latest FROM chunks GROUP BY 1)"


@query("DST1_template_pairs", _sql("SELECT source_id, layer_version, ordinal, template_no, template, output FROM pairs", _PAIRS))
def template_pairs(spark, folder):
    return dataset.build_pairs(_chunks(spark, folder), fmt="alpaca").select("source_id", "layer_version", "ordinal", "template_no", "template", "output")


@query("DST2_alpaca_records", _sql("SELECT instruction, input, output FROM pairs WHERE layer_version = 1", _PAIRS))
def alpaca(spark, folder):
    return dataset.build_pairs(chunking.chunk_documents(I.documents(spark, folder), layer_version=1), fmt="alpaca").select("instruction", "input", "output")


@query("DST3_chat_records", _sql(
    "SELECT source_id, ordinal, template, 'system' AS r0, 'S' AS m0, 'user' AS r1, instruction || chr(10) || chr(10) || 'Fossil:' || chr(10) || input AS m1, 'assistant' AS r2, output AS m2 FROM pairs WHERE layer_version = 1", _PAIRS))
def chat(spark, folder):
    pairs = dataset.build_pairs(chunking.chunk_documents(I.documents(spark, folder), layer_version=1), fmt="chat", system_prompt="S")
    turns = [c for at in range(3) for c in (F.col("messages")[at]["role"].alias(f"r{at}"), F.col("messages")[at]["content"].alias(f"m{at}"))]
    return pairs.select("source_id", "ordinal", "template", *turns)


@query("DST4_latest_layer_pairs", _sql("SELECT source_id, layer_version, ordinal, template, output FROM pairs JOIN chunks_latest ON sid = source_id AND latest = layer_version WHERE template = 'qa'", _PAIRS, _LATEST))
def latest_pairs(spark, folder):
    newest = layers.latest_layer(_chunks(spark, folder))
    return dataset.build_pairs(newest, fmt="alpaca", templates=["qa"]).select("source_id", "layer_version", "ordinal", "template", "output")


# --- markers --------------------------------------------------------------------------------------


def _found(spark, folder, family):
    found = I.log_lines(spark, folder).select("source_id", F.posexplode(markers.FAMILIES[family](F.col("text"))).alias("at", "m"))
    return found.select("source_id", (F.col("at") + 1).cast("long").alias("pos"), "m.kind", "m.text", "m.value")


def _family(name: str, family: str, number: int) -> None:
    sql = with_sql(*I.MARKERS_SQL, select=f"SELECT source_id, pos, kind, text, value FROM everything WHERE fam = {number}")
    query(name, sql)(lambda spark, folder: _found(spark, folder, family))


for _name, _key, _number in (
    ("ENR1_iso_dates", "iso_date", 1), ("ENR2_slash_dates", "slash_date", 2), ("ENR3_unit_metrics", "unit_metric", 3),
    ("ENR4_key_metrics", "key_metric", 4), ("ENR5_error_codes", "error_code", 5), ("ENR6_http_statuses", "http_status", 6),
    ("ENR7_exceptions", "exception", 7),
):
    _family(_name, _key, _number)


@query("ENR8_distinct_markers", with_sql(
    *I.MARKERS_SQL, select="SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY fam, pos) AS place, kind, text, value FROM kept"))
def distinct_markers(spark, folder):
    found = I.log_lines(spark, folder).select("source_id", F.posexplode(markers.extract_markers(F.col("text"))).alias("at", "m"))
    return found.select("source_id", (F.col("at") + 1).cast("long").alias("place"), "m.kind", "m.text", "m.value")


@query("ENR9_marker_counts", with_sql(*I.MARKERS_SQL, select="SELECT source_id, kind, count(*)::INTEGER AS n FROM kept GROUP BY 1, 2"))
def marker_counts(spark, folder):
    counted = I.log_lines(spark, folder).withColumn("markers", markers.extract_markers(F.col("text")))
    return counted.select("source_id", F.explode(markers.marker_counts(F.col("markers"))).alias("kind", "n"))


def _marker_records(spark, folder, version):
    lines = I.log_lines(spark, folder)
    found = lines.withColumn("markers", markers.extract_markers(F.col("text")))
    return found.select(
        "source_id", F.lit(version).alias("layer_version"), ids.doc_id(F.col("source_id"), F.col("text")).alias("doc_id"), "markers",
        markers.marker_counts(F.col("markers")).alias("counts"), F.lit("2024-02-01").cast("timestamp").alias("created_at"), "event_id")


@query("ENR10_stored_markers", with_sql(
    *I.MARKERS_SQL, select="SELECT source_id, sha256(source_id || chr(0) || any_value(l)) AS doc_id, count(*)::INTEGER AS markers FROM (SELECT k.*, logs.text AS l FROM kept k JOIN logs USING (source_id)) GROUP BY 1"))
def stored_markers(spark, folder):
    """Markers of two layers are stored twice over; layer 1 is read back."""
    stored = sinks.marker_table(spark, scratch_path(spark, "markers"), buckets=8)
    for version in (1, 2, 1):
        stored.upsert(_marker_records(spark, folder, version))
    return stored.read().filter("layer_version = 1").select("source_id", "doc_id", F.size("markers").alias("markers"))


@query("SNK7_marker_upsert", with_sql(
    *I.MARKERS_SQL, select="SELECT source_id, layer_version, kind, n FROM (SELECT source_id, kind, count(*)::INTEGER AS n FROM kept GROUP BY 1, 2), (SELECT unnest([1, 2])::INTEGER AS layer_version)"))
def marker_upsert(spark, folder):
    stored = sinks.marker_table(spark, scratch_path(spark, "markers"), buckets=8)
    both = _marker_records(spark, folder, 1).unionByName(_marker_records(spark, folder, 2))
    stored.upsert(both.withColumn("counts", F.create_map(F.lit("stale"), F.lit(0))))
    stored.upsert(both)
    return stored.read().select("source_id", "layer_version", F.explode("counts").alias("kind", "n"))


# --- queue messages -------------------------------------------------------------------------------

_PARSED = (
    "parsed AS (SELECT message_id, attempt, body, 'task' AS parsed, 'raw' AS bucket, 'in/doc-' || number || '.txt' AS key FROM messages WHERE number % 9 IN (0, 1, 2, 5) "
    "UNION ALL SELECT message_id, attempt, body, 'task', 'raw', 'in/doc-' || number || '.txt.copy' FROM messages WHERE number % 9 = 2 "
    "UNION ALL SELECT message_id, attempt, body, 'task', 'raw', 'my report final-' || number || '.txt' FROM messages WHERE number % 9 = 3 "
    "UNION ALL SELECT message_id, attempt, body, 'nothing', NULL, NULL FROM messages WHERE number % 9 = 4 "
    "UNION ALL SELECT message_id, attempt, body, 'dead', NULL, NULL FROM messages WHERE number % 9 IN (6, 7, 8))"
)


@query("STR1_parsed_messages", with_sql(I.MESSAGES_SQL, _PARSED, select="SELECT message_id, parsed, bucket, key FROM parsed"))
def parsed_messages(spark, folder):
    return messages.parse_messages(I.queue_messages(spark, folder)).select("message_id", "parsed", "bucket", "key")


_FAILED = "failed AS (SELECT message_id FROM parsed WHERE parsed = 'dead' OR key LIKE '%.copy' OR key LIKE '%report%' GROUP BY 1)"


# Bodies in these two queries are longer than any log line.
_TAIL = " " * 600


def _split(spark, folder):
    queue = I.queue_messages(spark, folder).drop("number").withColumn("body", F.concat("body", F.lit(_TAIL)))
    parsed = messages.parse_messages(queue)
    lost = F.col("key").endswith(".copy") | F.col("key").contains("report")
    outcomes = metrics.message_outcomes(parsed.select("message_id", F.coalesce((F.col("parsed") == "dead") | lost, F.lit(False)).alias("failed")))
    return ingest.split_failures(queue, outcomes.filter("failed"))


@query("STR4_retried_messages", with_sql(I.MESSAGES_SQL, _PARSED, _FAILED, select="SELECT message_id, body || repeat(' ', 600) AS body, attempt + 1 AS attempt FROM messages JOIN failed USING (message_id) WHERE attempt < 5"))
def retried(spark, folder):
    return _split(spark, folder)[0]


@query("STR5_dead_letters", with_sql(I.MESSAGES_SQL, _PARSED, _FAILED, select="SELECT message_id, body || repeat(' ', 600) AS body, attempt FROM messages JOIN failed USING (message_id) WHERE attempt >= 5"))
def dead_letters(spark, folder):
    return _split(spark, folder)[1]
