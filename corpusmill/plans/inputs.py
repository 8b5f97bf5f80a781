"""Inputs derived from the given tables, once as DataFrames and once as the same SQL.

The tables hold clean, single-version prose and no markers or metric records. Noise, layers, log
lines, metrics and messages are therefore computed from whole columns of them, never at random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import ids, text
from corpusmill.functions.text import let
from corpusmill.plans.base import table
from corpusmill.session import spread

# --- SQL twins of the text functions ------------------------------------------------------------

NL = "chr(10)"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"


def sql_unify(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def sql_clean(x: str) -> str:
    visible = rf"regexp_replace({sql_unify(x)}, '[^\PC\n\t]', '', 'g')"
    spaced = rf"regexp_replace(nfc_normalize({visible}), '[ \t]+', ' ', 'g')"
    lines = rf"regexp_replace({spaced}, '(?m)^[ \t]+|[ \t]+$', '', 'g')"
    return sql_strip(rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_paragraphs(x: str) -> str:
    parts = rf"regexp_split_to_array({x}, '\n[ \t]*\n+')"
    return f"list_filter(list_transform({parts}, lambda p: {sql_strip('p')}), lambda p: p <> '')"


def sql_sentences(x: str) -> str:
    marked = rf"""regexp_replace({sql_strip(x)}, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def sql_segments(x: str) -> str:
    return f"flatten(list_transform({sql_paragraphs(x)}, lambda p: {sql_sentences('p')}))"


def sql_tokens(x: str) -> str:
    return f"((length({x}) + 3) // 4)::INTEGER"


def sql_half(x: str) -> str:
    parts = sql_sentences(x)
    return f"CASE WHEN len({parts}) > 0 THEN array_to_string(({parts})[1:greatest(1, len({parts}) // 2)], ' ') ELSE {x} END"


def sql_era(v: str) -> str:
    names = ", ".join(f"'{name}'" for name in ids.ERAS)
    return f"([{names}])[least(greatest({v}, 1), {len(ids.ERAS)})]"


def sql_doc_id(filename: str, body: str) -> str:
    return f"sha256({filename} || chr(0) || {body})"


# --- documents ------------------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` (hash), ``source_id``, ``filename``, ``text`` and the row's ``number``."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    raw = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return raw.select(
        ids.doc_id(name, F.col("text")).alias("doc_id"), name.alias("source_id"), name.alias("filename"), "text",
        "lang", "source", F.col("doc_id").alias("number"),
    )


DOCS_SQL = (
    "docs AS (SELECT sha256('doc-' || doc_id || '.txt' || chr(0) || text) AS doc_id, 'doc-' || doc_id || '.txt' AS source_id, "
    "'doc-' || doc_id || '.txt' AS filename, text, lang, source, doc_id AS number FROM documents)"
)


def noisy(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with tabs, runs of spaces, three newline styles, blank lines, a soft hyphen and a
    decomposed accent worked in."""
    broken = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(",  \t ")), F.lit(". "), F.lit(".\r\n \t\r\n\r\n"))
    tail = F.lit("\r\n\r\n\r\ne­́ end.\r tail  ")
    return documents(spark, folder).withColumn("text", F.concat(F.lit("\t  "), broken, tail))


NOISY_SQL = (
    "noisy AS (SELECT * REPLACE (chr(9) || '  ' || replace(replace(text, ', ', ',  ' || chr(9) || ' '), '. ', '.' || chr(13) || chr(10) "
    "|| ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10)) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) "
    "|| 'e' || chr(173) || chr(769) || ' end.' || chr(13) || ' tail  ' AS text) FROM docs)"
)


def layered(spark: SparkSession, folder: str) -> DataFrame:
    """Three versions of every document: the text; every fifth sentence dropped and one added; the
    extractive edit of that."""
    docs = documents(spark, folder)

    def second(parts):
        kept = F.filter(parts, lambda s, i: (i + 1) % 5 != 0)
        return F.array_join(F.array_append(kept, F.lit("Added in version two.")), " ")

    v2 = let(text.sentences(F.col("text")), second)
    versions = let(v2, lambda body: F.array(F.col("text"), body, text.keep_first_half(body)))
    exploded = docs.select("source_id", "filename", F.posexplode(versions).alias("at", "text"))
    return exploded.select(
        ids.doc_id(F.col("filename"), F.col("text")).alias("doc_id"), "source_id", "filename", "text",
        (F.col("at") + 1).cast("int").alias("layer_version"),
    )


LAYERED_SQL = [
    DOCS_SQL,
    f"v2 AS (SELECT source_id, text AS text1, array_to_string(list_append(list_filter({sql_sentences('text')}, "
    "lambda s, i: i % 5 <> 0), 'Added in version two.'), ' ') AS text2 FROM docs)",
    f"v3 AS (SELECT source_id, text1, text2, {sql_half('text2')} AS text3 FROM v2)",
    "layered AS (SELECT sha256(source_id || chr(0) || text) AS doc_id, source_id, source_id AS filename, text, layer_version FROM ("
    "SELECT source_id, text1 AS text, 1 AS layer_version FROM v3 UNION ALL SELECT source_id, text2, 2 FROM v3 "
    "UNION ALL SELECT source_id, text3, 3 FROM v3))",
]


def sql_chunks(source: str, max_tokens: int = 256, overlap: int = 32, prefix: str = "") -> list[str]:
    """CTEs from a document relation (doc_id, source_id, filename, text, layer_version) to ``chunks``.

    Pointer jumping over prefix sums: from (first, next) to the end of the chunk, and on.
    """
    p = prefix
    overlap = min(overlap, max(0, max_tokens - 1))
    reopened = (
        f"least(greatest(len(list_filter(sums, lambda x: x < sums[stop + 1] - {overlap})), first), stop - 1)" if overlap else "stop"
    )
    fits = f"greatest(len(list_filter(sums, lambda x: x <= sums[%s + 1] + {max_tokens})) - 1, %s + 1)"
    return [
        f"{p}parts AS (SELECT doc_id, source_id, filename, layer_version, {sql_segments(sql_clean('text'))} AS segs FROM {source})",
        f"{p}sized AS (SELECT *, list_transform(segs, lambda s: {sql_tokens('s')}) AS toks FROM {p}parts WHERE len(segs) > 0)",
        f"{p}summed AS (SELECT doc_id, source_id, filename, layer_version, segs, list_prepend(0, list_transform("
        f"range(1, len(toks) + 1), lambda i: list_sum(toks[1:i])::BIGINT)) AS sums FROM {p}sized)",
        f"{p}jump AS (SELECT doc_id, layer_version, source_id, 0::BIGINT AS ordinal, 0::BIGINT AS first, "
        f"{fits % ('0', '0')} AS stop, sums FROM {p}summed UNION ALL "
        f"SELECT doc_id, layer_version, source_id, ordinal + 1, {reopened}, "
        f"{fits % (reopened, 'stop')}, sums FROM {p}jump WHERE stop < len(sums) - 1)",
        f"{p}chunks AS (SELECT sha256(j.doc_id || chr(0) || j.ordinal || chr(0) || array_to_string(s.segs[j.first + 1:j.stop], ' ')) AS chunk_id, "
        f"j.doc_id, j.source_id, j.ordinal::INTEGER AS ordinal, array_to_string(s.segs[j.first + 1:j.stop], ' ') AS content, "
        f"length(array_to_string(s.segs[j.first + 1:j.stop], ' '))::INTEGER AS char_count, j.layer_version::INTEGER AS layer_version, "
        f"{sql_era('j.layer_version')} AS geological_age, s.filename FROM {p}jump j JOIN {p}summed s ON j.doc_id = s.doc_id "
        f"AND j.layer_version = s.layer_version AND j.source_id = s.source_id)",
    ]


LAYER_CHUNKS_SQL = [*LAYERED_SQL, *sql_chunks("layered")]

# --- log lines ------------------------------------------------------------------------------------


#: Lines that a task gets; markers take some 0.15 ms a line.
LINES_PER_TASK = 100_000


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A report line per event, with every family of markers in it."""
    n = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat(
        day, F.lit(" ERROR: request to /api failed with HTTP "), (500 + n % 5).cast("string"), F.lit(" after "),
        (n * 7 % 5000).cast("string"), F.lit("ms; retries="), (n % 4).cast("string"), F.lit("; error_rate: "),
        F.round(F.col("value"), 2).cast("decimal(12,2)").cast("string"), F.lit("% on "), F.date_format("ts", "d/M/yyyy"),
        F.lit(". Raised "), F.element_at(F.array(F.lit("Connection"), F.lit("Timeout"), F.lit("Value")), (n % 3 + 1).cast("int")),
        F.lit("Error with "), (n % 9 + 1).cast("string"), F.lit(" errors. See ERR-"), (1000 + n % 997).cast("string"),
        F.lit(" and E"), (100 + n % 50).cast("string"), F.lit(". status "), (400 + n % 5).cast("string"),
        F.lit(" again HTTP "), (500 + n % 5).cast("string"), F.lit(" on "), day,
    )
    events = table(spark, folder, "events")
    return spread(events.select("event_id", "ts", "value"), LINES_PER_TASK).select(n.cast("string").alias("source_id"), line.alias("text"), n.alias("event_id"))


LOG_SQL = (
    "logs AS (SELECT event_id::VARCHAR AS source_id, event_id, strftime(ts, '%Y-%m-%d') || ' ERROR: request to /api failed with HTTP ' || (500 + event_id % 5) "
    "|| ' after ' || (event_id * 7 % 5000) || 'ms; retries=' || (event_id % 4) || '; error_rate: ' || round(value, 2)::DECIMAL(12,2) || '% on ' "
    "|| day(ts) || '/' || month(ts) || '/' || year(ts) || '. Raised ' || (['Connection','Timeout','Value'])[event_id % 3 + 1] || 'Error with ' "
    "|| (event_id % 9 + 1) || ' errors. See ERR-' || (1000 + event_id % 997) || ' and E' || (100 + event_id % 50) || '. status ' || (400 + event_id % 5) "
    "|| ' again HTTP ' || (500 + event_id % 5) || ' on ' || strftime(ts, '%Y-%m-%d') AS text FROM events)"
)

# The patterns of functions/markers.py as DuckDB can read them. DuckDB has no look-around, so the number of a unit metric is found with the
# character before it, and the unit with the one after it.
_UNIT = r"(?:(?:ms|s|secs?|mins?|hrs?|GB|MB|KB|TB|rps|req/s|bytes?|errors?|requests?)\b|%)"
MARKERS_SQL = [
    LOG_SQL,
    r"iso AS (SELECT source_id, 1 AS fam, 'date' AS kind, unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b')) AS text, generate_subscripts(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'), 1) AS pos FROM logs)",
    r"slash AS (SELECT source_id, 2 AS fam, 'date' AS kind, unnest(regexp_extract_all(text, '\b\d{1,2}/\d{1,2}/\d{2,4}\b')) AS text, generate_subscripts(regexp_extract_all(text, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), 1) AS pos FROM logs)",
    rf"unit AS (SELECT source_id, 3 AS fam, 'metric' AS kind, unnest(regexp_extract_all(text, '(?i)(?:^|[^\w/\-])(\d[\d,]*(?:\.\d+)?\s?{_UNIT})', 1)) AS text, generate_subscripts(regexp_extract_all(text, '(?i)(?:^|[^\w/\-])(\d[\d,]*(?:\.\d+)?\s?{_UNIT})', 1), 1) AS pos FROM logs)",
    r"kvs AS (SELECT source_id, 4 AS fam, 'metric' AS kind, unnest(list_transform(list_zip(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*(\d[\d,]*(?:\.\d+)?)\b', 1), regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*(\d[\d,]*(?:\.\d+)?)\b', 2)), lambda z: z[1] || '=' || z[2])) AS text, generate_subscripts(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*(\d[\d,]*(?:\.\d+)?)\b', 1), 1) AS pos FROM logs)",
    r"codes AS (SELECT source_id, 5 AS fam, 'error_code' AS kind, unnest(regexp_extract_all(text, '\b(?:ERR(?:OR)?[-_]?\d{2,}|E\d{3,})\b')) AS text, generate_subscripts(regexp_extract_all(text, '\b(?:ERR(?:OR)?[-_]?\d{2,}|E\d{3,})\b'), 1) AS pos FROM logs)",
    r"https AS (SELECT source_id, 6 AS fam, 'error_code' AS kind, unnest(regexp_extract_all(text, '(?i)\b(?:HTTP|status)\s?[1-5]\d{2}\b')) AS text, generate_subscripts(regexp_extract_all(text, '(?i)\b(?:HTTP|status)\s?[1-5]\d{2}\b'), 1) AS pos FROM logs)",
    r"excs AS (SELECT source_id, 7 AS fam, 'error_code' AS kind, unnest(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]*(?:Error|Exception)\b')) AS text, generate_subscripts(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9]*(?:Error|Exception)\b'), 1) AS pos FROM logs)",
    "everything AS (SELECT *, CASE fam WHEN 1 THEN text WHEN 3 THEN regexp_extract(text, '^\\d[\\d,]*(?:\\.\\d+)?') WHEN 4 THEN split_part(text, '=', 2) "
    "WHEN 6 THEN regexp_extract(text, '\\d{3}$') END AS value FROM (SELECT * FROM iso UNION ALL SELECT * FROM slash UNION ALL SELECT * FROM unit "
    "UNION ALL SELECT * FROM kvs UNION ALL SELECT * FROM codes UNION ALL SELECT * FROM https UNION ALL SELECT * FROM excs))",
    "kept AS (SELECT * FROM everything QUALIFY row_number() OVER (PARTITION BY source_id, kind, text ORDER BY fam, pos) = 1)",
]

# --- metric records -------------------------------------------------------------------------------


def metric_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as metric records: stage = type, latency = value; the number in ``props`` decides
    whether a record is a stage's or a whole run's, and whether it failed."""
    k = F.get_json_object("props", "$.k").cast("int")
    event = F.when(k % 10 == 0, "pipeline_failed").when(k % 3 == 0, "pipeline_done").otherwise("stage_done")
    done = event == "pipeline_done"
    return table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), event.alias("event"),
        F.when(event == "stage_done", F.col("event_type")).otherwise("summary").alias("stage"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("request_id"), F.col("value").alias("latency"),
        F.when((event == "stage_done") & ((F.col("event_type") == "error") | (k % 7 == 0)), 1).otherwise(0).alias("errors"),
        F.when(done, F.when(k > 90, 0.0).otherwise(F.col("user_id").cast("double"))).alias("rows_ingested"),
        F.when(done, F.when(k > 90, 0.0).otherwise(k.cast("double"))).alias("rows_dropped"),
        "event_id",
    )


METRICS_SQL = (
    "records AS (SELECT ts, event, CASE WHEN event = 'stage_done' THEN event_type ELSE 'summary' END AS stage, 'r' || user_id AS request_id, "
    "value AS latency, CASE WHEN event = 'stage_done' AND (event_type = 'error' OR k % 7 = 0) THEN 1 ELSE 0 END AS errors, "
    "CASE WHEN event = 'pipeline_done' THEN CASE WHEN k > 90 THEN 0.0 ELSE user_id::DOUBLE END END AS rows_ingested, "
    "CASE WHEN event = 'pipeline_done' THEN CASE WHEN k > 90 THEN 0.0 ELSE k::DOUBLE END END AS rows_dropped, event_id FROM "
    "(SELECT *, CASE WHEN k % 10 = 0 THEN 'pipeline_failed' WHEN k % 3 = 0 THEN 'pipeline_done' ELSE 'stage_done' END AS event FROM "
    "(SELECT *, (props->>'$.k')::INTEGER AS k FROM events)))"
)

# --- queue messages -------------------------------------------------------------------------------


def queue_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One message per document, in nine body shapes in turn."""
    n = F.col("doc_id")
    key = F.concat(F.lit("in/doc-"), n.cast("string"), F.lit(".txt"))

    def record(name):
        return F.concat(F.lit('{"s3":{"bucket":{"name":"raw"},"object":{"key":"'), name, F.lit('"}}}'))

    def records(*items):
        return F.concat(F.lit('{"Records":['), *[part for at, item in enumerate(items) for part in ((F.lit(","), item) if at else (item,))], F.lit("]}"))

    shapes = [
        F.concat(F.lit('{"bucket":"raw","key":"'), key, F.lit('"}')),
        records(record(key)),
        records(record(key), record(F.concat(key, F.lit(".copy")))),
        records(record(F.concat(F.lit("my+report%20final-"), n.cast("string"), F.lit(".txt")))),
        F.lit('{"Service":"Amazon S3","Event":"s3:TestEvent"}'),
        records(F.lit('{"nope":1}'), record(key)),
        F.lit('{"unexpected":true}'),
        F.lit('["a","b"]'),
        F.concat(F.lit("{not json "), n.cast("string")),
    ]
    return table(spark, folder, "documents").select(
        F.concat(F.lit("m"), n.cast("string")).alias("message_id"),
        F.element_at(F.array(*shapes), (n % 9 + 1).cast("int")).alias("body"),
        (n % 6 + 1).cast("int").alias("attempt"), n.alias("number"),
    )


_REC = """'{"s3":{"bucket":{"name":"raw"},"object":{"key":"' || %s || '"}}}'"""
MESSAGES_SQL = (
    "keyed AS (SELECT doc_id AS number, 'm' || doc_id AS message_id, 'in/doc-' || doc_id || '.txt' AS k, (doc_id % 6 + 1)::INTEGER AS attempt FROM documents), "
    "messages AS (SELECT number, message_id, attempt, CASE number % 9 "
    "WHEN 0 THEN '{\"bucket\":\"raw\",\"key\":\"' || k || '\"}' "
    f"WHEN 1 THEN '{{\"Records\":[' || {_REC % 'k'} || ']}}' "
    f"WHEN 2 THEN '{{\"Records\":[' || {_REC % 'k'} || ',' || {_REC % '''k || '.copy' '''} || ']}}' "
    f"WHEN 3 THEN '{{\"Records\":[' || {_REC % '''('my+report%20final-' || number || '.txt')'''} || ']}}' "
    "WHEN 4 THEN '{\"Service\":\"Amazon S3\",\"Event\":\"s3:TestEvent\"}' "
    f"WHEN 5 THEN '{{\"Records\":[{{\"nope\":1}},' || {_REC % 'k'} || ']}}' "
    "WHEN 6 THEN '{\"unexpected\":true}' WHEN 7 THEN '[\"a\",\"b\"]' ELSE '{not json ' || number END AS body FROM keyed)"
)
