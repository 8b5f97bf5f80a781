"""Queries over text: scans, cleaning, identity, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import ids, text
from corpusmill.operators import chunking, contract, search, upsert
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, shown, sql_shown, table, with_sql
from corpusmill.session import scratch_path
from corpusmill.sources import scans, sinks


@query("SRC1_parquet_scan", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def parquet_scan(spark, folder):
    return scans.read_parquet_if_present(spark, f"{folder}/documents.parquet").select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "SRC2_merged_schema_scan",
    "SELECT p_partkey, p_name, p_brand, p_size FROM part UNION ALL SELECT p_partkey + 1000000000, p_name, NULL, p_size FROM part",
)
def merged_scan(spark, folder):
    part = table(spark, folder, "part")
    root = scratch_path(spark, "merged")
    part.select("p_partkey", "p_name", "p_brand", "p_size").write.parquet(f"{root}/v=2")
    part.select((F.col("p_partkey") + 1000000000).alias("p_partkey"), "p_name", "p_size").write.parquet(f"{root}/v=1")
    return scans.read_merged_parquet(spark, f"{root}/v=1", f"{root}/v=2").select("p_partkey", "p_name", "p_brand", "p_size")


def _specimen_rows(spark, folder):
    """Parts as CSV records, some with a null word or padding in the name and some without an age."""
    n = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.when(n % 7 == 0, "N/A").when(n % 11 == 0, "   ").when(n % 13 == 0, F.concat(F.lit('say "'), F.upper("p_name"), F.lit('"')))
        .when(n % 17 == 0, F.concat(F.lit("one,\n"), F.upper("p_name"), F.lit("\nthree")))
        .otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("Species"),
        F.when(n % 5 != 0, F.col("p_retailprice")).alias("Age_MYA"),
    )


_SPECIMEN_SQL = (
    "specimens AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '   ' WHEN p_partkey % 13 = 0 THEN 'say ' || chr(34) || upper(p_name) || chr(34) WHEN p_partkey % 17 = 0 THEN 'one,' || chr(10) || upper(p_name) || chr(10) || 'three' ELSE '  ' || upper(p_name) || ' ' END AS species, "
    "CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS age_mya FROM part)"
)


def _specimen_csv(spark, folder):
    path = scratch_path(spark, "csv")
    _specimen_rows(spark, folder).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    return scans.read_csv(spark, path)


@query("SRC3_csv_scan", with_sql(_SPECIMEN_SQL, select='SELECT species AS "Species", age_mya AS "Age_MYA" FROM specimens'))
def csv_scan(spark, folder):
    return _specimen_csv(spark, folder)


@query("SRC4_raw_document_scan", with_sql(
    I.DOCS_SQL,
    select="SELECT sha256(filename || chr(0) || text || chr(10)) AS doc_id, filename, (length(text) + 1)::INTEGER AS char_count, (octet_length(encode(text)) + 4)::VARCHAR AS bytes, 'txt' AS extractor FROM docs",
))
def raw_scan(spark, folder):
    """Documents written as one marked file each (a final line break comes with it), found and read as raw files."""
    docs = I.documents(spark, folder)
    path = scratch_path(spark, "raw")
    sinks.write_raw_files(docs.select("filename", F.concat(F.lit("\ufeff"), "text").alias("value")), path)
    raw = scans.read_raw_files(spark, path, "*.txt").withColumn("filename", sinks.raw_name(F.col("path")))
    silver, _ = scans.extract_documents(raw, filename=F.col("filename"), content_type=F.lit("text/plain; charset=utf-8"))
    return silver.select(
        "doc_id", "filename", "char_count", F.col("metadata")["bytes"].alias("bytes"), F.col("metadata")["extractor"].alias("extractor")
    )


@query("SRC5_json_lines_scan", "SELECT conv_id, turn, role, text FROM conversations")
def json_scan(spark, folder):
    path = scratch_path(spark, "jsonl")
    turns = table(spark, folder, "conversations")
    line = F.explode(F.array(F.to_json(F.struct(*turns.columns)), F.lit(""))).alias("value")
    turns.select(line).write.text(path)
    return scans.read_json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("SRC6_metric_log_scan", with_sql(
    I.METRICS_SQL,
    select=f"SELECT {sql_shown('ts')} AS at, event, stage, request_id, latency, errors, rows_ingested, rows_dropped FROM records",
))
def metric_log_scan(spark, folder):
    path = scratch_path(spark, "emf")
    sinks.write_metric_log(_metric_lines(I.metric_records(spark, folder)), path)
    return scans.read_metric_log(spark, path).withColumn("at", shown("ts")).drop("ts").select(
        "at", "event", "stage", "request_id", "latency", "errors", "rows_ingested", "rows_dropped"
    )


def _metric_lines(records):
    named = records.withColumnsRenamed({
        "stage": "Stage", "latency": "Latency", "errors": "Errors", "rows_ingested": "RowsIngested", "rows_dropped": "RowsDropped",
    })
    return sinks.metric_lines(
        named, namespace="Corpus/Pipeline", dimensions=["Stage"], properties=["event", "request_id"],
        metrics={"Latency": "Milliseconds", "Errors": "Count", "RowsIngested": "Count", "RowsDropped": "Count"},
    )


@query("SRC7_embedding_scan", "SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def embedding_scan(spark, folder):
    vectors = scans.read_vectors(spark, f"{folder}/embeddings.parquet")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query("SNK1_overwrite_parquet", "SELECT r_regionkey, r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def overwrite(spark, folder):
    path = scratch_path(spark, "overwrite")
    joined = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    out = joined.select("r_regionkey", "r_name", "n_name")
    for _ in range(2):
        sinks.overwrite_parquet(out, path)
    return spark.read.parquet(path)


@query("SNK2_gold_layers", with_sql(
    *I.LAYER_CHUNKS_SQL, recursive=True,
    select=f"SELECT chunk_id, source_id, ordinal, layer_version, '{{\"filename\":\"' || filename || '\",\"tokens_est\":\"' || {I.sql_tokens('content')} || '\"}}' AS metadata FROM chunks",
))
def gold_layers(spark, folder):
    path = scratch_path(spark, "gold")
    chunks = chunking.chunk_documents(I.layered(spark, folder), ingested_at=F.lit("2024-01-01").cast("timestamp"))
    sinks.write_gold(chunks, path)
    sinks.write_gold(spark.read.schema(chunks.schema).parquet(path).filter("false").unionByName(
        chunks.filter("layer_version = 3")), path)
    return spark.read.parquet(path).select(
        "chunk_id", "source_id", "ordinal", F.col("layer_version").cast("int").alias("layer_version"), "metadata"
    )


@query("SNK3_silver_documents", with_sql(I.DOCS_SQL, select="SELECT doc_id, source_id, length(text)::INTEGER AS char_count FROM docs"))
def silver_documents(spark, folder):
    silver_table = sinks.silver_table(spark, scratch_path(spark, "silver"), buckets=8)
    raw = I.documents(spark, folder).select("filename", F.encode("text", "UTF-8").alias("content"))
    silver, _ = scans.extract_documents(
        raw, filename=F.col("filename"), content_type=F.lit(""), uploaded_at=F.lit("2024-01-01").cast("timestamp")
    )
    for _ in range(2):
        silver_table.upsert(silver)
    return silver_table.read().select("doc_id", "source_id", "char_count")


@query("SNK9_dataset_lines", with_sql(
    *I.LAYER_CHUNKS_SQL, recursive=True,
    select="SELECT '{\"instruction\":\"From which geological age is this fossil layer?\",\"input\":' || to_json(content)::VARCHAR || ',\"output\":\"' "
    "|| geological_age || '\"}' AS line FROM chunks WHERE layer_version = 1",
))
def dataset_lines(spark, folder):
    from corpusmill.operators.dataset import build_pairs

    path = scratch_path(spark, "dataset")
    chunks = chunking.chunk_documents(I.documents(spark, folder), layer_version=1)
    pairs = build_pairs(chunks, fmt="alpaca", templates=["age"])
    sinks.write_json_lines(pairs.select("instruction", "input", "output"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SNK10_metric_lines", with_sql(
    I.METRICS_SQL,
    select="SELECT request_id, Stage AS stage, 'Corpus/Pipeline' AS namespace, 'Stage' AS dimension, 4::BIGINT AS metrics, count(*) AS lines FROM records GROUP BY ALL",
))
def metric_lines(spark, folder):
    path = scratch_path(spark, "emf")
    sinks.write_metric_log(_metric_lines(I.metric_records(spark, folder)), path)
    lines = spark.read.text(path)
    part = lambda where: F.get_json_object("value", where)
    return lines.groupBy(
        part("$.request_id").alias("request_id"), part("$.Stage").alias("stage"),
        part("$._aws.CloudWatchMetrics[0].Namespace").alias("namespace"),
        part("$._aws.CloudWatchMetrics[0].Dimensions[0][0]").alias("dimension"),
        F.json_array_length(part("$._aws.CloudWatchMetrics[0].Metrics")).cast("long").alias("metrics"),
    ).agg(F.count("*").alias("lines"))


# --- cleaning -------------------------------------------------------------------------------------


@query("PRJ1_clean_text", with_sql(
    I.DOCS_SQL, I.NOISY_SQL, select=f"SELECT number, {I.sql_clean('text')} AS cleaned FROM noisy"))
def clean(spark, folder):
    return I.noisy(spark, folder).select("number", text.clean_text(F.col("text")).alias("cleaned"))


_BELLED = "replace(text, ' ', ' ' || chr(7) || ' ')"
_WITHOUT_CONTROLS = rf"regexp_replace({_BELLED}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


@query("PRJ2_clean_ascii_controls", with_sql(
    I.DOCS_SQL, I.NOISY_SQL,
    select="SELECT number, " + I.sql_strip(f"regexp_replace({I.sql_unify(_WITHOUT_CONTROLS)}, ' {{2,}}', ' ', 'g')") + " AS cleaned FROM noisy",
))
def clean_controls(spark, folder):
    belled = F.replace(F.col("text"), F.lit(" "), F.lit(" \x07 "))
    return I.noisy(spark, folder).select("number", text.clean_ascii_controls(belled).alias("cleaned"))


@query("PRJ3_unify_newlines", with_sql(
    I.DOCS_SQL, I.NOISY_SQL, select=f"SELECT number, sha256({I.sql_unify('text')}) AS unified FROM noisy"))
def newlines(spark, folder):
    return I.noisy(spark, folder).select("number", F.sha2(text.unify_newlines(F.col("text")), 256).alias("unified"))


_TYPES = "['text/plain; charset=utf-8', ' TEXT/Markdown ', 'application/octet-stream', '', 'image/png', 'application/pdf']"
_NAMES = "['.txt', '.MD', '.markdown', '.pdf', '.bin', '']"


@query("PRJ4_content_type", f"""
SELECT doc_id, filename, CASE WHEN header IN ('text/plain','text/markdown','application/pdf') THEN header
  WHEN header IN ('', 'application/octet-stream') THEN CASE lower(regexp_extract(filename, '(\\.[^.]*)$', 1))
    WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.markdown' THEN 'text/markdown' WHEN '.pdf' THEN 'application/pdf' END
  END AS content_type FROM (SELECT doc_id, 'f' || doc_id || ({_NAMES})[doc_id // 6 % 6 + 1] AS filename,
  lower(trim(split_part(({_TYPES})[doc_id % 6 + 1], ';', 1))) AS header FROM documents)""")
def content_types(spark, folder):
    n = F.col("doc_id")
    names = F.expr(f"array({_NAMES[1:-1]})")
    types = F.expr(f"array({_TYPES[1:-1]})")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("f"), n.cast("string"), F.element_at(names, (F.floor(n / 6) % 6 + 1).cast("int"))).alias("filename"),
        F.element_at(types, (n % 6 + 1).cast("int")).alias("given"),
    )
    return docs.select("doc_id", "filename", text.resolve_content_type(F.col("filename"), F.col("given")).alias("content_type"))


_KEPT = "species IS NOT NULL AND age_mya IS NOT NULL AND trim(species) <> ''"


@query("PRJ5_normalise_records", with_sql(_SPECIMEN_SQL, select=f"SELECT lower(trim(species)) AS species, age_mya FROM specimens WHERE {_KEPT}"))
def normalise(spark, folder):
    return contract.normalise_records(_specimen_csv(spark, folder))


@query("PRJ6_normalise_counts", with_sql(
    _SPECIMEN_SQL,
    select=f"SELECT count(*) FILTER (coalesce({_KEPT}, false)) AS rows_kept, count(*) FILTER (NOT coalesce({_KEPT}, false)) AS rows_dropped FROM specimens",
))
def normalise_counts(spark, folder):
    return contract.normalise_counts(_specimen_csv(spark, folder))


def _specimen_v1(spark, folder):
    n = F.col("p_partkey")
    return table(spark, folder, "part").select(
        n.cast("string").alias("specimen_id"), F.when(n % 3 != 0, F.col("p_name")).alias("species"),
        F.when(n % 4 != 0, F.col("p_retailprice")).alias("age_ma"), F.when(n % 5 != 0, F.col("p_brand")).alias("location"),
    )


_V1_SQL = (
    "v1 AS (SELECT p_partkey::VARCHAR AS specimen_id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS species, "
    "CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS age_ma, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS location FROM part)"
)
_FILLED = (
    "specimen_id, coalesce(species, 'unknown') AS species, coalesce(age_ma, 0.0) AS age_ma, coalesce(location, 'unknown') AS location, "
    "'unknown' AS discoverer, 'unknown' AS excavation_site, 'unknown' AS geological_period"
)


@query("PRJ7_required_columns", "SELECT count(*) AS rows, '[''species'']' AS missing FROM part")
def required_columns(spark, folder):
    part = table(spark, folder, "part")
    try:
        upsert.require_columns(part, ["p_name", "species"])
        refused = ""
    except ValueError as problem:
        refused = str(problem).rpartition(": ")[2]
    return part.agg(F.count("*").alias("rows")).withColumn("missing", F.lit(refused))


@query("PRJ8_contract_fill", with_sql(_V1_SQL, select=f"SELECT {_FILLED} FROM v1"))
def contract_fill(spark, folder):
    return contract.fill(_specimen_v1(spark, folder))


_V2_SQL = (
    "v2 AS (SELECT CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice::VARCHAR END AS age_ma FROM part), "
    "totals AS (SELECT count(*) AS n, count(p_size) AS sizes, count(age_ma) AS ages FROM v2)"
)


@query("PRJ9_drift_report", with_sql(_V2_SQL, select="""
SELECT 'new_field' AS kind, 'p_size' AS "column", NULL AS expected, 'int' AS actual, 'warn' AS action, sizes AS rows FROM totals
UNION ALL SELECT 'breaking_change', 'age_ma', 'double', 'string', 'fail', ages FROM totals
UNION ALL SELECT 'missing_field', f, 'string', NULL, 'default', n FROM totals,
  (SELECT unnest(['discoverer', 'excavation_site', 'geological_period', 'location']) AS f)"""))
def drift(spark, folder):
    n = F.col("p_partkey")
    part = table(spark, folder, "part").select(
        n.cast("string").alias("specimen_id"), F.col("p_name").alias("species"),
        F.when(n % 4 != 0, F.col("p_retailprice").cast("string")).alias("age_ma"), F.when(n % 3 != 0, F.col("p_size")).alias("p_size"),
    )
    return contract.drift_impact(part)


@query("PRJ11_enrich_specimens", with_sql(
    _V1_SQL, f"filled AS (SELECT {_FILLED} FROM v1)",
    select="SELECT specimen_id, upper(species) AS species_upper, age_ma, location, discoverer, excavation_site, geological_period FROM filled",
))
def enrich_specimens(spark, folder):
    return contract.enrich_specimens(contract.fill(contract.validate(_specimen_v1(spark, folder))))


# --- identity -------------------------------------------------------------------------------------


@query("PRJ14_document_ids", with_sql(I.DOCS_SQL, select="SELECT number, doc_id FROM docs"))
def document_ids(spark, folder):
    return I.documents(spark, folder).select("number", "doc_id")


@query("PRJ14_metadata_chunk_ids", """
SELECT doc_id, sha256(text || chr(9246) || '{' || concat_ws(',', CASE WHEN doc_id % 3 <> 0 THEN '"chunk_index":' || doc_id END,
  CASE WHEN doc_id % 2 = 0 THEN '"section":"Part \\"' || lang || '\\""' END, '"source":"' || source || '"') || '}') AS chunk_id FROM documents""")
def metadata_chunk_ids(spark, folder):
    n = F.col("doc_id")
    section = F.when(n % 2 == 0, F.concat(F.lit('Part "'), F.col("lang"), F.lit('"')))
    return table(spark, folder, "documents").select(
        "doc_id",
        ids.metadata_chunk_id(
            F.col("text"), source=F.col("source"), section=section, chunk_index=F.when(n % 3 != 0, n), strict=False).alias("chunk_id"),
    )


@query("PRJ15_era_labels", f"SELECT doc_id, {I.sql_era('(doc_id % 14 - 1)')} AS era FROM documents")
def eras(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ids.era(F.col("doc_id") % 14 - 1).alias("era"))


@query("PRJ16_token_estimates", "SELECT doc_id, ((length(text) + 3) // 4)::INTEGER AS tokens FROM documents")
def token_estimates(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("PRJ17_provenance_metadata", with_sql(
    I.DOCS_SQL, select="SELECT doc_id, 'md' AS extractor, octet_length(encode(text))::VARCHAR AS bytes, 'text/markdown' AS content_type FROM docs"))
def provenance_metadata(spark, folder):
    raw = I.documents(spark, folder).select("filename", F.encode("text", "UTF-8").alias("content"))
    silver, _ = scans.extract_documents(raw, filename=F.col("filename"), content_type=F.lit("text/markdown"))
    return silver.select("doc_id", F.col("metadata")["extractor"].alias("extractor"), F.col("metadata")["bytes"].alias("bytes"), "content_type")


@query("PRJ19_empty_documents", with_sql(
    I.DOCS_SQL,
    select="SELECT sha256(filename || chr(0)) AS doc_id, filename, 'txt' AS extractor FROM docs WHERE number % 10 = 0",
))
def empty_documents(spark, folder):
    body = F.when(F.col("number") % 10 == 0, F.lit("")).otherwise(F.col("text"))
    raw = I.documents(spark, folder).select("filename", F.encode(body, "UTF-8").alias("content"))
    silver, _ = scans.extract_documents(raw, filename=F.col("filename"), content_type=F.lit("text/plain"))
    return scans.empty_documents(silver)


# --- keyword search -------------------------------------------------------------------------------


@query("PRJ13_substring_search", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AN%' ORDER BY p_name, p_partkey LIMIT 100")
def substring(spark, folder):
    return search.substring_search(table(spark, folder, "part"), "p_name", "AN", 100, "p_partkey").select("p_partkey", "p_name")


@query("PRJ18_trigram_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%thing%' ORDER BY source, doc_id LIMIT 100")
def trigram(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    path, base = scratch_path(spark, "postings"), scratch_path(spark, "ranged")
    search.write_postings(search.trigram_postings(docs, "text", "doc_id"), path, "doc_id")
    search.write_ranged(docs, base, "doc_id")
    candidates = search.candidate_rows(spark.read.parquet(base), spark.read.parquet(path), "text", "thing", "doc_id")
    return candidates.orderBy("source", "doc_id").limit(100).select("doc_id", "source")


# --- chunking -------------------------------------------------------------------------------------


@query("CHK1_paragraphs", with_sql(
    I.DOCS_SQL, I.NOISY_SQL,
    select=f"SELECT number, unnest(p) AS paragraph, generate_subscripts(p, 1) AS pos FROM (SELECT number, {I.sql_paragraphs(I.sql_clean('text'))} AS p FROM noisy)",
))
def paragraphs(spark, folder):
    split = F.posexplode(text.paragraphs(text.clean_text(F.col("text")))).alias("at", "paragraph")
    return I.noisy(spark, folder).select("number", split).select("number", "paragraph", (F.col("at") + 1).cast("long").alias("pos"))


@query("CHK2_sentences", f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, {I.sql_sentences('text')} AS s FROM documents)")
def sentences(spark, folder):
    split = F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence")
    return table(spark, folder, "documents").select("doc_id", split).select("doc_id", "sentence", (F.col("at") + 1).cast("long").alias("pos"))


_ONE_LAYER = ["single AS (SELECT *, 1 AS layer_version FROM docs)"]
_NOISY_LAYER = ["single AS (SELECT *, 1 AS layer_version FROM noisy)"]


@query("CHK3_pack_small_chunks", with_sql(
    I.DOCS_SQL, *_ONE_LAYER, *I.sql_chunks("single", 64, 16), recursive=True, select="SELECT source_id, ordinal, char_count, content FROM chunks"))
def pack_small(spark, folder):
    chunks = chunking.chunk_documents(I.documents(spark, folder), layer_version=1, max_tokens=64, overlap_tokens=16)
    return chunks.select("source_id", "ordinal", "char_count", "content")


@query("CHK3_pack_without_overlap", with_sql(
    I.DOCS_SQL, *_ONE_LAYER, *I.sql_chunks("single", 100, 0), recursive=True, select="SELECT source_id, ordinal, char_count, content FROM chunks"))
def pack_plain(spark, folder):
    chunks = chunking.chunk_documents(I.documents(spark, folder), layer_version=1, max_tokens=100, overlap_tokens=0)
    return chunks.select("source_id", "ordinal", "char_count", "content")


@query("CHK4_chunk_documents", with_sql(
    I.DOCS_SQL, I.NOISY_SQL, *_NOISY_LAYER, *I.sql_chunks("single"), recursive=True,
    select=f"SELECT chunk_id, doc_id, source_id, ordinal, content, char_count, layer_version, geological_age, filename, {I.sql_tokens('content')}::VARCHAR AS tokens_est FROM chunks",
))
def chunk_noisy(spark, folder):
    chunks = chunking.chunk_documents(I.noisy(spark, folder), layer_version=1)
    return chunks.withColumns({
        "filename": F.col("metadata")["filename"], "tokens_est": F.col("metadata")["tokens_est"],
    }).drop("metadata", "ingested_at")


@query("CHK5_ordinals", with_sql(
    *I.LAYER_CHUNKS_SQL, recursive=True,
    select="SELECT source_id, layer_version, min(ordinal) AS low, max(ordinal) AS high, count(*) AS n FROM chunks GROUP BY ALL"))
def ordinals(spark, folder):
    chunks = chunking.chunk_documents(I.layered(spark, folder))
    return chunks.groupBy("source_id", "layer_version").agg(
        F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count("*").alias("n"))


@query("CHK6_first_sentences", f"SELECT doc_id, coalesce(({I.sql_sentences('text')})[1], {I.sql_strip('text')}) AS first_sentence FROM documents")
def first_sentences(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("first_sentence"))


_CORPUS = with_sql(
    I.DOCS_SQL, I.NOISY_SQL, *_NOISY_LAYER, *I.sql_chunks("single"), recursive=True,
    select=f"SELECT d.lang, count(DISTINCT c.doc_id) AS documents, count(*) AS chunks, sum(c.char_count)::BIGINT AS chars, "
    f"round(avg({I.sql_tokens('c.content')}), 6) AS mean_tokens, count(DISTINCT c.chunk_id) AS distinct_chunks FROM chunks c JOIN docs d ON c.source_id = d.source_id GROUP BY d.lang",
)


@query("corpus_by_language", _CORPUS)
def corpus_by_language(spark, folder):
    """Clean, chunk and identify the corpus, then count and average per language."""
    noisy = I.noisy(spark, folder)
    chunks = chunking.chunk_documents(noisy, layer_version=1)
    sized = chunks.select("chunk_id", "doc_id", "source_id", "char_count", text.estimate_tokens(F.col("content")).alias("tokens"))
    return sized.join(noisy.select("source_id", "lang"), "source_id").groupBy("lang").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("char_count").alias("chars"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.count_distinct("chunk_id").alias("distinct_chunks"),
    )
