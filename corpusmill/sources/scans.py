"""Readers for everything the pipelines take in."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill import schemas
from corpusmill.functions import ids, text
from corpusmill.session import path_exists

log = logging.getLogger("corpusmill.sources")

# The words a CSV reader takes for null.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_parquet_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None (and a log line) when nothing is there. Other read errors stay errors."""
    if not path_exists(spark, path):
        log.warning("nothing to read at %s", path)
        return None
    return spark.read.parquet(path)


def read_merged_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of the files' schemas, asked for per read because it opens every footer."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str = schemas.SPECIMEN_CSV) -> DataFrame:
    """CSV with a header, its null words mapped, then cast to ``schema``.

    Quotes within a quoted cell are doubled, and a quoted cell may hold line breaks, so a file is read by one
    task; write large tables as many files.
    """
    wanted = StructType.fromDDL(schema)
    as_text = StructType([StructField(field.name, StringType()) for field in wanted.fields])
    raw = spark.read.schema(as_text).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.select(*[
        F.when(~F.col(f.name).isin(*NULL_WORDS), F.col(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields
    ])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines give no row."""
    return spark.read.schema(schema).json(path)


#: Tasks per core that list folders, tasks per core that read raw files, and Spark's splits that such a task takes at most.
LISTING, READING, SPLITS = 8, 16, 64
_LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw documents: ``path, modificationTime, length, content``.

    Spark lists many folders in up to 10,000 tasks and reads a few small files a task; both are folded into fewer tasks.
    """
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get(_LISTING_KEY, None)
    spark.conf.set(_LISTING_KEY, str(min(int(before or 10_000), LISTING * cores)))
    try:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    finally:
        if before is None:
            spark.conf.unset(_LISTING_KEY)
        else:
            spark.conf.set(_LISTING_KEY, before)
    splits = raw.rdd.getNumPartitions()
    wanted = max(READING * cores, -(-splits // SPLITS))
    return raw.coalesce(wanted) if splits > wanted else raw


def extract_documents(raw: DataFrame, *, filename: Column, content_type: Column, source_id: Column | None = None,
                      user_id: Column | None = None, source_uri: Column | None = None,
                      uploaded_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(silver documents, rejected rows) from rows with a binary ``content``.

    Text and markdown are decoded. Other types, supported by name or not, are rejected with a
    ``reason``. Documents of no text are kept; see :func:`empty_documents`.
    """
    missing = F.lit(None).cast("string")
    named = raw.withColumns({
        "source_uri": missing if source_uri is None else source_uri,
        "filename": filename,
        "given_type": content_type,
        "resolved": text.resolve_content_type(filename, content_type),
    })
    readable = F.coalesce(text.extractor_tag(F.col("resolved")).isin("txt", "md"), F.lit(False))
    reason = F.when(F.col("resolved").isNull(), F.concat(F.lit("Unsupported content_type "), "given_type")).otherwise(
        F.concat(F.lit("no extractor for "), "resolved")
    )
    rejected = named.filter(~readable).select(
        "filename", F.col("given_type").alias("content_type"), reason.alias("reason"), "source_uri"
    )
    decoded = named.filter(readable).withColumn("text", text.decode_utf8(F.col("content")))
    silver = decoded.select(
        ids.doc_id(F.col("filename"), F.col("text")).alias("doc_id"),
        F.coalesce(missing if source_id is None else source_id, F.col("filename")).alias("source_id"),
        "filename",
        F.col("resolved").alias("content_type"),
        "text",
        F.length("text").alias("char_count"),
        (missing if user_id is None else user_id).alias("user_id"),
        "source_uri",
        (F.current_timestamp() if uploaded_at is None else uploaded_at).alias("uploaded_at"),
        F.create_map(
            F.lit("extractor"), text.extractor_tag(F.col("resolved")),
            F.lit("bytes"), F.octet_length("content").cast("string"),
        ).alias("metadata"),
    )
    return silver, rejected


def empty_documents(silver: DataFrame) -> DataFrame:
    """Documents whose extracted text has no characters."""
    return silver.filter(F.col("char_count") == 0).select("doc_id", "filename", F.col("metadata")["extractor"].alias("extractor"))


def parse_metric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metric records from embedded-metric JSON lines; lines that are not such records are dropped."""
    shape = (
        "_aws struct<Timestamp:bigint>, event string, Stage string, request_id string, Latency double, "
        "Errors double, RowsIngested double, RowsDropped double"
    )
    parsed = lines.select(F.from_json(column, shape).alias("r")).filter("r._aws.Timestamp IS NOT NULL")
    return parsed.select(
        F.timestamp_millis(F.col("r._aws.Timestamp")).alias("ts"), F.col("r.event").alias("event"),
        F.col("r.Stage").alias("stage"), F.col("r.request_id").alias("request_id"),
        F.col("r.Latency").alias("latency"), F.col("r.Errors").cast("int").alias("errors"),
        F.col("r.RowsIngested").alias("rows_ingested"), F.col("r.RowsDropped").alias("rows_dropped"),
    )


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_metric_lines(spark.read.text(path))


def read_vectors(spark: SparkSession, path: str, vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Embedding table as ``(vec_id, embedding array<float>)``."""
    return spark.read.parquet(path).select(F.col(vector_id).alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"))
