"""Writers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions.ids import json_string
from corpusmill.operators.topk import check_dimensions
from corpusmill.operators.upsert import KeyedTable
from corpusmill.session import delete_path, local_folder, path_exists


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


#: Files that a folder of raw files holds at most.
FOLDER_FILES = 4_096


def write_raw_files(rows: DataFrame, path: str, name: str = "filename", value: str = "value") -> None:
    """A text file per row with a final line break, below ``path``; rows of a task with one name share a file.

    Spark's writer opens a file through several processes where Hadoop has no native code, and makes a folder for each, so
    tasks write the files of a local (or mounted) path themselves: under a hidden name that is put in place, so a task that
    runs again changes nothing. :func:`raw_name` gives a row's name from its file's path.
    """
    root = local_folder(rows.sparkSession, path)
    marked = rows.select(name, value)
    if root is None:
        # Tasks move their own files into place; by default the driver moves them all, one after the other.
        marked.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(name).text(path)
        return
    os.makedirs(root)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        hidden, last, opened, files = f".{task.taskAttemptId()}.tmp", None, None, 0
        for batch in batches:
            for named, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = f"{name}={_escaped(named)}.txt"
                if file != last:
                    if files % FOLDER_FILES == 0:
                        _put(opened, last)
                        opened, folder = None, f"{root}/part-{task.partitionId():05d}/{files // FOLDER_FILES:05d}"
                        os.makedirs(folder, exist_ok=True)
                    _put(opened, last)
                    opened, last, files = open(f"{folder}/{hidden}", "wb"), file, files + 1
                opened.write((text or b"") + b"\n")
        _put(opened, last)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    marked = marked.withColumn(value, F.col(value).cast("binary")).sortWithinPartitions(name)
    marked.mapInArrow(written, "files long").agg(F.sum("files")).collect()


def _put(opened, file: str | None) -> None:
    """Close a file and give it its name."""
    if opened is not None:
        opened.close()
        os.replace(opened.name, f"{os.path.dirname(opened.name)}/{file}")


def _escaped(value: str | None) -> str:
    """A value as Spark writes it into the name of a partition's folder."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda found: f"%{ord(found[0]):02X}", value)


def raw_name(path: Column, name: str = "filename") -> Column:
    """The (escaped) name of a row that :func:`write_raw_files` wrote, by either writer."""
    return F.regexp_extract(path, rf"{name}=([^/]+)(?:/[^/]*|\.txt)$", 1)


GOLD_FORMATS = {"parquet": "parquet", "jsonl": "json"}


def write_gold(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Chunks by layer; writing a layer again replaces that layer only.

    Metadata is folded to a JSON string. Unknown formats and empty input are errors.
    """
    if fmt not in GOLD_FORMATS:
        raise ValueError(f"unknown gold format {fmt!r} (use one of {sorted(GOLD_FORMATS)})")
    # Counted while they are written: asking first would compute chunks twice.
    existed, seen = path_exists(chunks.sparkSession, path), Observation()
    flat = chunks.withColumn("metadata", F.to_json("metadata")).observe(seen, F.count(F.lit(1)).alias("n"))
    (
        flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .options(**({"compression": "zstd"} if fmt == "parquet" else {})).partitionBy("layer_version").format(GOLD_FORMATS[fmt]).save(path)
    )
    if not seen.get["n"]:
        if not existed:
            delete_path(chunks.sparkSession, path)
        raise ValueError("no chunks to write")


def silver_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """Silver documents by ``doc_id``: writing a document again changes nothing."""
    return KeyedTable(spark, path, schemas.SILVER, ["doc_id"], **options)


def vector_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """Vectors by chunk, model, dimension and layer, so layers and models live side by side."""
    return KeyedTable(spark, path, schemas.VECTORS, list(schemas.VECTOR_KEY), **options)


def upsert_vectors(table: KeyedTable, rows: DataFrame, model_id: str, dim: int) -> DataFrame:
    """Upsert rows of the right dimension; returns the rejected ones."""
    good, rejected = check_dimensions(rows, dim)
    table.upsert(good.withColumn("model_id", F.lit(model_id)).withColumn("embed_dim", F.lit(dim)))
    return rejected


def marker_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, schemas.MARKERS, list(schemas.MARKER_KEY), **options)


def vector_file_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    """``(chunk_id, embedding)``; the last write of an id wins."""
    return KeyedTable(spark, path, "chunk_id string, embedding array<float>", ["chunk_id"], **options)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact object per line."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def metric_lines(records: DataFrame, *, namespace: str, metrics: Mapping[str, str], dimensions: Sequence[str] = (),
                 properties: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Embedded-metric JSON lines: ``metrics`` maps column names to units, the rest are sibling keys."""
    def listed(items: Sequence[str]) -> str:
        return ",".join(items)

    definitions = listed([f'{{"Name":"{name}","Unit":"{unit}"}}' for name, unit in metrics.items()])
    dimension_set = listed([f'"{name}"' for name in dimensions])
    head = F.concat(
        F.lit('{"_aws":{"Timestamp":'), F.unix_millis(ts).cast("string"),
        F.lit(f',"CloudWatchMetrics":[{{"Namespace":"{namespace}","Dimensions":[[{dimension_set}]],"Metrics":[{definitions}]}}]}}'),
    )

    def shown(name: str) -> Column:
        kind = dict(records.dtypes)[name]
        body = json_string(F.col(name)) if kind == "string" else F.col(name).cast("string")
        return F.concat(F.lit(f',"{name}":'), F.coalesce(body, F.lit("null")))

    tail = [shown(name) for name in (*dimensions, *properties, *metrics)]
    return records.select(F.concat(head, *tail, F.lit("}")).alias("value"))


def write_metric_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


