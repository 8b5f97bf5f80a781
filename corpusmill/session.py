"""Session helpers: builder defaults, shared scratch folder, size-checked collection."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "corpusmill", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch at most. The default counts rows, so long texts would add up in a Python worker.
BATCH_BYTES = "8m"


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application, and batches bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        handle, archive = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
            for source in sorted(package.rglob("*.py")):
                bundle.write(source, source.relative_to(package.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``; unset there, it is an error, since a folder of one
    machine would lose rows. In local mode one is made here, and remembered in the session.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    return configured.rstrip("/")


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this process put below the shared folder, once no result reads it any more."""
    context = spark.sparkContext
    paths = {*_SCRATCH, *([context.getCheckpointDir()] if context.getCheckpointDir() else [])}
    _SCRATCH.clear()
    for path in paths:
        delete_path(spark, path)
    if context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder: compressed, and read by column."""
    path = scratch_path(df.sparkSession, "checkpoint")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_within(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` when there are at most ``limit`` of them, else None.

    Callers take their distributed path on None, so nothing unbounded reaches the driver.
    """
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) exists on whatever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path)
    return found is not None and len(found) > 0


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as Python opens it, or None where only Spark's file systems reach it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return jvm_path.toUri().getPath() if scheme == "file" else None


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; empty when it does not exist."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(jvm_path)]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Give per-row heavy work as many partitions as there are cores.

    Only small inputs (one file, one row group) have fewer; large scans pass through unshuffled. With ``rows_per_task``
    the rows are counted (of a Parquet scan, in its footers) and no task gets many more, so tasks do not grow with the input.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        wanted = max(wanted, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
