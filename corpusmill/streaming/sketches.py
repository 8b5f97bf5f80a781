"""Stored sketches of latencies, merged to windows of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.upsert import AppendTable

SKETCHES = "stage string, period timestamp, samples bigint, sketch binary"
# Published fixed values: a KLL sketch of size k errs by at most 2.296 / k^0.9723 of the ranks, in 99 of 100 cases.
ERROR_SCALE, ERROR_POWER = 2.296, 0.9723


def rank_error(size: int) -> float:
    """Share of a window's rows by which the rank of a percentile may be off."""
    return ERROR_SCALE / size**ERROR_POWER


class LatencySketches:
    """KLL sketches per stage and short period, appended by day and batch; wider windows merge what is stored.

    Each batch adds sketches of its own records only, so late records need no rewrite and a batch that runs again
    replaces its own. No state is kept and no record is read twice: a window of any size is a merge of some
    kilobytes per period. Latencies that are null or not a number are left out.
    """

    def __init__(self, spark: SparkSession, root: str, *, period: str = "1 minute", size: int = 4096) -> None:
        self.parts = AppendTable(spark, f"{root}/sketches", SKETCHES, "period")
        self.period, self.size = period, size

    def process(self, batch: DataFrame, batch_id: int) -> None:
        numbers = batch.select("stage", F.window("ts", self.period)["start"].alias("period"), F.col("latency").cast("double").alias("latency"))
        numbers = numbers.filter("period IS NOT NULL AND latency IS NOT NULL AND NOT isnan(latency)")
        self.parts.append(numbers.groupBy("stage", "period").agg(
            F.count("*").alias("samples"), F.kll_sketch_agg_double("latency", F.lit(self.size)).alias("sketch")), batch_id)

    def windows(self, period: str, percents: Mapping[str, str], since: Column | None = None) -> DataFrame:
        """``stage, period, samples, rank_error`` and the percentiles of windows of ``period``, a multiple of the stored one.

        Windows of up to ``size`` records are exact and say 0 for their error.
        """
        wider = self.parts.read(since).withColumn("period", F.window("period", period)["start"])
        merged = wider.groupBy("stage", "period").agg(
            F.sum("samples").alias("samples"), F.kll_merge_agg_double("sketch", F.lit(self.size)).alias("sketch"))
        error = F.when(F.col("samples") <= self.size, F.lit(0.0)).otherwise(F.lit(rank_error(self.size)))
        return merged.select("stage", "period", "samples", error.alias("rank_error"), *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(percent) / 100)).alias(name) for name, percent in percents.items()])

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        return records.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
