"""Windowed metrics and alarms over streams."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.alarms import BREACHING, alarm, composite_alarm
from corpusmill.operators.metrics import percentiles_of_counts
from corpusmill.operators.upsert import AppendTable

WINDOWS = (
    "stage string, period timestamp, samples bigint, errors bigint, latency_sum double, latency_max double, latency_p99 double, rows_ingested double"
)
STATES = "alarm_name string, stage string, period timestamp, value double, breach boolean, alarm boolean"
# The stage under which whole runs are counted.
SUMMARY = "summary"
COUNTS = "stage string, period timestamp, latency double, samples bigint, errors bigint, rows_ingested double"


def window_counts(records: DataFrame, period: str, lateness: str = "10 minutes") -> DataFrame:
    """Records of tumbling windows, counted per stage and latency.

    The watermark bounds the state; later records are dropped. A window's state is a row per latency, spread by
    it, so no task holds a window; all rows of a window come in the batch that closes it.
    """
    rows = F.sum("rows_ingested") if "rows_ingested" in records.columns else F.lit(None).cast("double")
    return (
        records.withWatermark("ts", lateness)
        .groupBy(F.window("ts", period), "stage", F.col("latency").cast("double").alias("latency"))
        .agg(F.count("*").alias("samples"), F.sum("errors").alias("errors"), rows.alias("rows_ingested"))
        .select("stage", F.col("window.start").alias("period"), "latency", "samples", "errors", "rows_ingested")
    )


def _tails(counts: DataFrame, percents: Mapping[str, str]) -> DataFrame:
    """``stage, period, samples`` and exact percentiles; a null stage is a stage too."""
    named = counts.withColumn("named", F.coalesce(F.concat(F.lit("s"), "stage"), F.lit("n")))
    found = percentiles_of_counts(named, ["named", "period"], "latency", "samples", percents)
    stage = F.when(F.col("named").startswith("s"), F.expr("substring(named, 2)")).alias("stage")
    return found.select(stage, "period", "samples", *percents)


def windows_of(counts: DataFrame) -> DataFrame:
    """Closed windows from their counts by latency. The tail latency is exact; null where no latency is a number."""
    sums = counts.groupBy("stage", "period").agg(
        F.sum("samples").alias("samples"), F.sum("errors").alias("errors"),
        F.sum(F.col("latency") * F.col("samples")).alias("latency_sum"), F.max("latency").alias("latency_max"),
        F.sum("rows_ingested").alias("rows_ingested"))
    tails = _tails(counts, {"latency_p99": "99"})
    same = F.col("a.stage").eqNullSafe(F.col("b.stage")) & (F.col("a.period") == F.col("b.period"))
    return sums.alias("a").join(tails.alias("b"), same, "left").select("a.*", "b.latency_p99")


class StreamingAlarms:
    """Closed windows are appended by day; each batch evaluates the recent periods of its stages.

    The counts by latency of closed windows are kept next to them, so that percentiles of wider windows are exact
    too and need no record again.

    Three alarms: errors of a stage, tail latency of a stage, and rows of whole runs (stage ``summary``, where a
    missing period breaches). Of the history only the days that the batch's windows look back to are read.
    """

    def __init__(self, spark: SparkSession, root: str, *, period: str = "60 seconds", threshold: float = 3, datapoints: int = 3,
                 evaluation_periods: int = 5, latency_threshold: float = 30000, least_rows: float = 1) -> None:
        self.counts = AppendTable(spark, f"{root}/counts", COUNTS, "period")
        self.windows = AppendTable(spark, f"{root}/windows", WINDOWS, "period", ["stage", "period"])
        self.states = AppendTable(spark, f"{root}/alarms", STATES, "period", ["alarm_name", "stage", "period"])
        self.period, self.threshold = period, threshold
        self.datapoints, self.evaluation_periods = datapoints, evaluation_periods
        self.latency_threshold, self.least_rows = latency_threshold, least_rows

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.counts.append(batch, batch_id)  # written once, so that the state is not read for every use
        self.windows.append(windows_of(self.counts.of_batch(batch_id)), batch_id)
        batch = self.windows.of_batch(batch_id)
        reach = F.expr(f"{self.evaluation_periods} * INTERVAL {self.period}")
        span = batch.groupBy("stage").agg((F.min("period") - reach).alias("low"), F.min("period").alias("first"), (F.max("period") + reach).alias("high"))
        since = span.agg(F.min("low")).first()[0]
        if since is None:
            return
        near = self.windows.read(F.lit(since)).join(span, "stage").filter("period BETWEEN low AND high")
        stages, runs = near.filter(F.col("stage") != SUMMARY), near.filter(F.col("stage") == SUMMARY)
        kinds = (
            ("stage_errors", stages, "errors", ">", self.threshold, {"datapoints": self.datapoints, "evaluation_periods": self.evaluation_periods}),
            ("stage_latency", stages, "latency_p99", ">", self.latency_threshold, {}),
            ("empty_output", runs, "rows_ingested", "<", self.least_rows, {"missing": BREACHING}),
        )
        states = [
            alarm(some.select("stage", "period", F.col(value).cast("double").alias("value")), "stage", self.period, compare, limit, **rule)
            .withColumn("alarm_name", F.lit(name))
            for name, some, value, compare, limit, rule in kinds
        ]
        # Periods before the batch's first window lack part of their history here and are kept as stored.
        everything = reduce(DataFrame.unionByName, states).join(span.select("stage", "first"), "stage").filter("period >= first")
        self.states.append(everything.drop("first"), batch_id)

    def percentiles(self, period: str, percents: Mapping[str, str]) -> DataFrame:
        """Exact percentiles of the closed windows in each ``period``, a multiple of the windows' own."""
        wider = self.counts.read().withColumn("period", F.window("period", period)["start"])
        return _tails(wider, percents)

    def health(self, period: str) -> DataFrame:
        """Periods in which any alarm fired."""
        return composite_alarm([self.states.read()], period)

    def start(self, records: DataFrame, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
        return (
            window_counts(records, self.period, lateness).writeStream.outputMode("append")
            .foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
