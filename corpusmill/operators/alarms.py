"""Alarms over metric series: M of the last N periods, with a rule for missing periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.metrics import bin_start, exact_percentiles

NOT_BREACHING, BREACHING = "notBreaching", "breaching"

_COMPARISONS = {
    ">": lambda value, threshold: value > threshold,
    "<": lambda value, threshold: value < threshold,
    ">=": lambda value, threshold: value >= threshold,
    "<=": lambda value, threshold: value <= threshold,
}


def period_series(records: DataFrame, key: str, period: str, value: Column) -> DataFrame:
    """One aggregated ``value`` per key and period that has records."""
    return records.groupBy(key, bin_start("ts", period).alias("period")).agg(value.alias("value"))


def percentile_series(records: DataFrame, key: str, period: str, value: str, percent: str) -> DataFrame:
    binned = records.withColumn("period", bin_start("ts", period))
    return exact_percentiles(binned, [key, "period"], value, {"value": percent}).drop("samples")


def with_missing_periods(series: DataFrame, key: str, period: str) -> DataFrame:
    """Every period from a key's first to its last; periods without records have a null value."""
    calendar = series.groupBy(key).agg(F.min("period").alias("low"), F.max("period").alias("high")).select(
        key, F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {period}"))).alias("period")
    )
    return calendar.join(series, [key, "period"], "left")


def alarm(series: DataFrame, key: str, period: str, comparison: str, threshold: float, *, datapoints: int = 1,
          evaluation_periods: int = 1, missing: str = NOT_BREACHING) -> DataFrame:
    """``breach`` and ``alarm`` per key and period.

    The window runs over already aggregated periods, so its size is a matter of time span and not
    of how many records a key has.
    """
    full = with_missing_periods(series, key, period)
    breach = F.coalesce(_COMPARISONS[comparison](F.col("value"), F.lit(threshold)), F.lit(missing == BREACHING))
    recent = Window.partitionBy(key).orderBy("period").rowsBetween(1 - evaluation_periods, 0)
    return full.withColumn("breach", breach).withColumn(
        "alarm", F.sum(F.col("breach").cast("int")).over(recent) >= datapoints
    )


# Thresholds and periods of the pipeline's alarms.
def stage_error_alarm(records: DataFrame, *, period: str = "60 seconds", threshold: float = 3) -> DataFrame:
    """Errors above the threshold in at least 3 of the last 5 periods, per stage."""
    done = records.filter(F.col("event") == "stage_done")
    series = period_series(done, "stage", period, F.sum("errors"))
    return alarm(series, "stage", period, ">", threshold, datapoints=3, evaluation_periods=5)


def stage_latency_alarm(records: DataFrame, *, period: str = "300 seconds", threshold: float = 30000) -> DataFrame:
    """Tail latency of one period above the threshold, per stage."""
    done = records.filter(F.col("event") == "stage_done")
    return alarm(percentile_series(done, "stage", period, "latency", "99"), "stage", period, ">", threshold)


def empty_output_alarm(records: DataFrame, *, period: str = "300 seconds", threshold: float = 1) -> DataFrame:
    """Fewer rows than the threshold; a period without any run breaches too."""
    done = records.filter(F.col("event") == "pipeline_done").withColumn("scope", F.lit("summary"))
    series = period_series(done, "scope", period, F.sum("rows_ingested"))
    return alarm(series, "scope", period, "<", threshold, missing=BREACHING)


def composite_alarm(alarms: Sequence[DataFrame], period: str) -> DataFrame:
    """A period is unhealthy when any alarm fired in it."""
    fired = None
    for states in alarms:
        part = states.select(F.col("period").alias("ts"), "alarm")
        fired = part if fired is None else fired.unionByName(part)
    return fired.groupBy(bin_start("ts", period).alias("period")).agg(F.bool_or("alarm").alias("alarm"))


def service_alarms(records: DataFrame, *, period: str = "300 seconds", latency_threshold: float) -> DataFrame:
    """Queue depth, errors and server errors above 0, and tail latency over three periods.

    ``records``: ``ts, service, queue_depth, errors, server_errors, latency``.
    """
    def named(name: str, states: DataFrame) -> DataFrame:
        return states.select(F.lit(name).alias("alarm_name"), "service", "period", F.col("value").cast("double").alias("value"), "alarm")

    def above_zero(value: Column) -> DataFrame:
        return alarm(period_series(records, "service", period, value), "service", period, ">", 0)

    tail = alarm(
        percentile_series(records, "service", period, "latency", "99"), "service", period, ">", latency_threshold,
        datapoints=3, evaluation_periods=3,
    )
    return (
        named("dlq_not_empty", above_zero(F.max("queue_depth")))
        .unionByName(named("errors", above_zero(F.sum("errors"))))
        .unionByName(named("server_errors", above_zero(F.sum("server_errors"))))
        .unionByName(named("latency_p99", tail))
    )
