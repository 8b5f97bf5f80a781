"""Aggregates over metric records: exact percentiles, rates, hourly and dashboard series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import rows_within

# Sketch accuracy behind exact percentiles: brackets hold about 8 / ACCURACY of a group's rows.
# Raise it for groups of more than about 10^10 distinct values.
ACCURACY = 10_000
# Groups whose sketches are broadcast; beyond that the join is salted.
BROADCAST_GROUPS, SALTS = 1_000, 64
# Ranges in which a group's bracketed values are counted before any are sorted.
BINS = 1_024


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: Mapping[str, str], *,
                      accuracy: int = ACCURACY) -> DataFrame:
    """Nearest-rank percentiles per group, exact for groups of any size.

    ``percents`` maps output names to percents written as text (``{"p99": "99"}``). A mergeable
    sketch brackets every percentile first; one more pass counts rows by value inside the brackets
    and lumps together all rows between them, combined on the map side. Those counts are folded by
    range of value, and only the ranges that hold a percentile are sorted. Should a percentile ever fall outside its bracket, the query fails instead of answering
    wrongly. Without groups the brackets are one row, which is read at once and put in as literals.
    """
    keys = list(groups)
    data = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    shares = {name: Decimal(percent) / 100 for name, percent in percents.items()}
    margin = 4 / accuracy
    edges = [
        edge for share in shares.values()
        for edge in (max(0.0, float(share) - margin), min(1.0, float(share) + margin))
    ]
    sketched = data.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", edges, accuracy).alias("edges"))
    if keys:
        placed = _with_sketch(data, sketched, keys)
    else:
        total, found = sketched.first()
        at = F.array(*[F.lit(edge) for edge in found]) if found else F.lit(None).cast("array<double>")
        placed = data.withColumn("n", F.lit(total)).withColumn("edges", at)
    pairs = [(F.col("edges")[2 * i], F.col("edges")[2 * i + 1]) for i in range(len(shares))]
    v = F.col("v")
    inside = reduce(lambda x, y: x | y, [(v >= low) & (v <= high) for low, high in pairs])
    below = [F.when(high < v, high) for _, high in pairs]
    passed = F.greatest(*below) if len(below) > 1 else below[0]
    counted = (
        placed.select(*keys, "n", F.when(inside, v).otherwise(passed).alias("at"), (~inside).alias("lumped"))
        .groupBy(*keys, "n", "at", "lumped").agg(F.count("*").alias("c"))
    )

    running = _running_counts(counted, keys, [_nearest_rank(share) for share in shares.values()])

    def pick(share: Decimal) -> Column:
        found = F.min(F.when(F.col("upto") >= _nearest_rank(share), F.struct("upto", "at", "lumped")))
        outside = F.raise_error(F.lit("percentile outside its bracket")).cast("double")
        return F.when(F.max("n").isNull(), None).when(found["lumped"] | found.isNull(), outside).otherwise(found["at"])

    return running.groupBy(*keys).agg(
        F.max("n").alias("samples"), *[pick(share).alias(name) for name, share in shares.items()]
    )


def percentiles_of_counts(counts: DataFrame, groups: Sequence[str], value: str, count: str, percents: Mapping[str, str]) -> DataFrame:
    """Exact nearest-rank percentiles per group from rows that say how often a value occurs.

    The same value may come in several rows. Values that are null or not a number count nowhere; a group without
    others gives no row. Only ranges of value that hold a percentile are sorted.
    """
    keys = list(groups)
    kept = counts.select(*keys, F.col(value).cast("double").alias("at"), F.col(count).cast("bigint").alias("c"))
    kept = kept.filter("at IS NOT NULL AND NOT isnan(at) AND c > 0").groupBy(*keys, "at").agg(F.sum("c").alias("c"))
    totals = kept.groupBy(*keys).agg(F.sum("c").alias("n"))
    counted = kept.withColumn("lumped", F.lit(False))
    counted = counted.join(totals, keys) if keys else counted.crossJoin(F.broadcast(totals))  # one row
    targets = {name: _nearest_rank(Decimal(percent) / 100) for name, percent in percents.items()}
    running = _running_counts(counted.select(*keys, "n", "at", "lumped", "c"), keys, list(targets.values()))
    found = running.groupBy(*keys).agg(F.max("n").alias("samples"), *[
        F.min(F.when(F.col("upto") >= target, F.struct("upto", "at")))["at"].alias(name) for name, target in targets.items()])
    return found if keys else found.filter("samples IS NOT NULL")


def _nearest_rank(share: Decimal) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(share).cast("decimal(10,6)")))


def _with_sketch(data: DataFrame, sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's sketch: broadcast when the groups are counted to be few, else joined on salted keys.

    Either way no group's rows meet in one task.
    """
    rows = rows_within(sketched, BROADCAST_GROUPS)
    if rows is not None:
        few = data.sparkSession.createDataFrame(rows, sketched.schema)
        return data.join(F.broadcast(few), keys)
    salted = data.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    return salted.join(sketched.select("*", copies), [*keys, "salt"]).drop("salt")


def _running_counts(counted: DataFrame, keys: list[str], targets: list[Column]) -> DataFrame:
    """``upto``, the rows up to each value of a group, where a percentile may lie.

    The values are first counted by range: BINS ranges of equal width of what each group holds. Only ranges in
    which the running count passes a target are opened, so the sorted windows hold BINS rows of a group and
    then the values of a few ranges.
    """
    limits = counted.groupBy(*keys).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    width = F.col("high") - F.col("low")
    place = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("at") - F.col("low"), width) * BINS))
    place = F.when(F.col("at").isNull(), -1).when(~(width > 0), 0).when(width == float("inf"), 0).otherwise(place).cast("int")
    limits = limits.hint("broadcast") if not keys else limits
    ranged = (counted.join(limits, keys) if keys else counted.crossJoin(limits)).withColumn("bin", place).drop("low", "high")
    binned = ranged.groupBy(*keys, "n", "bin").agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*keys).orderBy("bin")
    binned = binned.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passes = reduce(lambda x, y: x | y, [(F.col("before") < t) & (F.col("before") + F.col("c") >= t) for t in targets])
    opened = binned.filter(passes).select(*keys, "bin", "before")
    inside = Window.partitionBy(*keys, "bin").orderBy(F.col("at").asc_nulls_first(), "lumped")
    upto = F.col("before") + F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(opened, [*keys, "bin"]).withColumn("upto", upto)


def latency_summary(df: DataFrame, value: str = "latency") -> DataFrame:
    """count, min, mean, p50, p90, p95, p99, max over what is a number; zeros when there is none."""
    ranks = exact_percentiles(df, [], value, {"p50": "50", "p90": "90", "p95": "95", "p99": "99"}).drop("samples")
    number = F.when(~F.isnan(value), F.col(value))
    basics = df.agg(
        F.count(number).cast("double").alias("count"), F.min(number).alias("min"),
        F.round(F.avg(number), 6).alias("mean"), F.max(number).alias("max"),
    )
    names = ("count", "min", "mean", "p50", "p90", "p95", "p99", "max")
    both = basics.unionByName(ranks, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.max(name), F.lit(0.0)).alias(name) for name in names])


def recent_failures(records: DataFrame, limit: int = 50) -> DataFrame:
    failed = ((F.col("event") == "stage_done") & (F.col("errors") == 1)) | (F.col("event") == "pipeline_failed")
    return (
        records.filter(failed)
        .select("ts", "request_id", "event", "stage", "errors", "rows_ingested", "rows_dropped")
        .orderBy(F.col("ts").desc(), "request_id", "stage").limit(limit)
    )


def timeline(records: DataFrame, request_id: str) -> DataFrame:
    """One invocation's records in time order."""
    return (
        records.filter(F.col("request_id") == request_id)
        .select("ts", "event", "stage", "latency", "rows_ingested").orderBy("ts", "stage")
    )


def stage_percentiles(records: DataFrame) -> DataFrame:
    """p50, p99, p99.9 and samples per stage, slowest first."""
    done = records.filter(F.col("event") == "stage_done")
    ranks = exact_percentiles(done, ["stage"], "latency", {"p50": "50", "p99": "99", "p999": "99.9"})
    return ranks.select("stage", "p50", "p99", "p999", "samples").orderBy(F.col("p99").desc(), "stage")


def bin_start(ts: str, period: str) -> Column:
    """Start of the tumbling period a time falls in."""
    return F.window(F.col(ts), period)["start"]


def invocations_per_hour(records: DataFrame) -> DataFrame:
    runs = records.filter(F.col("event").isin("pipeline_done", "pipeline_failed"))
    return runs.groupBy(bin_start("ts", "1 hour").alias("hour")).agg(F.count("*").alias("invocations")).orderBy(F.col("hour").desc())


def drop_ratio_per_hour(records: DataFrame) -> DataFrame:
    done = records.filter(F.col("event") == "pipeline_done")
    ratio = F.try_divide(F.sum("rows_dropped"), F.sum(F.col("rows_ingested") + F.col("rows_dropped")))
    return done.groupBy(bin_start("ts", "1 hour").alias("hour")).agg(
        F.sum("rows_ingested").alias("ingested"), F.sum("rows_dropped").alias("dropped"),
        F.round(ratio, 9).alias("drop_ratio"),
    ).orderBy(F.col("hour").desc())


def stage_failure_rate(records: DataFrame) -> DataFrame:
    done = records.filter(F.col("event") == "stage_done")
    totals = done.groupBy("stage").agg(F.sum("errors").alias("failures"), F.count("*").alias("total"))
    return totals.withColumn("failure_pct", F.round(F.col("failures") / F.col("total") * 100, 6)).orderBy(
        F.col("failure_pct").desc(), "stage"
    )


def hourly_report(reports: DataFrame, ts: str, init: str, duration: str, memory: str) -> DataFrame:
    """Count, two averages and a maximum per hour."""
    return reports.groupBy(bin_start(ts, "1 hour").alias("hour")).agg(
        F.count("*").alias("invocations"), F.round(F.avg(init), 6).alias("init_ms"),
        F.round(F.avg(duration), 6).alias("dur_ms"), F.max(memory).alias("max_mem"),
    ).orderBy(F.col("hour").desc())


# Paths without metrics, and the label of unmatched ones.
QUIET_PATHS = ("/", "/healthz")
UNMATCHED = "<unmatched>"


def endpoint_latency(requests: DataFrame, routes: Sequence[str], percents: Mapping[str, str] = {"p90": "90"}) -> DataFrame:
    """Percentiles per route template; unknown paths share one label, quiet ones are left out."""
    label = F.when(F.col("path").isin(*routes), F.col("path")).otherwise(F.lit(UNMATCHED))
    kept = requests.withColumn("endpoint", label).filter(~F.col("endpoint").isin(*QUIET_PATHS))
    return exact_percentiles(kept, ["endpoint"], "latency", percents)


def run_gauges(records: DataFrame) -> DataFrame:
    """One row per run, from its summary records."""
    failed = F.col("event") == "pipeline_failed"
    runs = records.filter(F.col("event").isin("pipeline_done", "pipeline_failed"))
    return runs.groupBy("request_id").agg(
        F.sum(F.when(~failed, F.col("rows_ingested"))).alias("rows_ingested"),
        F.sum(F.when(~failed, F.col("rows_dropped"))).alias("rows_dropped"),
        F.count("*").alias("invocations"), F.count_if(failed).alias("invocation_failures"),
    )


def message_outcomes(objects: DataFrame) -> DataFrame:
    """A message failed when any of its objects did."""
    return objects.groupBy("message_id").agg(F.bool_or("failed").alias("failed"), F.count("*").alias("objects"))


def dashboard_series(records: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Sums per period: invocations, failures, errors by stage, rows in and out."""
    run = F.col("event").isin("pipeline_done", "pipeline_failed")
    return records.groupBy(bin_start("ts", period).alias("period"), "stage").agg(
        F.count_if(run).alias("invocations"), F.count_if(F.col("event") == "pipeline_failed").alias("failures"),
        F.sum(F.when(F.col("event") == "stage_done", F.col("errors"))).alias("errors"),
        F.sum("rows_ingested").alias("rows_ingested"), F.sum("rows_dropped").alias("rows_dropped"),
    )
