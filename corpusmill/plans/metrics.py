"""Queries over metric records: percentiles, rates, series, alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import alarms, metrics
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, shown, sql_shown, table, with_sql


def _records(spark, folder):
    return I.metric_records(spark, folder)


def _sql(select: str, *ctes: str) -> str:
    return with_sql(I.METRICS_SQL, *ctes, select=select)


@query("AGG1_latency_summary", _sql("""SELECT count(latency)::DOUBLE AS count, min(latency) AS min, round(avg(latency), 6) AS mean,
 quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.9) AS p90, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99, max(latency) AS max FROM records"""))
def latency_summary(spark, folder):
    return metrics.latency_summary(_records(spark, folder))


@query("AGG2_recent_failures", _sql(f"""SELECT {sql_shown('ts')} AS at, request_id, event, stage, errors, rows_ingested, rows_dropped FROM records
 WHERE (event = 'stage_done' AND errors = 1) OR event = 'pipeline_failed' ORDER BY ts DESC, request_id, stage LIMIT 50"""))
def recent_failures(spark, folder):
    return metrics.recent_failures(_records(spark, folder)).withColumn("at", shown("ts")).drop("ts")


@query("AGG3_timeline", _sql(f"SELECT {sql_shown('ts')} AS at, event, stage, latency, rows_ingested FROM records WHERE request_id = 'r8'"))
def timeline(spark, folder):
    return metrics.timeline(_records(spark, folder), "r8").withColumn("at", shown("ts")).drop("ts")


@query("AGG4_stage_percentiles", _sql("""SELECT stage, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.99) AS p99,
 quantile_disc(latency, 0.999) AS p999, count(*) AS samples FROM records WHERE event = 'stage_done' GROUP BY stage"""))
def stage_percentiles(spark, folder):
    return metrics.stage_percentiles(_records(spark, folder))


@query("AGG5_invocations_per_hour", _sql(f"SELECT {sql_shown("time_bucket(INTERVAL '1 hour', ts)")} AS hour, count(*) AS invocations FROM records WHERE event IN ('pipeline_done', 'pipeline_failed') GROUP BY 1"))
def invocations(spark, folder):
    return metrics.invocations_per_hour(_records(spark, folder)).withColumn("hour", shown("hour"))


@query("AGG6_drop_ratio", _sql(f"""SELECT {sql_shown("time_bucket(INTERVAL '1 hour', ts)")} AS hour, sum(rows_ingested) AS ingested, sum(rows_dropped) AS dropped,
 round(sum(rows_dropped) / nullif(sum(rows_ingested + rows_dropped), 0), 9) AS drop_ratio FROM records WHERE event = 'pipeline_done' GROUP BY 1"""))
def drop_ratio(spark, folder):
    return metrics.drop_ratio_per_hour(_records(spark, folder)).withColumn("hour", shown("hour"))


@query("AGG7_stage_failure_rate", _sql("""SELECT stage, sum(errors)::BIGINT AS failures, count(*) AS total, round(sum(errors) / count(*) * 100, 6) AS failure_pct
 FROM records WHERE event = 'stage_done' GROUP BY stage"""))
def failure_rate(spark, folder):
    return metrics.stage_failure_rate(_records(spark, folder))


@query("AGG8_hourly_report", f"""SELECT {sql_shown("time_bucket(INTERVAL '1 hour', ts)")} AS hour, count(*) AS invocations,
 round(avg(CASE WHEN event_type = 'signup' THEN value END), 6) AS init_ms, round(avg(value), 6) AS dur_ms, max(user_id) AS max_mem FROM events GROUP BY 1""")
def hourly_report(spark, folder):
    reports = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", F.col("value")).alias("init"), "value", "user_id")
    return metrics.hourly_report(reports, "ts", "init", "value", "user_id").withColumn("hour", shown("hour"))


@query("AGG11_endpoint_latency", """SELECT endpoint, count(*) AS samples, quantile_disc(value, 0.9) AS p90 FROM
 (SELECT value, CASE WHEN p IN ('/', '/healthz', '/excavate', '/mutate') THEN p ELSE '<unmatched>' END AS endpoint FROM
 (SELECT value, (['/', '/healthz', '/excavate', '/mutate', '/x' || user_id])[event_id % 5 + 1] AS p FROM events)) WHERE endpoint NOT IN ('/', '/healthz') GROUP BY 1""")
def endpoint_latency(spark, folder):
    paths = F.array(F.lit("/"), F.lit("/healthz"), F.lit("/excavate"), F.lit("/mutate"), F.concat(F.lit("/x"), F.col("user_id").cast("string")))
    requests = table(spark, folder, "events").select(
        F.element_at(paths, (F.col("event_id") % 5 + 1).cast("int")).alias("path"), F.col("value").alias("latency"))
    return metrics.endpoint_latency(requests, ["/", "/healthz", "/excavate", "/mutate"])


@query("AGG12_run_gauges", _sql("""SELECT request_id, sum(rows_ingested) FILTER (event = 'pipeline_done') AS rows_ingested, sum(rows_dropped) FILTER (event = 'pipeline_done') AS rows_dropped,
 count(*) AS invocations, count(*) FILTER (event = 'pipeline_failed') AS invocation_failures FROM records WHERE event IN ('pipeline_done', 'pipeline_failed') GROUP BY request_id"""))
def run_gauges(spark, folder):
    return metrics.run_gauges(_records(spark, folder))


@query("AGG13_message_outcomes", "SELECT 'order-' || l_orderkey AS message_id, bool_or(l_returnflag = 'R') AS failed, count(*) AS objects FROM lineitem GROUP BY l_orderkey")
def message_outcomes(spark, folder):
    objects = table(spark, folder, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("message_id"), (F.col("l_returnflag") == "R").alias("failed"))
    return metrics.message_outcomes(objects)


@query("AGG14_dashboard_series", _sql(f"""SELECT {sql_shown("time_bucket(INTERVAL '5 minutes', ts)")} AS period, stage,
 count(*) FILTER (event IN ('pipeline_done', 'pipeline_failed')) AS invocations, count(*) FILTER (event = 'pipeline_failed') AS failures,
 sum(errors) FILTER (event = 'stage_done')::BIGINT AS errors, sum(rows_ingested) AS rows_ingested, sum(rows_dropped) AS rows_dropped FROM records GROUP BY 1, 2"""))
def dashboard(spark, folder):
    return metrics.dashboard_series(_records(spark, folder)).withColumn("period", shown("period"))


# --- alarms ---------------------------------------------------------------------------------------


def _calendar(series: str, key: str, step: str, name: str) -> str:
    return (
        f"{name} AS (SELECT c.{key}, c.period, s.value FROM (SELECT {key}, unnest(generate_series(min(period), max(period), INTERVAL '{step}')) AS period "
        f"FROM {series} GROUP BY {key}) c LEFT JOIN {series} s ON s.{key} = c.{key} AND s.period = c.period)"
    )


def _alarm_select(full: str, key: str, breach: str, m: int, n: int) -> str:
    return (
        f"SELECT {key}, {sql_shown('period')} AS period, value, breach, coalesce(sum(breach::INTEGER) OVER (PARTITION BY {key} ORDER BY period "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {m}, false) AS alarm FROM (SELECT *, {breach} AS breach FROM {full})"
    )


_ERRORS = "errs AS (SELECT stage, time_bucket(INTERVAL '6 hours', ts) AS period, sum(errors)::BIGINT AS value FROM records WHERE event = 'stage_done' GROUP BY 1, 2)"
_TAIL = "tail AS (SELECT stage, time_bucket(INTERVAL '6 hours', ts) AS period, quantile_disc(latency, 0.99) AS value FROM records WHERE event = 'stage_done' GROUP BY 1, 2)"
_ROWS = "rws AS (SELECT 'summary' AS scope, time_bucket(INTERVAL '1 hour', ts) AS period, sum(rows_ingested) AS value FROM records WHERE event = 'pipeline_done' GROUP BY 1, 2)"
_ERR_ALARM = _alarm_select("errs_full", "stage", "coalesce(value > 3, false)", 3, 5)
_TAIL_ALARM = _alarm_select("tail_full", "stage", "coalesce(value > 150, false)", 1, 1)
_ROWS_ALARM = _alarm_select("rws_full", "scope", "coalesce(value < 1, true)", 1, 1)
_FULL = [
    _ERRORS, _calendar("errs", "stage", "6 hours", "errs_full"), _TAIL, _calendar("tail", "stage", "6 hours", "tail_full"),
    _ROWS, _calendar("rws", "scope", "1 hour", "rws_full"),
]


def _printed(states):
    return states.withColumn("period", shown("period")).select(*[c for c in states.columns])


@query("WIN4_stage_error_alarm", _sql(_ERR_ALARM, *_FULL[:2]))
def stage_errors(spark, folder):
    return _printed(alarms.stage_error_alarm(_records(spark, folder), period="6 hours"))


@query("WIN5_stage_latency_alarm", _sql(_TAIL_ALARM, *_FULL[2:4]))
def stage_latency(spark, folder):
    return _printed(alarms.stage_latency_alarm(_records(spark, folder), period="6 hours", threshold=150))


@query("WIN6_empty_output_alarm", _sql(_ROWS_ALARM, *_FULL[4:]))
def empty_output(spark, folder):
    return _printed(alarms.empty_output_alarm(_records(spark, folder), period="1 hour"))


@query("WIN7_composite_alarm", _sql(
    f"SELECT {sql_shown('day')} AS period, bool_or(alarm) AS alarm FROM (SELECT date_trunc('day', strptime(period, '%Y-%m-%d %H:%M:%S')) AS day, alarm FROM "
    f"(SELECT period, alarm FROM ({_ERR_ALARM}) UNION ALL SELECT period, alarm FROM ({_TAIL_ALARM}) UNION ALL SELECT period, alarm FROM ({_ROWS_ALARM}))) GROUP BY 1", *_FULL))
def composite(spark, folder):
    records = _records(spark, folder)
    states = alarms.composite_alarm([
        alarms.stage_error_alarm(records, period="6 hours"), alarms.stage_latency_alarm(records, period="6 hours", threshold=150),
        alarms.empty_output_alarm(records, period="1 hour")], "1 day")
    return states.withColumn("period", shown("period"))


_SERVICE = (
    "service AS (SELECT ts, CASE WHEN user_id % 3 = 0 THEN 'api' ELSE 'worker' END AS service, (event_id % 50 = 0)::INTEGER AS queue_depth, (event_type = 'error')::INTEGER AS errors, "
    "(event_type = 'error' AND user_id % 3 = 0)::INTEGER AS server_errors, value AS latency FROM events)"
)
_SERVICE_PARTS = [
    (name, f"{short} AS (SELECT service, time_bucket(INTERVAL '3 hours', ts) AS period, {value} AS value FROM service GROUP BY 1, 2)", short, breach, n)
    for name, short, value, breach, n in (
        ("dlq_not_empty", "sq", "max(queue_depth)::DOUBLE", "value > 0", 1), ("errors", "se", "sum(errors)::DOUBLE", "value > 0", 1),
        ("server_errors", "sv", "sum(server_errors)::DOUBLE", "value > 0", 1), ("latency_p99", "sl", "quantile_disc(latency, 0.99)", "value > 150", 3))
]


@query("WIN8_service_alarms", with_sql(
    _SERVICE, *[part for _, cte, short, _, _ in _SERVICE_PARTS for part in (cte, _calendar(short, "service", "3 hours", f"{short}_full"))],
    select=" UNION ALL ".join(
        f"SELECT '{name}' AS alarm_name, service, period, value, alarm FROM ({_alarm_select(f'{short}_full', 'service', f'coalesce({breach}, false)', n, n)})"
        for name, _, short, breach, n in _SERVICE_PARTS)))
def service(spark, folder):
    error = F.col("event_type") == "error"
    api = F.col("user_id") % 3 == 0
    records = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(api, "api").otherwise("worker").alias("service"),
        (F.col("event_id") % 50 == 0).cast("int").alias("queue_depth"), error.cast("int").alias("errors"),
        (error & api).cast("int").alias("server_errors"), F.col("value").alias("latency"))
    states = alarms.service_alarms(records, period="3 hours", latency_threshold=150)
    return states.withColumn("period", shown("period"))
