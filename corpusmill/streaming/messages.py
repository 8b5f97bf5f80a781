"""Queue messages to object tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the probe a storage service sends when a notification is set up.
PROBE_EVENT = "s3:TestEvent"
_RECORDS = "array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"

TASK, NOTHING, DEAD = "task", "nothing", "dead"


def unquote_plus(key: Column) -> Column:
    """URL decoding with plus as space; a percent sign that begins no escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25"))


def parse_messages(messages: DataFrame, body: str = "body") -> DataFrame:
    """One row per task, or one row for a message without any.

    Adds ``parsed`` (``task``, ``nothing`` to do, or ``dead``), ``bucket`` and ``key``. Checked in
    this order: the probe, ``Records`` (keys decoded, malformed records skipped), a direct
    ``{bucket, key}`` (taken literally), anything else is dead.
    """
    raw = F.col(body)
    names = F.when(F.try_parse_json(raw).isNotNull(), F.json_object_keys(raw))
    records = F.from_json(F.get_json_object(raw, "$.Records"), _RECORDS)
    none = F.array().cast("array<struct<bucket:string,key:string>>")

    def from_record(record: Column) -> Column:
        s3 = record["s3"]
        return F.struct(s3["bucket"]["name"].alias("bucket"), unquote_plus(s3["object"]["key"]).alias("key"))

    usable = F.filter(
        F.transform("_records", from_record),
        lambda t: (F.coalesce(F.length(t["bucket"]), F.lit(0)) > 0) & (F.coalesce(F.length(t["key"]), F.lit(0)) > 0),
    )
    direct = F.array(F.struct(F.get_json_object(raw, "$.bucket").alias("bucket"), F.get_json_object(raw, "$.key").alias("key")))
    has = lambda name: F.array_contains("_names", name)
    tasks = (
        F.when(F.col("_names").isNull(), None)
        .when(F.coalesce(F.get_json_object(raw, "$.Event") == PROBE_EVENT, F.lit(False)), none)
        .when(has("Records"), usable)
        .when(has("bucket") & has("key"), direct)
    )
    staged = messages.withColumn("_names", names).withColumn("_records", records).withColumn("_tasks", tasks)
    exploded = staged.select(*messages.columns, "_tasks", F.explode_outer("_tasks").alias("_task"))
    state = F.when(F.col("_tasks").isNull(), DEAD).when(F.size("_tasks") == 0, NOTHING).otherwise(TASK)
    return exploded.select(
        *messages.columns, state.alias("parsed"), F.col("_task.bucket").alias("bucket"), F.col("_task.key").alias("key")
    )
