"""Keyed tables: de-duplication, merge, and upsert into partitioned parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.snapshots import Generation, SnapshotLog
from corpusmill.session import checkpointed, delete_path, list_names, path_exists, scratch_path

BUCKET = "key_bucket"
_DATA = "data"


def require_columns(df: DataFrame, names: Sequence[str], what: str = "input") -> DataFrame:
    """Fail at once, naming every missing column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """One row per key, the greatest in ``order``; what still ties is settled by the rows' hash.

    An aggregate, not a window: copies of a hot key are reduced on the map side, so no task ever
    holds them all. The hash keeps the choice reproducible without sending every column twice.
    """
    others = [field for field in df.schema.fields if field.name not in keys]
    if not others:
        return df.distinct()
    hashed = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in others]
    ranking = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*hashed))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[f.name for f in others]), ranking).alias("picked"))
    return picked.select(*keys, "picked.*").select(*df.columns)


def merge(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows win; existing rows with other keys stay."""
    untouched = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(incoming)


def _places(kept: dict, bucket: str) -> list[str]:
    """The earlier folders of a bucket; generations of before named one or none."""
    places = kept.get(bucket) or []
    return [places] if isinstance(places, str) else places


class KeyedTable:
    """A parquet table with one row per key, kept current by upserts.

    Rows live in hash buckets of their key. An upsert writes its batch by bucket to a folder of its own and commits a
    generation that names the folders of every bucket. Of the earlier folders of a touched bucket, those without a replaced
    row stay where they are, those with replaced rows alone are named no more, and only of the others, or of more than
    ``FOLDERS``, the rows that stay are written again, beside the batch. Readers see one generation; a writer that fails before its commit leaves nothing but an unnamed folder. Of
    concurrent writers one commits first: the others keep what they wrote if it touched none of the same buckets, else
    they merge again. The number of buckets is kept with the generations; opening the table with another one is an error.

    Whole rows are shuffled only where a batch repeats keys, and where a folder loses some of its rows; else keys alone are.
    """

    #: Earlier folders of a bucket that stay beside a batch at most.
    FOLDERS = 8

    #: Times that a writer merges again when others were first.
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], *,
                 buckets: int = 64) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = StructType.fromDDL(schema)
        self.keys = list(keys)
        self.buckets = buckets
        self.log = SnapshotLog(spark, self.path)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def exists(self) -> bool:
        return self._generation() is not None

    def _generation(self, number: int | None = None) -> Generation | None:
        found = self.log.read(number)
        if found and found.parts["buckets"] != self.buckets:
            raise ValueError(f"{self.path} is laid out in {found.parts['buckets']} buckets, not in {self.buckets} buckets")
        return found

    def _at(self, generation: Generation | None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a generation, or of some of its buckets; no other bucket's files are listed."""
        folders = generation.parts["folders"] if generation else {}
        kept = generation.parts.get("kept", {}) if generation else {}
        wanted = [bucket for bucket in folders if buckets is None or int(bucket) in buckets]
        return self._of([(place, int(bucket)) for bucket in wanted for place in (folders[bucket], *_places(kept, bucket))])

    def _of(self, places: Sequence[tuple[str, int]]) -> DataFrame:
        """The rows that lie in these folders and buckets."""
        paths = [f"{self.path}/{place}/{BUCKET}={bucket}" for place, bucket in places]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, generation: int | None = None) -> DataFrame:
        """The latest rows, or those of an earlier generation."""
        return self._at(self._generation(generation)).select(*self.columns)

    def generations(self) -> list[int]:
        return self.log.numbers()

    def vacuum(self, keep: int = 1) -> None:
        """Delete what only generations before the latest ``keep`` need."""
        def named(parts: dict) -> set[str]:
            kept = parts.get("kept", {})
            # Rows that stayed lie in the folder of a batch, or below it.
            return set(parts["folders"].values()) | {"/".join(place.split("/")[:2]) for bucket in kept for place in _places(kept, bucket)}

        self.log.vacuum(keep, named, _DATA)

    def upsert(self, incoming: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
        """Merge a batch and return it as stored (de-duplicated).

        The batch is written first, where it stays: whatever it costs to compute is paid once, and the merge
        cannot see two versions of it.
        """
        folder = self._batch(incoming, order)
        return self._commit(lambda current: folder)

    def transact(self, decide: Callable[[DataFrame], DataFrame], order: Sequence[str | Column] = ()) -> DataFrame:
        """Upsert what ``decide`` makes of the table's rows; where another writer changed a bucket of it meanwhile, decide again."""
        return self._commit(lambda current: self._batch(decide(current), order))

    def _write(self, rows: DataFrame, folder: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.select(*self.columns).withColumn(BUCKET, bucket).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")

    def _written(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def _touched(self, folder: str) -> list[int]:
        """The buckets that a folder holds rows of."""
        return sorted(int(name.split("=")[1]) for name in list_names(self.spark, f"{self.path}/{folder}") if name.startswith(f"{BUCKET}="))

    def _batch(self, incoming: DataFrame, order: Sequence[str | Column]) -> str:
        """The folder of a batch with one row per key, written by bucket."""
        require_columns(incoming, self.keys, self.path)
        folder = f"{_DATA}/{uuid.uuid4().hex}"
        self._write(incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]), folder)
        rows = self._written(folder)
        repeated = rows.groupBy(*self.keys).agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(key).alias(f"{key}_again") for key in self.keys])
        if repeated.isEmpty():
            return folder
        repeated = checkpointed(repeated)
        # A null key equals a null key here, as it does in a grouping.
        same = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"{key}_again")) for key in self.keys])
        latest = latest_per_key(rows.join(repeated, same, "left_semi"), self.keys, order)
        single = f"{_DATA}/{uuid.uuid4().hex}"
        self._write(rows.join(repeated, same, "left_anti").unionByName(latest), single)
        delete_path(self.spark, f"{self.path}/{folder}")
        return single

    def _commit(self, batch_of: Callable[[DataFrame], str]) -> DataFrame:
        for _ in range(self.ATTEMPTS):
            base = self._generation()
            folder = batch_of(self._at(base).select(*self.columns))
            batch, touched = self._written(folder).select(*self.columns), self._touched(folder)
            if not touched:
                delete_path(self.spark, f"{self.path}/{folder}")
                return self.spark.createDataFrame([], self.schema).select(*self.columns)
            staying, mixed = self._staying(base, touched, batch.select(*self.keys))
            if mixed:
                kept = f"{folder}/_kept-{uuid.uuid4().hex}"
                bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
                rest = self._of(mixed).join(batch.select(*self.keys), self.keys, "left_anti").withColumn(BUCKET, bucket)
                self._write(rest.hint("rebalance", BUCKET).drop(BUCKET), kept)
                for number in self._touched(kept):
                    staying[number].append(kept)
            if self._commit_folder(base, touched, folder, staying):
                return batch
        raise RuntimeError(f"{self.path}: other writers were first {self.ATTEMPTS} times")

    def _staying(self, base: Generation | None, touched: list[int], incoming: DataFrame) -> tuple[dict[int, list[str]], list[tuple[str, int]]]:
        """Of each touched bucket the folders that stay as they are, and the (folder, bucket) whose rows are to be written again.

        Keys decide, so that neither replaced rows nor untouched ones are read or shuffled.
        """
        folders, kept = (base.parts["folders"], base.parts.get("kept", {})) if base else ({}, {})
        stored = [(place, bucket) for bucket in touched if str(bucket) in folders for place in (folders[str(bucket)], *_places(kept, str(bucket)))]
        staying: dict[int, list[str]] = {bucket: [] for bucket in touched}
        if not stored:
            return staying, []
        file = F.col("_metadata.file_path")
        keys = self._of(stored).select(
            *self.keys, F.regexp_extract(file, rf"({_DATA}/[^/]+(?:/_kept-[^/]+)?)/{BUCKET}=\d+/[^/]+$", 1).alias("place_"),
            F.regexp_extract(file, rf"/{BUCKET}=(\d+)/[^/]+$", 1).cast("int").alias(BUCKET))
        # The batch has one row per key, so the join keeps the number of rows.
        met = keys.join(incoming.withColumn("met_", F.lit(True)), self.keys, "left").groupBy("place_", BUCKET).agg(
            F.count("*").alias("n"), F.count("met_").alias("met"))
        counts = {(row["place_"], row[BUCKET]): (row["n"], row["met"]) for row in met.collect()}
        mixed = []
        for bucket in touched:
            left = [place for place, of in stored if of == bucket and counts.get((place, bucket), (0, 0))[0] > counts.get((place, bucket), (0, 0))[1]]
            whole = [place for place in left if not counts[place, bucket][1]]
            staying[bucket] = whole if len(whole) <= self.FOLDERS else []
            mixed += [(place, bucket) for place in left if place not in staying[bucket]]
        return staying, mixed

    def _commit_folder(self, base: Generation | None, touched: list[int], folder: str, staying: dict[int, list[str]]) -> bool:
        """Name the folders for the touched buckets in the next generation; False if one of them has changed since ``base``."""
        before = base.parts["folders"] if base else {}
        while True:
            latest = self._generation()
            now = latest.parts["folders"] if latest else {}
            if any(now.get(str(bucket)) != before.get(str(bucket)) for bucket in touched):
                return False
            folders = {**now, **{str(bucket): folder for bucket in touched}}
            rest = {**(latest.parts.get("kept", {}) if latest else {}), **{str(bucket): staying[bucket] for bucket in touched}}
            if self.log.commit(latest.number + 1 if latest else 0, {"buckets": self.buckets, "folders": folders, "kept": rest}):
                return True


class AppendTable:
    """A parquet table that streams add to: files lie by day of ``time`` and by batch, and none is rewritten.

    A batch that runs again replaces its own files. With ``keys``, reads show the row of the latest batch for
    each key. Reads of a span of days open no other day's files; :meth:`fold` merges the batches of old days.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), StructType.fromDDL(schema)
        self.time, self.keys = time, list(keys)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows.select(*self.schema.fieldNames()).withColumn("batch", F.lit(batch_id).cast("bigint")))

    def _write(self, rows: DataFrame) -> None:
        day = F.date_format(self.time, "yyyy-MM-dd")
        rows.withColumn("day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def _stored(self) -> DataFrame:
        full = StructType(list(self.schema.fields)).add("day", "string").add("batch", "long")
        if not path_exists(self.spark, f"{self.path}/day=*"):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def read(self, since: Column | None = None) -> DataFrame:
        """Rows from the day of ``since`` on; all without it."""
        stored = self._stored()
        if since is not None:
            stored = stored.filter(F.col("day") >= F.date_format(since, "yyyy-MM-dd"))
        stored = stored.drop("day")
        return (latest_per_key(stored, self.keys, ["batch"]) if self.keys else stored).drop("batch")

    def of_batch(self, batch_id: int) -> DataFrame:
        """The rows that a batch wrote; no other batch's files are read."""
        return self._stored().filter(F.col("batch") == batch_id).drop("day", "batch")

    def fold(self, before: str) -> None:
        """Put the rows of every day before ``before`` (yyyy-MM-dd) into one batch of that day, numbered -1.

        For a time without writers: the merged rows are written first, then the folded batches go.
        """
        old = self._stored().filter(F.col("day") < before)
        places = [(row["day"], row["batch"]) for row in old.select("day", "batch").distinct().collect() if row["batch"] >= 0]
        if not places:
            return
        merged = scratch_path(self.spark, "fold")
        (latest_per_key(old, self.keys, ["batch"]) if self.keys else old).drop("day", "batch").write.parquet(merged)
        for day, batch in places:
            delete_path(self.spark, f"{self.path}/day={day}/batch={batch}")
        self._write(self.spark.read.schema(self.schema).parquet(merged).withColumn("batch", F.lit(-1).cast("bigint")))
