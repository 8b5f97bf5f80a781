"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time, points (time, weight) joined by straight lines. Running
sums over its pieces integrate it to the cumulative token demand; a search among the pieces and the root of
the piece's quadratic invert that demand at a document's place in its source's stream, which gives the
document's training position. Rows are then sorted by range of position.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, staged

#: Weights by rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words that the mix takes, as a share of all words.
SHARE = 1.5
#: A target stops at so many times the words of its source.
MOST = 2.0
#: Schedules by rank of the source, repeating: earlier, even, later. Points (time from 0 to 1, weight).
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hex digits of the stream order that name a block of a source; a hot source is summed in 16^3 blocks.
DIGITS = 3


def words_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to ``source, source_size, rank, target``, one row per source.

    Sharing the excess of full sources again and again ends where every source that is not full has
    ``level * weight``. Sources fill up in order of ``most * size / weight``, so running sums in that order
    give the level in one pass.
    """
    ordered = W.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", _cycle(F.col("rank"), weights))
    weighed = weighed.withColumn("most", F.lit(most) * F.col("source_size"))
    filling = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    levelled = weighed.withColumn(
        "level",
        (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
    below = F.col("level") * F.col("weight") < F.col("most")
    level = F.min(F.when(below, F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)
    first = levelled.withColumn("first", level)
    target = F.when(F.col("first").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("first")["level"] * F.col("weight")))
    return first.select("source", "source_size", F.col("rank").cast("long").alias("rank"), target.alias("target"))


def _checked(points: tuple) -> tuple:
    """The points of a schedule: times from 0 to 1 that rise, weights of 0 or more and not all 0."""
    times, weights = [float(time) for time, _ in points], [float(weight) for _, weight in points]
    rises = all(low < high for low, high in zip(times, times[1:]))
    if len(times) < 2 or times[0] != 0 or times[-1] != 1 or not rises or min(weights) < 0 or not max(weights) < float("inf") or max(weights) == 0:
        raise ValueError(f"not a schedule: {points}")
    return tuple(zip(times, weights))


def demand_pieces(sources: DataFrame, schedules: tuple = SCHEDULES, given: Mapping[str | None, tuple] | None = None) -> DataFrame:
    """(source, rank) to ``source, pieces, demand``, one row per source; ``given`` names the schedules of single sources.

    A piece holds its start, length, weight there, slope, and ``before``, the demand of all pieces before it, a
    running sum; ``demand`` is the sum over all. Pieces without demand are left out: no document falls there.
    """
    def literal(points: tuple) -> Column:
        checked = _checked(points)
        return F.array(*[
            F.struct(F.lit(t0).alias("start"), F.lit(t1 - t0).alias("length"), F.lit(w0).alias("weight"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"))
            for (t0, w0), (t1, w1) in zip(checked, checked[1:])])

    place = F.pmod(F.col("rank") - 1, F.lit(len(schedules)))
    chosen = F.coalesce(*[F.when(place == at, literal(points)) for at, points in enumerate(schedules)])
    for name, points in (given or {}).items():
        chosen = F.when(F.col("source").eqNullSafe(F.lit(name)), literal(points)).otherwise(chosen)
    each = sources.select("source", F.inline(chosen))
    area = F.col("length") * (F.col("weight") + F.col("slope") * F.col("length") / 2)
    upto = W.partitionBy("source").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    summed = each.withColumn("area", area).where("area > 0").withColumn("before", F.coalesce(F.sum("area").over(upto), F.lit(0.0)))
    piece = F.struct("start", "before", "length", "weight", "slope")
    return summed.groupBy("source").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max(F.col("before") + F.col("area")).alias("demand"))


def _position(begin: Column, target: Column, pieces: Column, demand: Column) -> Column:
    """The time at which the demand of a source reaches ``begin`` words: its piece by search, then the root inside."""
    wanted = F.least(F.lit(1.0), begin / target) * demand
    found = F.element_at(F.filter(pieces, lambda piece: piece["before"] <= wanted), -1)
    rest = wanted - found["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), found["weight"] * found["weight"] + F.lit(2.0) * found["slope"] * rest))
    inside = F.coalesce(F.try_divide(F.lit(2.0) * rest, found["weight"] + root), F.lit(0.0))
    return found["start"] + F.least(found["length"], inside)


def _placed(rows: DataFrame, weights: tuple, share: float, most: float, schedules: tuple, given: Mapping | None) -> DataFrame:
    """Rows (doc_id, text, source, ...) with size, begin in the stream of their source, target and what is taken."""
    sized = rows.withColumn("size", words_of(F.col("text"))).drop("text")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = sized.withColumn("order", digest).withColumn("block", F.substring("order", 1, DIGITS))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # null is a source too
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = staged(blocks.withColumn("named", named), "blocks")
    totals = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, most).withColumn("named", named)
    pieces = demand_pieces(targets, schedules, given).withColumn("named", named).drop("source")
    targets = targets.join(pieces, "named").drop("source", "rank")  # a row per source
    earlier = W.partitionBy("named").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(targets, "named")
    starts = starts.select("named", "block", "start", "source_size", "target", "pieces", "demand")
    joined = sized.withColumn("named", named).join(starts, ["named", "block"])
    inside = W.partitionBy("named", "block").orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = joined.withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    last = F.floor(F.col("target") - passes * F.col("source_size") + F.lit(0.5))
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("begin")))
    placed = placed.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(F.try_divide(F.col("taken") * 2 + F.col("size"), F.col("size") * 2))).otherwise(0)
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.withColumn(
        "position", F.when(F.col("taken") > 0, _position(F.col("begin"), F.col("target"), F.col("pieces"), F.col("demand"))))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, most: float = MOST, schedules: tuple = SCHEDULES,
        given: Mapping[str | None, tuple] | None = None) -> DataFrame:
    """Columns ``doc_id, size, source_size, target, taken, copies, position``, one row per document, range-sorted by position.

    Documents of a source stream in the order of a digest of their id; whole passes are taken while the target
    holds them, and the last pass ends where the target ends, inside a document if need be. ``taken`` counts
    the words, ``copies`` is taken / size rounded half up (0 for a document without words), ``position`` is
    the time in [0, 1] of the first word taken, null when none is. The null source is one source of its own
    and sorts last; null ids share one digest and then go by size; rows that agree in both are equal. Other
    columns are not read. Schedules go by rank of the source, repeating, unless ``given`` has the source's own.
    A source, or a table, without words has target 0; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    placed = _placed(rows, weights, share, most, schedules, given)
    found = placed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    # The ids part the documents that the mix leaves out, which have no position.
    return found.repartitionByRange("position", "doc_id", "size").sortWithinPartitions("position", "doc_id", "size")


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                   weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
                   schedules: tuple = SCHEDULES, given: Mapping[str | None, tuple] | None = None) -> DataFrame:
    """``docs`` in its own columns, each row as often as ``copies`` says, range-sorted by training position."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), F.struct(*docs.columns).alias("row"))
    placed = _placed(rows, weights, share, most, schedules, given).where("copies > 0")
    each = placed.withColumn("pass", F.explode(F.expr("sequence(0L, copies - 1)")))
    begin = F.col("begin") + F.col("source_size") * F.col("pass")
    ordered = each.select("row", "doc_id", _position(begin, F.col("target"), F.col("pieces"), F.col("demand")).alias("position"))
    return ordered.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")
