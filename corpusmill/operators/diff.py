"""What changed between two layers of a source, or between two texts."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import checkpointed


def _two_layers(chunks: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """Both layers as lines; a layer compared with itself counts on both sides."""
    def one(version: int, is_new: bool) -> DataFrame:
        return chunks.filter(F.col("layer_version") == version).select(
            "source_id", "ordinal", "content", F.lit(is_new).alias("is_new")
        )

    return one(from_version, False).unionByName(one(to_version, True))


def _counted(lines: DataFrame) -> DataFrame:
    """changed, added and removed lines per source that has a row in ``lines`` (hashed), from the ordered diff."""
    changes = _changes(lines.filter(F.col("line_hash").isNotNull())).groupBy("source_id").agg(
        F.count_if(F.col("op") == "+").alias("added"), F.count_if(F.col("op") == "-").alias("removed"))
    counts = lines.select("source_id").distinct().join(changes, "source_id", "left")
    added, removed = F.coalesce("added", F.lit(0)), F.coalesce("removed", F.lit(0))
    return counts.select(
        "source_id", (added + removed > 0).alias("changed"), added.alias("added_lines"), removed.alias("removed_lines"))


def layer_diff_counts(chunks: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """Counts of the ordered diff for every source that has both layers; a moved line is removed and added."""
    counts = _counted(_in_both(_hashed(_two_layers(chunks, from_version, to_version))))
    return counts.select(
        "source_id", F.lit(from_version).alias("from_version"), F.lit(to_version).alias("to_version"),
        "changed", "added_lines", "removed_lines",
    )


def split_lines(body: Column) -> Column:
    """Lines as Python's ``str.splitlines`` cuts them."""
    parts = F.split(body, r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_diff_counts(texts: DataFrame, key: str, original: str, suggestion: str) -> DataFrame:
    """Counts of the ordered diff between two text columns of a row, one row per unique ``key``."""
    sides = F.array(split_lines(F.col(original)), split_lines(F.col(suggestion)))
    both = texts.select(F.col(key).alias("source_id"), F.posexplode(sides).alias("at", "lines"))
    lines = both.select("source_id", (F.col("at") == 1).alias("is_new"), F.posexplode_outer("lines").alias("ordinal", "content"))
    return _counted(_hashed(lines)).withColumnRenamed("source_id", key).select(key, "changed", "added_lines", "removed_lines")


def anchored_pieces(lines: DataFrame) -> DataFrame:
    """Number the pieces of each source that can be diffed on their own, from lines with their ``line_hash``.

    Adds ``piece``, ``cut`` (the line is its piece's anchor) and ``shared`` (it is in both layers).
    An anchor is a line found once in either layer such that every other such line before it in one
    layer is before it in the other as well. Only hashes and positions are shuffled to find them,
    in windows over blocks of a source and never over a whole source. Steps that are read several
    times are checkpointed, or the plan would repeat them.
    """
    per_line = lines.groupBy("source_id", "line_hash").agg(
        F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n"),
        F.max(F.when(~F.col("is_new"), F.col("ordinal"))).alias("i"),
        F.max(F.when(F.col("is_new"), F.col("ordinal"))).alias("j"),
    )
    per_line = checkpointed(per_line)
    once = per_line.filter("o = 1 AND n = 1").select("source_id", "line_hash", "i", "j")
    shared = per_line.filter("o > 0 AND n > 0").select(
        "source_id", "line_hash", F.lit(True).alias("shared")
    )
    highest = checkpointed(running(once, "i", "j", F.max))
    lowest = running(highest, "i", "j", F.min, backwards=True)
    cuts = lowest.filter((F.col("max_j") == F.col("j")) & (F.col("min_j") == F.col("j"))).select(
        "source_id", "line_hash", F.lit(1).alias("cut")
    )
    flagged = lines.join(cuts, ["source_id", "line_hash"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    flagged = flagged.join(shared, ["source_id", "line_hash"], "left").withColumn("shared", F.col("shared").isNotNull())
    flagged = checkpointed(flagged)
    old = running(flagged.filter(~F.col("is_new")), "ordinal", "cut", F.sum)
    new = running(flagged.filter("is_new"), "ordinal", "cut", F.sum)
    return checkpointed(old.unionByName(new).withColumnRenamed("sum_cut", "piece"))


def running(df: DataFrame, order: str, value: str, fold, backwards: bool = False, block: int = 4096) -> DataFrame:
    """A running max, min or sum of ``value`` along ``order`` within each source, current row included.

    Two levels: totals per block of ``block`` positions are folded first (a source has few of them),
    then each block is a window of its own, so the largest window holds ``block`` rows.
    """
    from pyspark.sql import Window

    name = f"{fold.__name__}_{value}"
    blocked = df.withColumn("block", F.floor(F.col(order) / block))
    towards = F.col("block").desc() if backwards else F.col("block").asc()
    before = Window.partitionBy("source_id").orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("source_id", "block").agg(fold(value).alias("total")).select(
        "source_id", "block", fold("total").over(before).alias("carried")
    )
    along = F.col(order).desc() if backwards else F.col(order).asc()
    inside = Window.partitionBy("source_id", "block").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(totals, ["source_id", "block"]).withColumn("inner", fold(value).over(inside))
    if fold is F.sum:
        combined = F.coalesce("carried", F.lit(0)) + F.col("inner")
    else:
        combined = (F.greatest if fold is F.max else F.least)("carried", "inner")
    return joined.withColumn(name, combined).drop("block", "carried", "inner")


# Added lines of a piece sort after its removed ones.
_AFTER = 1 << 40


def _in_both(lines: DataFrame) -> DataFrame:
    """The lines of sources that have lines on both sides."""
    both = lines.groupBy("source_id").agg(F.bool_or("is_new").alias("n"), F.bool_or(~F.col("is_new")).alias("o")).filter("n AND o")
    return lines.join(both.select("source_id"), "source_id", "left_semi")


#: Lines of both sides that one task aligns at most; a longer piece is cut at the same share of both sides.
PIECE_LINES = 1_000_000


def _rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly rising run of picks from ``values``."""
    tails: list[int] = []
    places: list[int] = []
    before = np.full(len(values), -1, dtype=np.int64)
    for at, value in enumerate(values.tolist()):
        slot = bisect_left(tails, value)
        if slot:
            before[at] = places[slot - 1]
        if slot == len(tails):
            tails.append(value)
            places.append(at)
        else:
            tails[slot], places[slot] = value, at
    picked, at = [], places[-1] if places else -1
    while at >= 0:
        picked.append(at)
        at = before[at]
    return np.array(picked[::-1], dtype=np.int64)


def _nth(codes: np.ndarray) -> np.ndarray:
    """For each line, how many equal ones come before it."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    out = np.empty(len(codes), dtype=np.int64)
    out[order] = np.arange(len(codes)) - np.searchsorted(ordered, ordered)
    return out


def _common(old: np.ndarray, new: np.ndarray) -> int:
    """How many lines two sides begin with alike."""
    room, at, step = min(len(old), len(new)), 0, 16
    while at < room:
        stop = min(room, at + step)
        differ = old[at:stop] != new[at:stop]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = stop, step * 4
    return room


def _shortest(old: np.ndarray, new: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Lines that stay in a shortest script of removals and additions; None if that has more than ``limit`` of them.

    After d changes, ``reach`` holds how far into the old lines a script can be on each diagonal (old minus new place).
    """
    n, m = len(old), len(new)
    reach, trace = {0: _common(old, new)}, []
    starts = [{0: 0}]
    changes = 0
    while reach.get(n - m) != n:
        if changes == limit:
            return None
        changes += 1
        trace.append(reach)
        reach, start = {}, {}
        for k in range(-min(changes, m), min(changes, n) + 1):
            if (k - changes) % 2 == 0:
                down, right = trace[-1].get(k + 1, -1), trace[-1].get(k - 1, -1)
                x = max(down if down - k <= m else -1, right + 1 if 0 <= right < n else -1)
                if x >= 0:
                    start[k] = x
                    reach[k] = x + _common(old[x:], new[x - k :])
        starts.append(start)
    left, right_, k = [], [], n - m
    for d in range(changes, -1, -1):
        x, end = starts[d][k], reach[k]
        left.append(np.arange(x, end))
        right_.append(np.arange(x - k, end - k))
        if d:
            reach = trace[d - 1]
            k = k + 1 if reach.get(k + 1, -1) == x else k - 1
    return np.concatenate(left), np.concatenate(right_)


def matched(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines that stay, rising on both sides, from the lines' codes.

    A shortest script is looked for as long as it has few changes for the number of lines. Else the n-th line of a
    kind meets the n-th of that kind on the other side, a longest rising choice of these pairs stays, and the gaps
    between them are treated in the same way, until a gap has no line of both sides left. Time and memory grow with
    the number of lines.
    """
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    open_ = [(0, len(old), 0, len(new))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        here, there = old[i:i_end], new[j:j_end]
        if not np.isin(here, there).any():
            continue
        found = _shortest(here, there, math.isqrt(len(here) + len(there)) + 8)
        if found:
            left.append(found[0] + i)
            right.append(found[1] + j)
            continue
        width = max(len(here), len(there)) + 1
        _, at, to = np.intersect1d(here * width + _nth(here), there * width + _nth(there), assume_unique=True, return_indices=True)
        order = np.argsort(at)
        chosen = _rising(to[order])
        at, to = at[order][chosen] + i, to[order][chosen] + j
        left.append(at)
        right.append(to)
        starts = zip([i, *(at + 1).tolist()], [*at.tolist(), i_end], [j, *(to + 1).tolist()], [*to.tolist(), j_end])
        open_ += [gap for gap in starts if gap[0] < gap[1] and gap[2] < gap[3]]
    return np.sort(np.concatenate(left)), np.sort(np.concatenate(right))


def _hashed(lines: DataFrame, *columns: str) -> DataFrame:
    """Lines with the hash of their content (128 bits) and a ``line`` number of their own, written once; the content
    stays there if ``columns`` names it. What follows moves numbers and hashes only."""
    found = F.unhex(F.substring(F.sha2("content", 256), 1, 32))
    return checkpointed(lines.select(
        "source_id", "ordinal", "is_new", found.alias("line_hash"), F.monotonically_increasing_id().alias("line"), *columns))


def diff_rows(lines: DataFrame) -> DataFrame:
    """Changed lines ``source_id, piece, seq, op, ordinal, content`` from (source_id, ordinal, content, is_new)."""
    return _with_content(_hashed(lines, "content"))


def _with_content(stored: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The changes of the stored lines, or of those ``lines`` of them, with their contents."""
    # Joined by the side as well, so that whoever asks for one side's rows moves the contents of that side only.
    op = F.when(F.col("is_new"), "+").otherwise("-").alias("op")
    return _changes(stored if lines is None else lines).join(stored.select("line", op, "content"), ["op", "line"]).select(
        "source_id", "piece", "seq", "op", "ordinal", "content")


def _changes(stored: DataFrame) -> DataFrame:
    """Changed lines ``source_id, piece, seq, op, ordinal, line`` of hashed ones.

    A piece whose lines, its anchor aside, have no counterpart on the other side needs no alignment: its old
    lines go and its new ones come. Pieces with repeated or moved lines are aligned by their lines' hashes, one
    piece or PIECE_LINES of it in a task. ``ordinal`` is the place of the line on its own side.
    """
    keys, kind = ["source_id", "piece"], stored.schema["source_id"].dataType.simpleString()
    pieces = anchored_pieces(stored.select("source_id", "ordinal", "is_new", "line_hash", "line")).filter("cut = 0")
    pieces = pieces.withColumn("ordinal", F.col("ordinal").cast("long"))
    tangled = pieces.filter("shared").select(*keys).distinct()
    plain = pieces.join(tangled, keys, "left_anti").select(
        *keys, (F.col("ordinal") + F.when(F.col("is_new"), _AFTER).otherwise(0)).alias("seq"),
        F.when(F.col("is_new"), "+").otherwise("-").alias("op"), "ordinal", "line",
    )
    inside = checkpointed(pieces.join(tangled, keys, "left_semi").select(*keys, "ordinal", "is_new", "line_hash", "line"))
    # The lines of a piece are one run of places on each side; a long piece is cut at the same share of both.
    extent = inside.groupBy(*keys, "is_new").agg(F.min("ordinal").alias("first"), (F.max("ordinal") - F.min("ordinal") + 1).alias("span"), F.count("*").alias("n"))
    whole = extent.groupBy(*keys).agg(F.ceil(F.sum("n") / PIECE_LINES).alias("parts"))
    part = F.expr("((ordinal - first) * parts) div span").alias("part")
    hashed = inside.join(extent.join(whole, keys), [*keys, "is_new"]).select(
        *keys, part, "ordinal", "is_new", "line_hash")

    def align(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("ordinal")
        codes = pd.factorize(ordered["line_hash"])[0].astype(np.int64)
        is_new, ordinal = ordered["is_new"].to_numpy(dtype=bool), ordered["ordinal"].to_numpy(dtype=np.int64)
        stay = matched(codes[~is_new], codes[is_new])
        out = []
        for op, places, kept in (("-", ordinal[~is_new], stay[0]), ("+", ordinal[is_new], stay[1])):
            gone = np.setdiff1d(np.arange(len(places)), kept, assume_unique=True)
            # Changes lie between two lines that stay; of those in one gap the removed lines come first.
            out.append(pd.DataFrame({"gap": np.searchsorted(kept, gone), "op": op, "ordinal": places[gone]}))
        frame = pd.concat(out).sort_values(["gap", "op", "ordinal"], key=lambda c: c.map({"-": 0, "+": 1}) if c.name == "op" else c)
        seq = np.arange(len(frame), dtype=np.int64) + (int(key[2]) << 40)
        return frame[["op", "ordinal"]].assign(source_id=key[0], piece=key[1], seq=seq)

    changes = hashed.groupBy(*keys, "part").applyInPandas(align, f"source_id {kind}, piece long, seq long, op string, ordinal long")
    numbers = inside.select(*keys, F.when(F.col("is_new"), "+").otherwise("-").alias("op"), "ordinal", "line")
    aligned = changes.join(numbers, [*keys, "op", "ordinal"]).select(*keys, "seq", "op", "ordinal", "line")
    return checkpointed(plain.unionByName(aligned))


def diff_lines(chunks: DataFrame, from_version: int, to_version: int) -> DataFrame:
    """The diff of every source that has both layers, as rows, for sources of any length.

    Sorted by ``piece, seq`` the rows turn the old layer into the new one; :func:`apply_diff` does so.
    """
    stored = _hashed(_two_layers(chunks, from_version, to_version), "content")
    return _with_content(stored, _in_both(stored.drop("content")))


def apply_diff(old: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_id, ordinal, content) of the new layer from the old one's and the rows of a diff.

    Added lines have their places; the kept lines, in order, fill the places that are left. Both orders are
    counted over blocks of a source, from the places of lines alone.
    """
    marks = checkpointed(rows.select("source_id", "op", "ordinal"))
    removed, taken = (marks.filter(F.col("op") == op).select("source_id", "ordinal") for op in ("-", "+"))
    added = rows.filter("op = '+'").select("source_id", "ordinal", "content")
    lines = checkpointed(old.select(
        "source_id", F.col("ordinal").cast("long").alias("ordinal"), F.monotonically_increasing_id().alias("line"), "content"))
    kept = lines.select("source_id", "ordinal", "line").join(removed, ["source_id", "ordinal"], "left_anti")
    sizes = kept.select("source_id").unionByName(taken.select("source_id")).groupBy("source_id").agg(F.count("*").alias("n"))
    places = sizes.select("source_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))
    free = places.join(taken, ["source_id", "ordinal"], "left_anti")
    rank = lambda df: running(checkpointed(df.withColumn("one", F.lit(1))), "ordinal", "one", F.sum).withColumnRenamed("sum_one", "rank")
    filled = rank(kept).select("source_id", "rank", "line").join(
        rank(free).select("source_id", "rank", "ordinal"), ["source_id", "rank"])
    contents = filled.join(lines.select("line", "content"), "line").select("source_id", "ordinal", "content")
    return contents.unionByName(added)
