"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

No text is shuffled to find copies. The first scan counts lengths; the second takes a prefix hash of the rows
whose length recurs and counts (length, prefix hash); the third takes the full hash of the rows whose pair
recurs. What survives a step is remembered as a bitmap over hashes, which can be broadcast at any input size:
that of lengths is fixed, that of pairs goes by their number up to a parameter. A bit shared by chance costs a
hash and changes nothing, since groups form by the full hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import first_by_hash, own_name, staged

#: Bits of the maps, broadcast as bits / 64 rows of two longs: of lengths, and of pairs at least and at most.
LENGTH_BITS, LEAST_BITS, MOST_BITS = 1 << 20, 1 << 20, 1 << 26
#: Bits per surviving pair.
SPARSE = 16
#: Places in which a group's rows meet its result.
SALTS = 32
#: Characters that the second refinement hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def _slot(length: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(bits).cast("long"))


def _prefix(bare: Column) -> Column:
    return F.xxhash64(F.substring(bare, 1, PREFIX))


def _bitmap(slots: DataFrame) -> DataFrame:
    """Words (``at``, ``word``) of the bitmap in which the numbers in ``slot`` are set."""
    return slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("word"))


def _looked_up(rows: DataFrame, slot: Column, words: DataFrame, hit: str) -> DataFrame:
    """``rows`` with a boolean ``hit``: the bit of ``slot`` is set in ``words``, which holds a bounded number of rows."""
    at, word, place = (own_name(rows, name) for name in ("at", "word", "slot"))
    words = words.select(F.col("at").alias(at), F.col("word").alias(word))
    found = rows.withColumn(place, slot).withColumn(at, F.shiftright(place, 6)).join(F.broadcast(words), at, "left")
    bit = F.expr(f"shiftrightunsigned(coalesce(`{word}`, 0L), cast(`{place}` % 64 AS int)) & 1") == 1
    return found.withColumn(hit, bit).drop(at, word, place)


def _length_slot(length: Column) -> Column:
    return F.pmod(length.cast("long"), F.lit(LENGTH_BITS).cast("long"))


def survivor_map(docs: DataFrame, text: str = "text", bits: int | None = None) -> tuple[DataFrame, int]:
    """Words (``at`` long, ``word`` long) of the bitmap of (length, prefix hash) pairs that occur more than once, and its bits."""
    bare = docs.select(normalised(F.col(text)).alias("bare"))
    lengths = bare.groupBy(F.length("bare").alias("length")).agg(F.count("*").alias("n")).where("n > 1")
    recurring = staged(_bitmap(lengths.select(_length_slot(F.col("length")).alias("slot"))), "lengths")
    close = _looked_up(bare, _length_slot(F.length("bare")), recurring, "close").where("close")
    pairs = close.groupBy(F.length("bare").alias("length"), _prefix(F.col("bare")).alias("prefix")).agg(F.count("*").alias("n"))
    pairs = staged(pairs.where("n > 1").select("length", "prefix"), "prefixes")
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * pairs.count()).bit_length()))
    return _bitmap(pairs.select(_slot(F.col("length"), F.col("prefix"), bits).alias("slot"))), bits


def _marked(docs: DataFrame, text: str, bits: int | None) -> tuple[DataFrame, str, str]:
    """``docs`` with the bare text and the full hash, null where no other row can have it."""
    bare, full, hit = (own_name(docs, name) for name in ("bare", "full_hash", "hit"))
    words, bits = survivor_map(docs, text, bits)
    found = docs.withColumn(bare, normalised(F.col(text)))
    found = _looked_up(found, _slot(F.length(bare), _prefix(F.col(bare)), bits), staged(words, "survivors"), hit)
    return found.withColumn(full, F.when(F.col(hit), F.sha2(F.col(bare), 256))).drop(hit), bare, full


def _salted(best: DataFrame, salt: str) -> DataFrame:
    """A group that is too large for one task meets its one row in SALTS places."""
    return best.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _best(hashed: DataFrame, full: str) -> DataFrame:
    """Per full hash: the row that stays (most code points, then smallest id; a null id comes last) and the size."""
    order = F.struct((-F.col("points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    return hashed.groupBy(full).agg(F.min(order).alias("k"), F.count("*").alias("group_size")).select(
        full, F.col("k.c").alias("keep_id"), (-F.col("k.a")).alias("keep_points"), "group_size")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None, digest_all: bool = False) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, full_hash``.

    Texts are equal when they agree after all white space is deleted; null counts as empty, so null, empty and
    blank texts form one group. ``full_hash`` (SHA-256) is null for rows that a shorter look already told
    apart, unless ``digest_all``. Of rows that agree in text and id, all are marked kept when they are the
    best; ``keep_one`` leaves a single row. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked, bare, full = _marked(rows, "text", bits)
    digest = F.coalesce(full, F.sha2(F.col(bare), 256)) if digest_all else F.col(full)
    marked = staged(marked.select(
        "doc_id", full, F.coalesce(F.length("text"), F.lit(0)).alias("points"), digest.alias("digest")), "hashes")
    alone = marked.where(F.col(full).isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("digest").alias("full_hash"))
    rest = marked.where(F.col(full).isNotNull()).withColumn("salt", F.pmod(F.xxhash64("doc_id", "points"), F.lit(SALTS)))
    groups = _salted(_best(rest, full), "salt")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return alone.unionByName(rest.join(groups, [full, "salt"]).select(
        "doc_id", "keep_id", "group_size", best.alias("kept"), F.col("digest").alias("full_hash")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns.

    Rows that refinement told apart pass through where they are; only the rest is shuffled, by full hash. Of rows
    that agree in id and text but not in other columns the one with the smallest hash of all columns stays.
    """
    marked, bare, full = _marked(docs, text, bits)
    marked = marked.drop(bare)
    alone = marked.where(F.col(full).isNull()).drop(full)
    keep, points, salt = (own_name(docs, name) for name in ("keep_id", "keep_points", "salt"))
    length = F.coalesce(F.length(text), F.lit(0))
    rest = marked.where(F.col(full).isNotNull()).withColumn(salt, F.pmod(F.xxhash64(doc_id, length), F.lit(SALTS)))
    best = _best(rest.select(full, F.col(doc_id).alias("doc_id"), length.alias("points")), full)
    best = _salted(best.select(full, F.col("keep_id").alias(keep), F.col("keep_points").alias(points)), salt)
    kept = rest.join(best, [full, salt]).where(F.col(doc_id).eqNullSafe(F.col(keep)) & (length == F.col(points)))
    return alone.unionByName(first_by_hash(kept, [full], docs.columns))
