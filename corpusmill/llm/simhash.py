"""SimHash near-duplicates: an inverted index over byte positions with a count filter.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight bytes, so
four shared positional bytes is the guaranteed minimum. Posting lists are kept for 20 triples of positions
chosen so that any four positions contain one of them; a pair that reaches the minimum therefore meets in
a list. There the shared bytes of each pair are tallied, pairs below four leave, the rest is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusmill.llm.common import first_by_hash, own_name, releasing, staged
from corpusmill.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of one posting list that meet in one task; longer lists are cut into pairs of blocks.
BLOCK = 16_384
_BLANKS = bytes([32, 9, 10, 11, 12, 13])
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER + _BLANKS, _UPPER.lower() + b" " * 6)


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that every four of the eight positions contain one (Turan's construction)."""
    group = (0, 0, 0, 1, 1, 1, 2, 2)
    chosen = []
    for triple in combinations(range(8), 3):
        sizes = [sum(group[at] == g for at in triple) for g in range(3)]
        if 3 in sizes or any(sizes[g] == 2 and sizes[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(triple)
    return chosen


def fingerprint_bits(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number; zero without words."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed=42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


@F.pandas_udf(LongType())
@releasing
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint as a signed long with the same bits."""
    for texts in batches:
        unsigned = np.array([fingerprint_bits(text) for text in texts], dtype=np.uint64)
        yield pd.Series(unsigned.view(np.int64))


def _stars(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Components of distinct sorted fingerprints: the members but the smallest, and the smallest.

    From each member reached, all that are not reached yet are compared at once, so a dense group costs
    few passes, and no pair is written out.
    """
    rest = values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue, members = [root], []
        while queue and len(rest):
            differing = rest ^ queue.pop()
            tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= 8 - MAX_BITS
            near[near] = np.bitwise_count(differing[near]) <= MAX_BITS
            if near.any():
                reached, rest = rest[near], rest[~near]
                members.append(reached)
                queue.extend(reached)
        if members:
            yield np.concatenate(members), root


def _links_of_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted posting lists, which may run over batch borders, and give the star edges of each."""
    carried = None
    for frame in batches:
        if carried is not None:
            frame = pd.concat([carried, frame], ignore_index=True)
        keys = frame[["key", "i", "j"]].to_numpy()
        border = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        cut = border[-1] if len(border) else 0
        carried = frame.iloc[cut:]
        if cut:
            yield from _star_rows(frame["fp"].to_numpy()[:cut], border[:-1])
    if carried is not None and len(carried):
        yield from _star_rows(carried["fp"].to_numpy(), np.array([], dtype=np.int64))


def _star_rows(values: np.ndarray, borders: np.ndarray) -> Iterator[pd.DataFrame]:
    starts = np.concatenate(([0], borders))
    ends = np.concatenate((borders, [len(values)]))
    long = ends - starts > 1
    left, right = [], []
    for start, end in zip(starts[long], ends[long]):
        for members, root in _stars(np.unique(values[start:end].view(np.uint64))):
            left.append(members)
            right.append(np.full(len(members), root))
    if left:
        yield pd.DataFrame({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})


def near_links(fingerprints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Star edges (a, b) that connect the distinct values of column ``fp`` as all links within four bits do."""
    keys = []
    for at, triple in enumerate(position_triples()):
        key = F.lit(at).cast("long")
        for position in triple:
            byte = F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    postings = fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long = long.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = (
        postings.join(long, "key", "left")
        .select("key", "fp", F.coalesce(mine, F.lit(0)).alias("m"), other.alias("o"))
        .select("key", "fp", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(_links_of_lists, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long), ``root`` (of its component), ``component_id``.

    Documents without words (null, empty, only white space) all have fingerprint zero and are linked like
    any other. Repeated rows stay repeated and share a component. ``component_id`` is the smallest
    non-null id of the component, null if it has none. Other columns of ``docs`` are not read; an empty
    table gives an empty result. Equal fingerprints are folded before anything is compared.
    """
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = staged(connected_components(near_links(distinct.select("fp"), block)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    places = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(places, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id, in its own columns.

    Of rows that agree in id and fingerprint the one with the smallest hash of all columns stays.
    """
    members = near_duplicates(docs, doc_id, text)
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp")).alias("k"))
    print_, key = own_name(docs, "fp"), own_name(docs, "key")
    named = lambda id_: F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit("n"))  # noqa: E731  a null id is a key too
    best = best.select(named(F.col("k.doc_id")).alias(key), F.col("k.fp").alias(print_))
    marked = docs.withColumn(print_, fingerprint(F.col(text))).withColumn(key, named(F.col(doc_id)))
    return first_by_hash(marked.join(best, [key, print_], "left_semi"), [key, print_], docs.columns)
