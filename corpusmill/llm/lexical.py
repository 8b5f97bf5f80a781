"""Ranked lexical search: impact tiles of documents times weight tiles of items, as dense float64 products.

Items come in rounds. A round's distinct terms are its compact vocabulary; one scan of the texts counts them in
every document and the length of each. Then blocks of documents meet the vocabulary: a tile holds the impacts
of some documents for those of its terms that occur there, a second tile the weights of the same terms in all
items, and BLAS multiplies them. All entries are whole numbers and a tile's terms are cut where a sum could reach
2^53, so products are exact; tiles are added as 64-bit integers. A task keeps the k best rows per item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import staged

TOP = 10
#: Items, and distinct (term, item) entries, that travel to every task in one round. Each round scans the texts once.
ITEMS, ENTRIES = 1_024, 2_000_000
#: Documents and terms of a tile at most.
DOCS, TERMS = 512, 2_048
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
# An impact is below IMPACT, and sums in a product stay below EXACT.
IMPACT, EXACT = 1_000_000, 1 << 53
_NO_ID = np.iinfo(np.int64).max

# Letters and digits stay, A-Z becomes a-z, all bytes of longer code points stay, every other byte ends a term.
_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of all terms of a text in UTF-8, and how often those of the vocabulary occur."""
    plain, total, counts, at = text.translate(_BYTES), 0, Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        total += len(words)
        counts.update(map(vocabulary.get, words))
        at = end
    del counts[None]
    return total, counts


def _all_terms(text: str | None) -> Counter:
    return Counter((text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split())


def _rounds(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items as (id, counted terms), so many at a time that a round stays within ITEMS and ENTRIES."""
    chunk, entries = [], 0
    for row in items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).toLocalIterator():
        terms = _all_terms(row["text"])
        if chunk and (len(chunk) == ITEMS or entries + len(terms) > ENTRIES):
            yield chunk
            chunk, entries = [], 0
        chunk.append((row["item"], terms))
        entries += len(terms)
    if chunk:
        yield chunk


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written rows (doc_id, n, terms, tfs) of all documents with a term; the last two are arrays as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one round

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts, rows, sizes, terms, tfs = batch.column(1), [], [], [], []
            for at in range(batch.num_rows):
                value = texts[at].as_py()
                total, counts = term_counts(value, known) if value else (0, None)
                if total:
                    rows.append(at)
                    sizes.append(total)
                    terms.append(np.fromiter(counts.keys(), "<i4", len(counts)).tobytes())
                    tfs.append(np.fromiter(counts.values(), "<u4", len(counts)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                ["doc_id", "n", "terms", "tfs"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return staged(chosen.mapInArrow(counted, "doc_id long, n long, terms binary, tfs binary"), "terms")


def _collection(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and document frequencies by term number."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(2, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            totals += (batch.num_rows, int(np.sum(batch.column(0).to_numpy(zero_copy_only=False))))
            numbers = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i4")
            seen += np.bincount(numbers, minlength=size)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *found.tolist()], pa.int32()), pa.array([*totals.tolist(), *seen[found].tolist()], pa.int64())], ["term", "n"])

    rows = counted.select("n", "terms").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {row["term"]: row["n"] for row in rows.collect()}  # at most the terms of a round and two
    df = np.zeros(size, dtype=np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Weights:
    """Weight of each term in each item: rows of a matrix, kept as (item, value) pairs sorted by term."""

    def __init__(self, round_: list[tuple], numbers: dict[bytes, int], documents: int, df: np.ndarray) -> None:
        entries = [(numbers[term], item, term_weight(documents, int(df[numbers[term]])) * times)
                   for item, (_, terms) in enumerate(round_) for term, times in terms.items() if df[numbers[term]]]
        table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 3)
        self.items = len(round_)
        self.item, self.value = table[:, 1].astype(np.int32), table[:, 2]
        self.start = np.searchsorted(table[:, 0], np.arange(len(numbers) + 1))
        self.largest = np.zeros(len(numbers), dtype=np.int64)
        np.maximum.at(self.largest, table[:, 0], table[:, 2])

    def tiles(self, terms: np.ndarray) -> Iterator[np.ndarray]:
        """Runs of ``terms`` whose sums of products stay below EXACT."""
        begin, held = 0, 0
        for at, largest in enumerate(np.minimum(self.largest[terms], self.step).tolist()):
            if at - begin == TERMS or held + largest > self.step:
                yield terms[begin:at]
                begin, held = at, 0
            held += largest
        if begin < len(terms):
            yield terms[begin:]

    #: Largest sum of weights times impacts below EXACT.
    step = EXACT // IMPACT - 1

    def dense(self, terms: np.ndarray) -> Iterator[np.ndarray]:
        """(terms, items) float64 tiles that add up to the weights, none with an entry above ``step``."""
        counts = self.start[terms + 1] - self.start[terms]
        row = np.repeat(np.arange(len(terms)), counts)
        place = np.repeat(self.start[terms] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        values = self.value[place]
        while len(values):
            tile = np.zeros((len(terms), self.items))
            tile[row, self.item[place]] = np.minimum(values, self.step)
            yield tile
            values = values - np.minimum(values, self.step)
            if not values.any():
                return


def scores(batch: pa.RecordBatch, weights: Weights, documents: int, total: int) -> np.ndarray:
    """(documents, items) scores of a block of counted documents, as exact 64-bit integers."""
    terms = [np.frombuffer(value, dtype="<i4") for value in batch.column(2).to_pylist()]
    row = np.repeat(np.arange(batch.num_rows), [len(part) for part in terms])
    term = np.concatenate(terms) if terms else np.empty(0, dtype="<i4")
    tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u4").astype(np.int64)
    n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    m = 100 - 75 + (75 * n * documents) // total
    impact = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row])).astype(np.float64)
    used, column = np.unique(term, return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[by_column], np.arange(len(used) + 1))
    out, begin = np.zeros((batch.num_rows, weights.items), dtype=np.int64), 0
    for tile in weights.tiles(used):
        held = by_column[edges[begin] : edges[begin + len(tile)]]
        impacts = np.zeros((batch.num_rows, len(tile)))
        impacts[row[held], column[held] - begin] = impact[held]
        for values in weights.dense(tile):
            out += (impacts @ values).astype(np.int64)
        begin += len(tile)
    return out


class _Best:
    """The k best (item, score, document) so far; of equal scores the smaller ids."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.item, self.score, self.doc = (np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, found: np.ndarray, docs: np.ndarray) -> None:
        cut = self.floor
        if len(docs) > self.k:
            cut = np.maximum(cut, np.partition(found, len(docs) - self.k, axis=0)[len(docs) - self.k])
        row, item = np.nonzero(found >= cut)
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, found[row, item[len(self.item) :]]])
        doc = np.concatenate([self.doc, docs[row]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        last = rank[kept] == self.k - 1
        self.floor[self.item[last]] = self.score[last]


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all other code points from U+0080 on, A-Z lower-cased; a
    null or empty text has none. Documents without a term count nowhere. Only scores above 0 are ranked, equal
    ones by ascending id, a null id last. Repeated rows of either table count as rows of their own; other columns
    are not read; without items or documents there are no rows.
    """
    spark, parts = docs.sparkSession, []
    kind = items.schema[item_id].dataType.simpleString()
    for round_ in _rounds(items, item_id, item_text):
        words = sorted(set().union(*(terms for _, terms in round_)))
        numbers = {word: at for at, word in enumerate(words)}
        counted = count_terms(docs, numbers, doc_id, text)
        documents, total, df = _collection(counted, len(numbers))
        if not total:
            continue
        shared = spark.sparkContext.broadcast((Weights(round_, numbers, documents, df), documents, total))  # at most ENTRIES entries

        def ranked(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, documents, total = shared.value
            best = _Best(weights.items, k)
            for block in (whole.slice(at, DOCS) for whole in batches for at in range(0, whole.num_rows, DOCS)):
                ids = block.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                best.add(scores(block, weights, documents, total), ids)
            made = pa.array(best.doc, pa.int64(), mask=best.doc == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), made, pa.array(best.score, pa.int64())], ["item", "doc_id", "score"])

        best = staged(counted.mapInArrow(ranked, "item int, doc_id long, score long"), "ranked")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(at, item) for at, (item, _) in enumerate(round_)], f"item int, item_id {kind}")
        parts.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(
            F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most ITEMS rows
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
