"""Exact and probed top-k over vector tables.

Scoring is a matrix product per Arrow batch inside the scan's own tasks. Each task keeps only its k
best rows per query, so no (query, vector) pair is ever a row and the table itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmill.session import scratch_path, spread

# Queries that travel to every task at once (more if they are short, up to so many components), and scores held at once.
ROUND, ROUND_COMPONENTS = 4096, 1 << 20
SCORES = 4_000_000
# Scores are ranked at this many decimals, so that equal vectors tie whatever block they were
# multiplied in, and ties go to the smaller id.
SCORE_DECIMALS = 9

METRICS = ("cosine", "dot")


def check_dimensions(vectors: DataFrame, dim: int, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows of the right size, rejected rows)."""
    fits = F.coalesce(F.size(embedding) == dim, F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)


class _Best:
    """The k best (query, id, score) seen so far, kept as arrays."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ids: np.ndarray | None = None

    def add(
        self, scores: np.ndarray, ids: np.ndarray, asked: np.ndarray | None = None, *, slack: float = 0.0,
        exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    ) -> None:
        """Scores are (queries, rows), of the queries ``asked`` if not all; -inf marks a pair that does not count.

        Scores of vectors with null or non-finite components do not count either, nor take a place among the k best.
        With ``exact`` the scores are off by ``slack`` at most, and it gives those of the pairs that may be among the best.
        """
        cut = self.floor.copy() if asked is None else self.floor[asked]
        # Only queries without k scores yet need the block's own k-th best.
        fresh = np.flatnonzero(np.isneginf(cut))
        if len(fresh) and scores.shape[1] > self.k:
            counted = np.where(np.isfinite(scores[fresh]), scores[fresh], -np.inf)
            cut[fresh] = np.partition(counted, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k] - slack
        local, row = np.nonzero(scores >= (cut - slack).astype(scores.dtype)[:, None])
        found = exact(local, row) if exact else scores[local, row]
        counts = np.isfinite(found) & (found >= cut[local])
        local, row, found = local[counts], row[counts], found[counts]
        if not len(local):
            return
        query = local if asked is None else asked[local]
        known = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, found])
        order = np.lexsort((known, -score, query))
        query, score, known = query[order], score[order], known[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.ids = query[kept], score[kept], known[kept]
        full = self.query[np.flatnonzero(place[kept] == self.k - 1)]
        self.floor[full] = self.score[place[kept] == self.k - 1]


def score_block(matrix: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Scores of every query row against every vector row. Query rows are unit length for cosine."""
    block = vectors.astype(np.float64)
    if metric == "cosine":
        lengths = np.linalg.norm(block, axis=1, keepdims=True)
        lengths[lengths == 0] = 1.0
        block = block / lengths
    return np.round(matrix @ block.T, SCORE_DECIMALS) + 0.0


def _add_cosines(best: _Best, queries: np.ndarray, rough: np.ndarray, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
    """Scores of unit vectors: products in single precision pick the pairs that may count, these are scored like in :func:`score_block`."""
    unit = query_matrix(vectors, "cosine")

    def exact(local: np.ndarray, row: np.ndarray) -> np.ndarray:
        steps = range(0, len(local), max(1, SCORES // max(1, unit.shape[1])))
        parts = [slice(at, at + steps.step) for at in steps]
        products = [np.einsum("ij,ij->i", queries[asked[local[part]]], unit[row[part]]) for part in parts]
        return np.round(np.concatenate([np.empty(0), *products]), SCORE_DECIMALS) + 0.0

    # Twice the rounding error of a product of unit vectors, and the rounding of scores.
    slack = (unit.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DECIMALS
    best.add(rough[asked] @ unit.astype(np.float32).T, ids, asked, slack=slack, exact=exact)


def query_matrix(vectors: list | np.ndarray, metric: str) -> np.ndarray:
    matrix = np.asarray(vectors, dtype=np.float64)
    if metric == "cosine":
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        lengths[lengths == 0] = 1.0
        matrix = matrix / lengths
    return matrix


def _to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def scan_top_k(
    vectors: DataFrame, matrix: np.ndarray, k: int, *, vector_id: str, embedding: str, metric: str = "cosine",
    group: str | None = None, members: dict | None = None,
) -> DataFrame:
    """Per-task k best as ``(query_no, <vector_id>, score)``.

    With ``group``, rows are scored only against the queries that ``members`` lists for their value of that
    column; queries under None are scored against every row.
    """
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((matrix, members))
    out = f"query_no int, {vector_id} {vectors.schema[vector_id].dataType.simpleString()}, score double"
    id_type = pa.string() if vectors.schema[vector_id].dataType.simpleString() == "string" else None

    def blocks(batch: pa.RecordBatch, known: dict | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, row numbers) to score together."""
        rows = np.arange(batch.num_rows)
        if known is None:
            yield np.arange(len(shared.value[0])), rows
            return
        if None in known:
            yield known[None], rows
        coded = batch.column(group).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for code, value in enumerate(coded.dictionary.to_pylist()):
            if value is not None and value in known:
                yield known[value], np.flatnonzero(codes == code)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, known = shared.value
        rough = queries.astype(np.float32) if metric == "cosine" else None
        best = _Best(len(queries), k)
        arrow_id = id_type
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow_id = arrow_id or batch.column(vector_id).type
            held, ids = _to_matrix(batch.column(embedding)), _ids(batch.column(vector_id))
            for asked, rows in blocks(batch, known):
                step = max(1, SCORES // max(1, len(asked)))
                for start in range(0, len(rows), step):
                    part = rows[start : start + step]
                    if rough is not None:
                        _add_cosines(best, queries, rough, held[part], ids[part], asked)
                    else:
                        best.add(score_block(queries[asked], held[part], metric), ids[part], asked)
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query, pa.int32()), pa.array(best.ids.tolist(), arrow_id), pa.array(best.score)],
                ["query_no", vector_id, "score"],
            )

    sized = vectors.filter(F.size(embedding) == matrix.shape[1]).select(vector_id, embedding, *([group] if group else []))
    return sized.mapInArrow(scan, out)


def rank(candidates: DataFrame, k: int, query: str, vector_id: str) -> DataFrame:
    """Global k best of the tasks' k best. The window keeps k rows per group before its shuffle too."""
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(vector_id))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def written(answers: DataFrame, label: str = "answers") -> DataFrame:
    """One round's answers in the shared folder, so that its queries are needed no more."""
    path = scratch_path(answers.sparkSession, label)
    answers.write.parquet(path)
    return answers.sparkSession.read.schema(answers.schema).parquet(path)


def query_rounds(queries: DataFrame, columns: list[str], query_id: str, query_embedding: str, size: int = ROUND) -> Iterator[tuple[list, int]]:
    """The queries in rounds of about ``size`` rows, dealt by a hash of their id, each with the number of rounds.

    Every query must have the same dimension.
    """
    lengths = queries.agg(F.count("*").alias("n"), F.min(F.size(query_embedding)).alias("low"), F.max(F.size(query_embedding)).alias("high")).first()
    if lengths["n"] and lengths["low"] != lengths["high"]:
        raise ValueError(f"queries have different dimensions: {lengths['low']} to {lengths['high']}")
    rounds = -(-lengths["n"] // size)
    for number in range(rounds):
        mine = F.pmod(F.xxhash64(query_id), F.lit(rounds)) == number
        rows = queries.filter(mine).select(*columns).collect()
        if rows:
            yield rows, rounds


def _distinct_rounds(
    queries: DataFrame, asked: list[str], query_embedding: str, size: int | None,
) -> Iterator[tuple[list, DataFrame, int]]:
    """The distinct (vector, scope) of the queries in rounds, dealt by their hash, each with the queries that ask them and the number of rounds."""
    part = F.xxhash64(*asked)
    lengths = queries.agg(
        F.count("*").alias("n"), F.min(F.size(query_embedding)).alias("low"), F.max(F.size(query_embedding)).alias("high"),
        F.approx_count_distinct(part, 0.01).alias("distinct")).first()
    if lengths["n"] and lengths["low"] != lengths["high"]:
        raise ValueError(f"queries have different dimensions: {lengths['low']} to {lengths['high']}")
    size = size or max(ROUND, ROUND_COMPONENTS // max(1, lengths["high"] or 1))
    rounds = -(-min(lengths["n"], lengths["distinct"]) // size)
    for number in range(rounds):
        mine = queries.filter(F.pmod(part, F.lit(rounds)) == number)
        rows = mine.select(*asked).distinct().collect()
        if rows:
            yield rows, mine, rounds


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, *, vector_id: str = "chunk_id", query_id: str = "query_id",
    embedding: str = "embedding", query_embedding: str = "query_embedding", metric: str = "cosine",
    scope: str | None = None, query_scope: str | None = None, round_size: int | None = None,
) -> DataFrame:
    """Best ``k`` vectors for every query: ``query_id, vector_id, score, rank``.

    With ``scope`` a query only meets rows whose scope equals its own; a null query scope meets all. Vectors of
    another size than the queries' are left out. Queries travel to the scan in rounds, so any number of them
    is answered without a copy of the vectors; a table in fewer files than cores is spread. Equal query vectors (of one
    scope) are scored once, whatever their ids. Of several rounds each is written before the next is asked for, so the
    driver holds the vectors of one.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r} (use one of {METRICS})")
    spark = vectors.sparkSession
    id_type, query_type = (df.schema[name].dataType.simpleString() for df, name in ((vectors, vector_id), (queries, query_id)))
    found = spark.createDataFrame([], f"{query_id} {query_type}, {vector_id} {id_type}, score double, rank int")
    if k < 1:
        return found
    scoped = bool(scope and query_scope)
    asked = [query_embedding] + ([query_scope] if scoped else [])
    queries = queries.select(*dict.fromkeys([query_id, *asked]))
    answers = []
    vectors = spread(vectors.select(*dict.fromkeys([vector_id, embedding, *([scope] if scoped else [])])))
    for rows, mine, rounds in _distinct_rounds(queries, asked, query_embedding, round_size):
        members, reached = None, vectors
        if scoped:
            members = {}
            for number, row in enumerate(rows):
                members.setdefault(row[query_scope], []).append(number)
            members = {value: np.array(numbers) for value, numbers in members.items()}
            if None not in members:
                reached = vectors.filter(F.col(scope).isin(*members))
        partial = scan_top_k(
            reached, query_matrix([row[query_embedding] for row in rows], metric), k, vector_id=vector_id, embedding=embedding,
            metric=metric, group=scope if scoped else None, members=members)
        numbers = spark.createDataFrame(
            [(number, *row) for number, row in enumerate(rows)],
            StructType([StructField("query_no", IntegerType()), *[StructField(f"{name}_", queries.schema[name].dataType) for name in asked]]))
        # A null scope is a scope of its own here, and equals itself.
        same = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"{name}_")) for name in asked])
        ids = mine.join(F.broadcast(numbers), same).select(query_id, "query_no")
        answer = rank(partial, k, "query_no", vector_id).join(ids, "query_no").select(query_id, vector_id, "score", "rank")
        answers.append(answer if rounds == 1 else written(answer))
        del partial, answer, numbers, ids
    return reduce(DataFrame.unionByName, answers, found)


def named(ranked: DataFrame, names: list, query_id: str, query_type: str, vector_id: str) -> DataFrame:
    """The ids of one round's queries in place of their numbers."""
    table = ranked.sparkSession.createDataFrame(list(enumerate(names)), f"query_no int, {query_id} {query_type}")
    return ranked.join(F.broadcast(table), "query_no").select(query_id, vector_id, "score", "rank")


def hits(ranked: DataFrame, chunks: DataFrame, query_id: str = "query_id", vector_id: str = "chunk_id") -> DataFrame:
    """Join ranked ids with their chunk rows (never the embedding)."""
    wanted = [name for name in chunks.columns if name not in ("embedding",)]
    return ranked.join(chunks.select(*wanted), vector_id)


def hit_lists(found: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with its hits in rank order; at most k of them, so the list is small."""
    fields = [name for name in ("rank", "chunk_id", "layer_version", "geological_age", "content", "score") if name in found.columns]
    return found.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("hits"))


def index_stats(vectors: DataFrame) -> DataFrame:
    """Rows per model and dimension."""
    return vectors.groupBy("model_id", "embed_dim").agg(F.count("*").alias("vectors"))
