"""Near-duplicate vectors: int8 tile products with an error bound per vector, then full precision.

Equal vectors are folded first. The rest is dealt into tiles and every two tiles meet in one task. A unit
vector x is held as s * q with int8 q and the exact length e of its error; for two of them
|x.y - s t q.r| <= |s q| f + e. Pairs whose product can reach the threshold within that bound are computed
again in double precision. A task gives numbers of links and a spanning forest, not pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import merge_labels, staged
from corpusmill.llm.components import connected_components

THRESHOLD = 0.95
#: Vectors of a tile and rows that are multiplied with a tile at once.
TILE, ROWS = 8_192, 512
#: Pairs computed again at once.
PAIRS = 200_000
#: Room for rounding of the bounds themselves.
SLACK = 1e-6


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 codes, scales, lengths of the held vectors and lengths of their errors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    held = codes * scale[:, None]
    return codes, scale, np.linalg.norm(held, axis=1), np.linalg.norm(unit - held, axis=1)


def tile_links(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Linked positions (a, b) of rows ``left`` with rows ``right``, in blocks; with itself each pair comes once."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    codes, scale, held, error = quantised(unit)
    whole = codes.astype(np.float32)  # products of int8 codes stay whole numbers in single precision up to 1040 dimensions
    exact = vectors.shape[1] * 127 * 127 < 1 << 24
    same = left is right
    rights = np.ascontiguousarray(whole[right].T) if exact else codes[right].astype(np.float64).T
    least_inverse, most_error = (1.0 / scale[right]).min(), (error[right] / scale[right]).max()
    for start in range(0, len(left), ROWS):
        rows = left[start : start + ROWS]
        product = (whole[rows] if exact else codes[rows].astype(np.float64)) @ rights
        need = (threshold - SLACK - error[rows]) / scale[rows] * least_inverse - held[rows] / scale[rows] * most_error
        a, b = np.nonzero(product >= need[:, None].astype(product.dtype) - 1)
        if same:
            later = b > a + start
            a, b = a[later], b[later]
        x, y = rows[a], right[b]
        bound = product[a, b] * scale[x] * scale[y] + held[x] * error[y] + error[x] + SLACK
        x, y = x[bound >= threshold], y[bound >= threshold]
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            if near.any():
                yield i[near], j[near]


def _meet(threshold: float):
    def links(key, frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(frame["vector"].tolist(), dtype=np.float64)
        tile, rows = frame["tile"].to_numpy(), np.arange(len(frame))
        left = rows[tile == key[0]]
        right = left if key[0] == key[1] else rows[tile == key[1]]
        copies, labels = frame["copies"].to_numpy(), np.arange(len(frame))
        degree = np.zeros(len(frame), dtype=np.int64)
        if len(left) and len(right):
            for a, b in tile_links(vectors, left, right, threshold):
                degree += np.bincount(a, weights=copies[b], minlength=len(frame)).astype(np.int64)
                degree += np.bincount(b, weights=copies[a], minlength=len(frame)).astype(np.int64)
                labels = merge_labels(labels, a, b)
        linked = np.flatnonzero(degree)
        ids = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": ids[linked], "links": degree[linked], "root": ids[labels[linked]]})

    return links


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vector; cosine in double precision.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing and are their own
    component; so do vectors of another dimension than the one compared with. Copies link with each other and
    share one comparison. ``component_id`` is the smallest non-null id; a null id is kept if its component
    has no other. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), F.transform("vector", lambda x: x + F.lit(0.0))))
    valid = rows.where(F.col("vector").isNotNull())
    reps = valid.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    tiles = reps.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiles = tiles.withColumn("base", F.sum("tiles").over(W.orderBy("dim")).cast("int") - F.col("tiles"))
    # One row per dimension in use, so no more rows than the longest vector has components.
    dealt = reps.withColumn("dim", F.size("vector")).join(F.broadcast(tiles), "dim")
    dealt = dealt.withColumn("tile", F.col("base") + F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.select("rep", "copies", "vector", "tile", F.explode(F.expr("sequence(base, base + tiles - 1)")).alias("other"))
    dealt = dealt.select("rep", "copies", "vector", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    met = dealt.groupBy("i", "j").applyInPandas(_meet(threshold), "rep long, links long, root long")
    met = staged(met, "tile_links")
    roots = connected_components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = staged(known.join(smallest, "root").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector_links")
    linked = valid.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
