"""Connected components of an edge table by alternating stars; no node's neighbours meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import staged


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, root): each linked node and the smallest node it reaches.

    A step links the larger neighbours of each node to its smallest neighbour, then the smaller ones.
    The number of edges never grows; steps end when the edges stop changing. Nodes without an edge to
    another node are absent, nulls are ignored, repeats and self-links change nothing.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = staged(current, "edges")
    seen = _fingerprint(current)
    while seen[0]:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = staged(moved.union(low).distinct(), "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
