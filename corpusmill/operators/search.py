"""Case-insensitive substring search, by scan and by trigram postings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import rows_within

GRAM = 3
# Candidate ids that are put into the scan's filter at most.
PUSHED_IDS = 2_000


def contains_pattern(query: str) -> str:
    """``%`` and ``_`` of the query act as wildcards; only the value is bound."""
    return f"%{query}%"


def substring_search(table: DataFrame, name: str, query: str, limit: int, tie: str = "id") -> DataFrame:
    """First ``limit`` matches by name."""
    matches = table.filter(F.col(name).ilike(contains_pattern(query)))
    return matches.orderBy(name, tie).limit(limit)


def grams(text: Column) -> Column:
    """Distinct three-character substrings of the lower-cased text; none for shorter text.

    The pattern looks ahead without consuming, so one pass over the text gives every overlap.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{%d}))" % GRAM), F.lit(1)))


def query_grams(query: str) -> list[str]:
    """Grams every match must hold. A gram cannot span a wildcard."""
    found: list[str] = []
    for piece in re.split(r"[%_]", query.lower()):
        found += [piece[at:at + GRAM] for at in range(len(piece) - GRAM + 1)]
    return list(dict.fromkeys(found))


def trigram_postings(table: DataFrame, name: str, row_id: str = "id") -> DataFrame:
    """Inverted index ``(gram, row_id)``: one row per distinct gram of a text."""
    return table.select(F.explode(grams(F.col(name))).alias("gram"), row_id)


def write_postings(postings: DataFrame, path: str, row_id: str = "id") -> None:
    """Sort by gram and id into files, so a gram lookup skips nearly all of them.

    Ranging over both columns splits a gram that a large share of rows holds over several files.
    """
    postings.repartitionByRange("gram", row_id).sortWithinPartitions("gram", row_id).write.mode("overwrite").parquet(path)


def candidate_rows(table: DataFrame, postings: DataFrame, name: str, query: str, row_id: str = "id") -> DataFrame:
    """All matching rows: those that hold every gram of the query, checked against the pattern.

    A query without a whole gram reads the table itself. Few candidates become a filter on the id, which the
    scan of a table written by :func:`write_ranged` can skip files by; many are joined.
    """
    wanted = query_grams(query)
    matches = F.col(name).ilike(contains_pattern(query))
    if not wanted:
        return table.filter(matches)
    held = postings.filter(F.col("gram").isin(wanted)).groupBy(row_id).agg(F.count("*").alias("held"))
    found = held.filter(F.col("held") == len(wanted)).select(row_id)
    few = rows_within(found, PUSHED_IDS)
    if few is None:
        return table.join(found, row_id, "left_semi").filter(matches)
    return table.filter(F.col(row_id).isin([row[0] for row in few])).filter(matches)


def write_ranged(table: DataFrame, path: str, row_id: str = "id") -> None:
    """The searched table in files ranged by id, so that a filter on ids skips most of them."""
    table.repartitionByRange(row_id).sortWithinPartitions(row_id).write.mode("overwrite").parquet(path)


def indexed_search(table: DataFrame, postings: DataFrame, name: str, query: str, limit: int, row_id: str = "id") -> DataFrame:
    """The rows of :func:`substring_search`, with candidates taken from the postings."""
    return candidate_rows(table, postings, name, query, row_id).orderBy(name, row_id).limit(limit)
