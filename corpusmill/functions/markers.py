"""Dates, metrics and error codes found in semi-structured text, as one array column.

The whole extraction is a projection: no shuffle, no Python. Order and duplicates are settled
inside the row's own array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker patterns. They run with the ``(?U)`` flag in front, under which \b \d \w \s
# have their Unicode meaning.
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
SLASH_DATE = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"
UNIT_METRIC = (
    r"(?i)(?<![\d/-])\b\d[\d,]*(?:\.\d+)?\s?"
    r"(?:ms|s|secs?|mins?|hrs?|GB|MB|KB|TB|%|rps|req/s|bytes?|errors?|requests?)(?=\W|$)"
)
# Possessive quantifiers here keep long words from being tried again letter by letter; they match the same.
KEY_METRIC = r"\b[A-Za-z_][A-Za-z0-9_]*+\s*+[:=]\s*+\d[\d,]*(?:\.\d+)?\b"
ERROR_CODE = r"\b(?:ERR(?:OR)?[-_]?\d{2,}|E\d{3,})\b"
HTTP_STATUS = r"(?i)\b(?:HTTP|status)\s?[1-5]\d{2}\b"
EXCEPTION = r"\b[A-Z][A-Za-z0-9]*(?:Error|Exception)\b"

MARKER_TYPE = "struct<kind:string,text:string,value:string>"


def _found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def _marker(kind: str, text: Column, value: Column | None = None) -> Column:
    shown = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), shown.alias("value"))


def iso_dates(text: Column) -> Column:
    return F.transform(_found(text, ISO_DATE), lambda m: _marker("date", m, m))


def slash_dates(text: Column) -> Column:
    return F.transform(_found(text, SLASH_DATE), lambda m: _marker("date", m))


def unit_metrics(text: Column) -> Column:
    return F.transform(
        _found(text, UNIT_METRIC), lambda m: _marker("metric", m, F.regexp_extract(m, r"(?U)^\d[\d,]*(?:\.\d+)?", 0))
    )


def key_metrics(text: Column) -> Column:
    def pair(m: Column) -> Column:
        number = F.regexp_extract(m, r"(?U)[:=]\s*(.*)$", 1)
        return _marker("metric", F.concat(F.regexp_extract(m, "^[A-Za-z0-9_]+", 0), F.lit("="), number), number)

    return F.transform(_found(text, KEY_METRIC), pair)


def error_codes(text: Column) -> Column:
    return F.transform(_found(text, ERROR_CODE), lambda m: _marker("error_code", m))


def http_statuses(text: Column) -> Column:
    return F.transform(_found(text, HTTP_STATUS), lambda m: _marker("error_code", m, F.right(m, F.lit(3))))


def exceptions(text: Column) -> Column:
    return F.transform(_found(text, EXCEPTION), lambda m: _marker("error_code", m))


FAMILIES = {
    "iso_date": iso_dates,
    "slash_date": slash_dates,
    "unit_metric": unit_metrics,
    "key_metric": key_metrics,
    "error_code": error_codes,
    "http_status": http_statuses,
    "exception": exceptions,
}


def extract_markers(text: Column) -> Column:
    """All families in their fixed order, first occurrence of each ``(kind, text)`` kept.

    A text determines its value within a kind, so distinct structs are distinct ``(kind, text)``.
    """
    return F.array_distinct(F.concat(*[family(text) for family in FAMILIES.values()]))


def marker_counts(markers: Column) -> Column:
    """Count per kind, kinds in order of first appearance."""
    kinds = F.array_distinct(F.transform(markers, lambda m: m["kind"]))
    return F.map_from_entries(
        F.transform(kinds, lambda kind: F.struct(kind, F.size(F.filter(markers, lambda m: m["kind"] == kind))))
    )
