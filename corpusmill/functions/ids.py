"""Content-addressed identity and JSON-shaped keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Era labels by layer version 1..10, clamped at both ends.
ERAS = (
    "Holocene",
    "Pleistocene",
    "Pliocene",
    "Miocene",
    "Oligocene",
    "Eocene",
    "Paleocene",
    "Cretaceous",
    "Jurassic",
    "Triassic",
)

# The metadata fields that count towards a chunk's identity, in sorted order.
IDENTITY_FIELDS = ("chunk_index", "section", "source")
RECORD_SEPARATOR = "␞"


def doc_id(filename: Column, text: Column) -> Column:
    """Hash of file name and extracted (not cleaned) text."""
    return F.sha2(F.concat(filename, F.lit("\x00"), text), 256)


def chunk_id(doc: Column, ordinal: Column, text: Column) -> Column:
    """Hash of document id, position and text, so equal paragraphs of one document stay apart."""
    return F.sha2(F.concat(doc, F.lit("\x00"), ordinal.cast("string"), F.lit("\x00"), text), 256)


def era(layer_version: Column) -> Column:
    position = F.least(F.greatest(layer_version, F.lit(1)), F.lit(len(ERAS)))
    return F.element_at(F.array(*[F.lit(name) for name in ERAS]), position.cast("int"))


def json_string(text: Column, ascii_only: bool = False) -> Column:
    """A JSON string literal with the escapes of Python's ``json`` module."""
    rare = r"[^\x20-\x7e]" if ascii_only else r"[\x00-\x1f]"
    escaped = text
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))

    def code_units(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike(rare), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(char)

    spelled_out = F.array_join(F.transform(F.split(escaped, ""), code_units), "")
    return F.concat(F.lit('"'), F.when(escaped.rlike(rare), spelled_out).otherwise(escaped), F.lit('"'))


def metadata_chunk_id(text: Column, *, source: Column | None = None, section: Column | None = None,
                      chunk_index: Column | None = None, strict: bool = True) -> Column:
    """Hash of text and compact sorted JSON of the identity fields that are present.

    A field is absent when not passed or null. Null or empty text raises; with ``strict`` off null text has no id and
    empty text is hashed, so that such a row does not end a job over many.
    """
    given = {"source": source, "section": section, "chunk_index": chunk_index}
    parts = []
    for name in IDENTITY_FIELDS:
        column = given[name]
        if column is None:
            continue
        value = column.cast("string") if name == "chunk_index" else json_string(column, ascii_only=True)
        parts.append(F.when(column.isNotNull(), F.concat(F.lit(f'"{name}":'), value)))
    body = F.concat_ws(",", *parts) if parts else F.lit("")
    usable = text
    if strict:
        refused = F.raise_error(F.lit("chunk text must be a non-empty string")).cast("string")
        usable = F.when(F.length(text) > 0, text).otherwise(refused)
    return F.sha2(F.concat(usable, F.lit(RECORD_SEPARATOR + "{"), body, F.lit("}")), 256)


def prompt_key(model_id: Column, query: Column, instruction: Column, hits: Column) -> Column:
    """Cache key over everything that shapes a prompt.

    ``hits`` is an ordered ``array<struct<chunk_id, layer_version, geological_age, ...>>``. A null
    instruction equals the empty one, since both give the same prompt.
    """
    rendered = F.transform(
        hits,
        lambda hit: F.concat(
            F.lit("["), json_string(hit["chunk_id"]), F.lit(", "), hit["layer_version"].cast("string"),
            F.lit(", "), json_string(hit["geological_age"]), F.lit("]"),
        ),
    )
    payload = F.concat(
        F.lit('{"hits": ['), F.array_join(rendered, ", "),
        F.lit('], "instruction": '), json_string(F.coalesce(instruction, F.lit(""))),
        F.lit(', "model": '), json_string(model_id),
        F.lit(', "query": '), json_string(query), F.lit("}"),
    )
    return F.sha2(payload, 256)


def ledger_key(model_id: Column, dim: Column, chunk: Column) -> Column:
    return F.concat_ws(":", model_id, dim.cast("string"), chunk)


def task_key(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("sqs:"), bucket, F.lit(":"), key)
