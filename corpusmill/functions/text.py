"""Text cleaning, segmentation and sizing as column expressions.

Everything here stays on the JVM except Unicode composition, for which Spark has no built-in; only
rows that can change under composition are sent to the Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of Python's str type, inside one line and in full.
LINE_SPACE = (
    " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ANY_SPACE = LINE_SPACE + "\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"

# Fixed value: a sentence ends at . ! or ? followed by space and one of these openers.
SENTENCE_BREAK = rf"(?<=[.!?])[{ANY_SPACE}]+(?=[A-Z0-9\"'(\[])"
PARAGRAPH_BREAK = r"\n[ \t]*\n+"

# Fixed value: one range, which settles most text: nothing up to here composes with each other.
BEYOND_LATIN = r"[^\x00-\u02ff]"
# Fixed value: the control characters up to there, \p{C} without newline and tab, one by one: Java looks these up in a table.
LATIN_CONTROLS = "[" + "".join(f"\\x{c:02x}" for c in (*range(9), *range(11, 32), *range(127, 160), 173)) + "]"

# Code points that composition never changes, alone or next to each other. Text made only of these
# is composed already.
COMPOSED_ONLY = (
    r"\u0000-\u02ff\u0400-\u0482\u2010-\u2027\u2030-\u205e\u3041-\u3096\u4e00-\u9fff\uac00-\ud7a3"
)


@F.pandas_udf(StringType())
def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda value: unicodedata.normalize("NFC", value), na_action="ignore")


def compose(text: Column) -> Column:
    """Unicode NFC. Only text with a code point that may compose travels to Python."""
    return F.coalesce(_compose(_composable(text)), text)


def _composable(text: Column) -> Column:
    """The text if a code point of it may compose, else null."""
    # The second test is several times slower than the first.
    return let(text, lambda t: F.when(t.rlike(BEYOND_LATIN) & t.rlike(f"[^{COMPOSED_ONLY}]"), t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and hand it to ``body`` as a bound variable.

    A plain column would be inlined by the optimizer into every place that reads it, also into
    lambdas, and then computed once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unify_newlines(text: Column) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    """Trim every kind of white space, as Python's ``str.strip`` does."""
    return F.btrim(text, F.lit(ANY_SPACE))


def _trim_bound(text: Column, spaces: str) -> Column:
    """``btrim`` of a bound variable. Spark trims the right side by a list of all characters, so text whose last byte is
    printable ASCII, hence no space, is trimmed on the left only."""
    ends_in_print = F.substring(text.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(ends_in_print, F.ltrim(text, F.lit(spaces))).otherwise(F.btrim(text, F.lit(spaces)))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(ANY_SPACE))


def clean_text(text: Column) -> Column:
    """Canonical text: one newline style, no control characters, composed, tidy white space.

    Control characters go before composition, so a letter and an accent they kept apart can join;
    that order makes the function idempotent and the ids derived from it stable. A replacement runs
    only on texts that hold what it replaces, where a search for a fixed string or one range tells.
    """
    composed = F.coalesce(_compose(F.when(text.rlike(BEYOND_LATIN), _composable(_visible(text)))), _visible(text))

    def single_spaced(t: Column) -> Column:
        return F.when(t.contains("\t") | t.contains("  "), F.regexp_replace(t, "[ \t]+", " ")).otherwise(t)

    def tidy_lines(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "\n"), lambda line: _trim_bound(line, LINE_SPACE)), "\n")

    def tidy_breaks(t: Column) -> Column:
        return F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    tidied = let(let(let(composed, single_spaced), tidy_lines), tidy_breaks)
    return let(tidied, lambda t: _trim_bound(t, ANY_SPACE))


def _visible(text: Column) -> Column:
    """One newline style and no control characters."""

    def shown(t: Column) -> Column:
        return F.when(t.rlike(BEYOND_LATIN), F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")).otherwise(F.regexp_replace(t, LATIN_CONTROLS, ""))

    return let(let(text, lambda t: F.when(t.contains("\r"), unify_newlines(t)).otherwise(t)), shown)


def clean_ascii_controls(text: Column) -> Column:
    """The lighter cleaning of the queue function: ASCII controls out, runs of spaces to one."""
    printable = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(unify_newlines(printable), r" {2,}", " "))


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, trimmed, none of them empty."""

    def cut(t: Column) -> Column:
        parts = F.when(~t.contains("\n"), F.array(t)).otherwise(F.split(t, PARAGRAPH_BREAK))
        return F.filter(F.transform(parts, lambda part: _trim_bound(part, ANY_SPACE)), lambda part: part != "")

    return let(text, cut)


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed, none of them empty.

    The break takes all white space between two sentences, so the parts of a trimmed text need no
    trimming of their own.
    """
    return let(
        let(text, lambda t: _trim_bound(t, ANY_SPACE)),
        lambda whole: F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, SENTENCE_BREAK)),
    )


def segments(cleaned: Column) -> Column:
    """Sentences of all paragraphs in order; the unit that chunk packing works on."""
    return F.flatten(F.transform(paragraphs(cleaned), sentences))


def first_sentence(text: Column) -> Column:
    """The first sentence, or the trimmed text when there is none."""
    return strip(F.get(F.split(strip(text), SENTENCE_BREAK, 2), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """About four characters a token; 0 for the empty text."""
    return F.ceil(F.length(text) / 4).cast("int")


def keep_first_half(text: Column) -> Column:
    """Extractive edit: the first max(1, n/2) sentences; text without sentences is unchanged."""

    def half(parts: Column) -> Column:
        kept = F.slice(parts, F.lit(1), F.greatest(F.lit(1), (F.size(parts) / 2).cast("int")))
        return F.when(F.size(parts) > 0, F.array_join(kept, " ")).otherwise(text)

    return let(sentences(text), half)


# Accepted content types with their extractor tag, and what an extension stands for.
CONTENT_TYPES = {
    "text/plain": "txt",
    "text/markdown": "md",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
EXTENSION_TYPES = {
    ".txt": "text/plain",
    ".text": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".pdf": "application/pdf",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
GENERIC_TYPES = ("", "application/octet-stream", "binary/octet-stream")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def resolve_content_type(filename: Column, content_type: Column) -> Column:
    """Canonical content type from the header, else from the extension; null when unsupported."""
    header = F.lower(strip(F.split_part(content_type, F.lit(";"), F.lit(1))))
    extension = F.lower(F.regexp_extract(filename, r"(\.[^.]*)\z", 1))
    return F.when(header.isin(*CONTENT_TYPES), header).when(
        header.isin(*GENERIC_TYPES), F.try_element_at(literal_map(EXTENSION_TYPES), extension)
    )


def extractor_tag(content_type: Column) -> Column:
    return F.try_element_at(literal_map(CONTENT_TYPES), content_type)


def decode_utf8(content: Column) -> Column:
    """Bytes to text: bad bytes replaced, a leading byte-order mark dropped, newlines unified."""
    text = F.make_valid_utf8(content.cast("string"))
    return unify_newlines(F.regexp_replace(text, r"\A\ufeff", ""))
