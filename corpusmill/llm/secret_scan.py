"""Secret scan with a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams that every match must contain. Documents are
indexed in segments: postings list, per trigram that some rule asks for, the documents of the segment holding
it. Postings are intersected and united by the queries, and only the candidates meet the pattern. A rule
without mandatory trigrams scans the whole segment. Texts stay in the task that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import row_blocks

#: Characters of one index segment.
SEGMENT = 4_000_000
#: Alternatives that the derivation keeps apart before it settles for what it has.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and the group that must have at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The patterns of the base kinds, then public key formats, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
    Rule("bearer", r"(?ai:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
)

Query = tuple  # ("all",), ("has", trigram), ("and", queries), ("or", queries)
ALL: Query = ("all",)


def _join(kind: str, parts: list[Query]) -> Query:
    """A conjunction or disjunction without needless parts."""
    if kind == "and":
        parts = [part for part in parts if part != ALL]
        empty = ALL
    else:
        if ALL in parts:
            return ALL
        empty = ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (kind, tuple(parts)) if parts else empty


def _of_strings(strings: set[bytes]) -> Query:
    """What holds when one of these strings occurs."""
    spelled = [
        _join("and", [("has", text[at : at + 3]) for at in range(len(text) - 2)]) if len(text) > 2 else ALL for text in sorted(strings)]
    return _join("or", spelled)


class _Walk:
    """Derives the query of a parsed pattern: strings known so far, and what is certain of everything before."""

    def __init__(self):
        self.strings, self.certain = {b""}, []

    def settle(self, keep: bool = False) -> None:
        """Turn the strings into a condition; ``keep`` their ends when what follows touches them."""
        self.certain.append(_of_strings(self.strings))
        self.strings = {text[-2:] for text in self.strings} if keep else {b""}

    def extend(self, endings: set[bytes]) -> None:
        if len(self.strings) * len(endings) > ALTERNATIVES:
            self.settle(keep=True)
        if len(self.strings) * len(endings) > ALTERNATIVES:
            self.strings = {b""}
        self.strings = {a + b for a in self.strings for b in endings}

    def part(self, tokens) -> tuple[set[bytes] | None, Query]:
        inner = _Walk()
        exact = inner.run(tokens)
        return (inner.strings if exact else None), inner.query()

    def query(self) -> Query:
        return _join("and", [*self.certain, _of_strings(self.strings)])

    def follow(self, strings: set[bytes] | None, query: Query) -> bool:
        if strings is None:
            self.settle()
            self.certain.append(query)
            return False
        self.extend(strings)
        return not self.certain

    def run(self, tokens) -> bool:
        """Whether ``strings`` are exactly what the tokens can match (letters folded)."""
        exact = True
        for kind, value in tokens:
            if kind is C.LITERAL:
                exact &= self.follow({chr(value).lower().encode()}, ALL)
            elif kind is C.IN:
                letters = _members(value)
                exact &= self.follow(letters, ALL)
            elif kind is C.SUBPATTERN:
                exact &= self.follow(*self.part(value[3]))
            elif kind is C.BRANCH:
                parts = [self.part(branch) for branch in value[1]]
                whole = None if any(strings is None for strings, _ in parts) else set().union(*(strings for strings, _ in parts))
                exact &= self.follow(whole, _join("or", [query for _, query in parts]))
            elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, inner = value
                strings, query = self.part(inner)
                if strings is not None and (least, most) == (0, 1):
                    exact &= self.follow(strings | {b""}, ALL)
                elif strings is not None and least == most and least <= 4:
                    for _ in range(least):
                        exact &= self.follow(strings, ALL)
                else:
                    exact &= self.follow(None, query if least else ALL)
            elif kind is not C.AT:  # look-arounds and the like only narrow a match
                exact &= self.follow(None, ALL)
        return exact and not self.certain


def _members(items) -> set[bytes] | None:
    """The letters of a small class, folded; None for a large or negated one."""
    found = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower().encode())
        elif kind is C.RANGE and value[1] - value[0] < 8:
            found |= {chr(code).lower().encode() for code in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern over texts with A-Z folded; ``("all",)`` if nothing is mandatory."""
    walk = _Walk()
    walk.run(_parser.parse(pattern))
    return walk.query()


def _trigrams(query: Query) -> set[bytes]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(_trigrams(part) for part in query[1])) if query[0] in ("and", "or") else set()


class Segment:
    """Postings of some texts: for each wanted trigram the sorted places of the texts that hold it."""

    def __init__(self, texts: list[str], slots: np.ndarray, wanted: list[bytes]):
        coded = [text.encode("utf-8", "surrogatepass").lower() + b"\0\0" for text in texts]
        data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint32)
        ends = np.cumsum([len(text) for text in coded])
        slot = slots[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, dtype=np.uint8)
        at = np.flatnonzero(slot)
        pairs = np.unique(slot[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        number, place = np.divmod(pairs, max(1, len(texts)))
        borders = np.searchsorted(number, np.arange(1, len(wanted) + 2))
        self.all = np.arange(len(texts))
        self.postings = {trigram: place[borders[k] : borders[k + 1]] for k, trigram in enumerate(wanted)}

    def candidates(self, query: Query) -> np.ndarray:
        if query == ALL:
            return self.all
        if query[0] == "has":
            return self.postings[query[1]]
        parts = sorted((self.candidates(part) for part in query[1]), key=len)
        found = parts[0]
        for part in parts[1:]:
            found = np.intersect1d(found, part, assume_unique=True) if query[0] == "and" else np.union1d(found, part)
        return found


def _slots(queries: list[Query]) -> tuple[np.ndarray, list[bytes]]:
    """A number from 1 for every trigram that is asked for, by its 24 bits."""
    wanted = sorted(set().union(*(_trigrams(query) for query in queries)))
    slots = np.zeros(1 << 24, dtype=np.uint16)
    for number, trigram in enumerate(wanted, 1):
        slots[int.from_bytes(trigram, "big")] = number
    return slots, wanted


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in code points, whose measured group is long enough."""
    found = []
    for match in compiled.finditer(text):
        start, end = match.span(rule.group)
        if end - start >= rule.least:
            found.append(match.span())
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end; code points, end exclusive), one row per document.

    Spans are sorted by start, then by the order of ``rules``. A null text is empty and has none. Rows are
    independent, so repeated rows and ids need no care; other columns are not read; an empty table gives no rows.
    """
    key = docs.schema[doc_id].dataType.simpleString()
    queries = [trigram_query(rule.pattern) for rule in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, wanted = _slots(queries)
        compiled = [_fast(rule) for rule in rules]
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for start, stop in row_blocks(texts, SEGMENT):
                part = texts[start:stop]
                segment = Segment(part, slots, wanted)
                found: list[list[tuple]] = [[] for _ in part]
                for order, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
                    for at in segment.candidates(query).tolist():
                        found[at].extend((a, order, b, rule.kind) for a, b in spans_of(part[at], rule, pattern))
                rows = [[{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(own)] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(rows, span)], ["doc_id", "spans"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(search, f"doc_id {key}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _fast(rule: Rule) -> re.Pattern:
    """The pattern; a class that repeats alone may ask for its least length at once, since its runs are whole."""
    alone = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(f"{alone[1]}{{{rule.least},}}" if alone and rule.group == 0 else rule.pattern)
