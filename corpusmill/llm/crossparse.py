"""Language identification by cross-parsing entropy.

A suffix automaton per language holds a bounded labelled sample. A text is parsed greedily into the longest
pieces that occur in a language's sample; the phrases times log2 of the largest sample's size over the text's
length estimate the bits per letter it costs in that language. A letter that a sample lacks costs a code point
written out, so that a small sample is never the cheaper for its size. The cheapest language wins. Many texts are parsed in
step, one letter of each at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import held_out, row_blocks

#: Letters of the sample that a language's automaton holds, at most.
TRAIN_LETTERS = 32_768
#: Training documents of a language, at most: whole texts by hash of the id, those of up to DOC_LETTERS characters first.
TRAIN_DOCS, DOC_LETTERS = 64, 2_048
#: Letters of all samples; with very many labels each gets its share, and every label is learnt.
ALL_LETTERS = 64_000_000
#: Code points parsed in one run; phrases end at the border of runs, in every language alike.
RUN = 2_048
#: Cells of dense transition tables, over all languages; the other automata are sorted pairs, with the same results.
DENSE = 16_000_000
#: Bits of a letter that a sample lacks.
LACKING = float(np.log2(0x110000))
BLOCK = 6_000_000
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
# What is left beside letters then: numbers such as Roman numerals, superscripts and fractions.
_NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.category(c) in ("Nl", "No"))
_BLANKS = {ord(c): " " for c in _NUMBERS}


def plain(text: str | None) -> str:
    """Lower case, everything but letters as one blank, a blank before and after."""
    words = _OTHER.sub(" ", (text or "").lower())
    if not words.isascii() and not _NUMBERS.isdisjoint(words):
        words = re.sub(" +", " ", words.translate(_BLANKS))
    return " " + words.strip() + " "


def suffix_automaton(text: str, letters: dict[str, int]) -> list[dict[int, int]]:
    """Transitions (letter to state) of each state of the automaton of all substrings. State 0 is the start."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for letter in text:
        code, state = letters[letter], len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at >= 0:
            target = moves[at][code]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(code) == target:
                    moves[at][code] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves


class Automaton:
    """The automaton of one sample as arrays. Letters are codes of its own, 0 for all that the sample lacks.

    The state after the last is of no substring and has no transitions; there is no transition by letter 0.
    """

    def __init__(self, sample: str):
        self.letters = sorted(set(sample))
        moves = suffix_automaton(sample, {letter: code for code, letter in enumerate(self.letters, 1)})
        self.width, self.dead = len(self.letters) + 1, len(moves)
        pairs = sorted((state * self.width + code, target) for state, own in enumerate(moves) for code, target in own.items())
        self.keys = np.array([key for key, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.targets = np.array([target for _, target in pairs] + [-1], dtype=np.int32)
        self.start = np.full(self.width, self.dead, dtype=np.int32)
        for code, target in moves[0].items():
            self.start[code] = target
        self.cells = (len(moves) + 1) * self.width
        self.table: np.ndarray | None = None

    def spread(self) -> None:
        self.table = np.full(self.cells, -1, dtype=np.int32)
        self.table[self.keys[:-1]] = self.targets[:-1]

    def follow(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        if self.table is not None:
            return self.table[state * np.int32(self.width) + letter]
        key = state.astype(np.int64) * self.width + letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.targets[at], np.int32(-1))


class Parser:
    """The automata of a model, built once in each Python worker."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted(set().union(*samples.values()))
        self.codes = np.zeros(0x110000, dtype=np.int32)  # code 0: a letter that no sample has
        self.codes[[ord(letter) for letter in letters]] = np.arange(1, len(letters) + 1)
        self.automata = [Automaton(samples[language]) for language in self.languages]
        self.own = np.zeros((len(self.automata), len(letters) + 1), dtype=np.int32)  # codes of each automaton
        for own, automaton in zip(self.own, self.automata):
            own[self.codes[[ord(letter) for letter in automaton.letters]]] = np.arange(1, automaton.width)
        room = DENSE
        for automaton in sorted(self.automata, key=lambda automaton: automaton.cells):
            room -= automaton.cells
            if room >= 0:
                automaton.spread()
        self.bits = float(np.log2(max([2, *map(len, samples.values())])))

    def coded(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits per letter of each text (row) in each language (column)."""
        lacking = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for at, text in enumerate(texts):
            counts = np.bincount(self.coded(text), minlength=1)
            held = np.flatnonzero(counts)
            lacking[at] = (self.own[:, held] == 0) @ counts[held]
        bits = (self.phrases(texts) - lacking) * self.bits + lacking * LACKING
        return bits / np.array([[len(value)] for value in texts])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        runs, owner = [], []
        for at, text in enumerate(texts):
            coded = self.coded(text)
            for start in range(0, len(coded), RUN):
                runs.append(coded[start : start + RUN])
                owner.append(at)
        order = np.argsort([-len(run) for run in runs], kind="stable")
        sizes = np.array([len(runs[k]) for k in order])
        grid = np.zeros((int(sizes[0]) if len(sizes) else 0, len(runs)), dtype=np.int32)
        for lane, k in enumerate(order):
            grid[: sizes[lane], lane] = runs[k]
        active = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")  # runs longer than the step
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        owners = np.array(owner)[order]
        for language, automaton in enumerate(self.automata):
            # A letter that the sample lacks is a phrase of its own: its state, the last one, leads nowhere.
            own = self.own[language]
            state = np.zeros(len(runs), dtype=np.int32)
            broken = np.zeros(len(runs), dtype=np.int32)
            for step, lanes in enumerate(active):
                letter = own[grid[step, :lanes]]
                following = automaton.follow(state[:lanes], letter)
                failed = following < 0
                if step:  # the first letter ends no phrase
                    broken[:lanes] += failed
                state[:lanes] = np.where(failed, automaton.start[letter], following)
            np.add.at(counts[:, language], owners, broken + 1)
        return counts


_PARSERS: dict[tuple, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    key = tuple(sorted(samples.items()))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Sample text per language from labelled documents outside the held-out quarter, bounded by the parameters above.

    A sample is whole texts, as many as fit; only where not even the first one fits is that one cut. Every label is
    learnt. Null languages, texts and ids, and texts without letters, teach nothing. Without any labelled document
    the model is empty and every text is ``und``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("n", F.length("text"))
    labels = rows.select("lang").distinct().count()
    room = min(TRAIN_LETTERS, ALL_LETTERS // max(1, labels))
    # Chosen by id, length and hash; only the chosen texts move.
    key = ["lang", "doc_id", "n", "told"]
    rows = rows.withColumn("told", F.xxhash64("text"))
    order = W.partitionBy("lang").orderBy(F.col("n") > DOC_LETTERS, F.xxhash64("doc_id"), "doc_id", "n", "told")
    first = rows.select(*key).withColumn("r", F.row_number().over(order)).where(F.col("r") <= TRAIN_DOCS)
    fits = F.sum("n").over(W.partitionBy("lang").orderBy("r")) <= room
    chosen = first.withColumn("fits", fits).where(F.col("fits") | (F.col("r") == 1)).groupBy(*key).agg(F.min("r").alias("r"))
    chosen = rows.join(chosen, key).dropDuplicates(["lang", "r"])
    # At most ``room`` characters a label, ALL_LETTERS together.
    chosen = chosen.select("lang", "r", F.substring("text", 1, room).alias("text")).orderBy("lang", "r").collect()
    samples: dict[str, str] = {}
    for row in chosen:
        samples[row["lang"]] = (samples.get(row["lang"], "") + plain(row["text"]))[: room + 2]
    return samples


def identify(docs: DataFrame, samples: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits`` (map of language to bits per letter), one row per document.

    ``score`` is the share of the winner when languages are weighed by 2^(-8 x bits per letter). A null text
    or one without letters, and any text under an empty model, is ``und`` with score 0 and null bits. Of equal
    languages the first by code point wins. Whole texts are parsed; other columns are not read.
    """
    key = docs.schema[doc_id].dataType.simpleString()
    bits_type = pa.map_(pa.string(), pa.float64())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            for start, stop in row_blocks(texts, BLOCK):
                part = [plain(value) for value in texts[start:stop]]
                known = [at for at, value in enumerate(part) if not value.isspace()] if parser.languages else []
                langs, scores, bits = [UNKNOWN] * len(part), [0.0] * len(part), [None] * len(part)
                cost = parser.costs([part[at] for at in known]) if known else None
                for at, own in zip(known, cost if known else ()):
                    best = int(own.argmin())
                    langs[at] = parser.languages[best]
                    scores[at] = float(1.0 / np.exp2(-8.0 * (own - own[best])).sum())
                    bits[at] = list(zip(parser.languages, own.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, bits_type)],
                    ["doc_id", "lang_pred", "score", "bits"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(parse, f"doc_id {key}, lang_pred string, score double, bits map<string, double>")
