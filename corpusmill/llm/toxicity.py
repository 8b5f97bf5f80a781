"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits to Latin letters
(l, 1 and i become one letter), drops zero-width signs and turns the rest into single blanks; signs such as ``!``
or ``$`` are letters only where a letter follows. Entries match from the start of a word, whole words or stems. A
hit inside an exception phrase, known or learnt from clean documents, does not count. The score is a logistic
function of the weight of all hits and of that weight per word.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusmill.llm.common import held_out, own_name, releasing

#: Labelled training documents that the lexicon and the weights are learnt from, at most (lowest hashes of the id).
TRAIN_ROWS = 16_000
#: Learnt entries at most, most frequent first.
LEXICON_ROWS = 4_000
#: A learnt entry follows at least so many different words in toxic documents, so copies of one text teach nothing.
CONTEXTS = 6
#: Share of the documents with a learnt entry that are toxic, at least.
SHARE = 0.7
#: Clean training documents in which a phrase round a hit occurs, and no toxic one, before it is an exception.
EXCUSES = 3
#: Predicted toxic from this score on.
THRESHOLD = 0.3
STEM = range(4, 9)

# Insults that are known before any label, and phrases in which such a word is harmless.
SEEDS = (
    "idiot", "moron", "stupid", "pathetic", "worthless", "loser", "scum", "trash", "clown", "disgusting", "dumb",
    "imbecile", "retard", "bastard", "asshole", "bitch", "slut", "whore", "fuck", "shit", "cunt", "vermin", "filth",
)
SEED_WEIGHT = 3.0
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash pickup", "clown fish", "circus clown", "class clown",
    "pond scum", "soap scum", "scum of the pond", "sore loser", "not stupid", "not an idiot", "shit happens",
)
# Letters and digits that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "в": "b", "н": "h",
    "к": "k", "м": "m", "т": "t", "г": "r", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "ν": "v", "ι": "i", "κ": "k", "η": "n", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "0": "o", "1": "i",
    "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e",
}


class _Fold(dict):
    """Folded form of a code point, worked out when first met."""

    def __missing__(self, code: int) -> str:
        if unicodedata.category(chr(code)) == "Cf":  # zero-width signs and soft hyphens do not part a word
            self[code] = ""
            return ""
        letters = unicodedata.normalize("NFKD", chr(code).lower())
        folded = "".join(LOOKALIKES.get(c, c) for c in letters if not unicodedata.combining(c))
        self[code] = "".join(c if c.isalnum() else " " for c in folded) if folded or letters.isspace() else ""
        return self[code]


_FOLD = _Fold()
#: Signs that stand for a letter only where one follows; at a word's end they are punctuation.
_SIGNS = re.compile(r"[!|$@€]+(?![^\W_])")


def fold(text: str | None) -> str:
    """The folded words of a text, a blank before and after each."""
    words = _SIGNS.sub(" ", text or "").translate(_FOLD).split()
    return " " + " ".join(words) + " " if words else " "


@dataclass(frozen=True)
class Model:
    """Entries (folded word or stem, weight, whole word or not), exceptions and the three weights of the score."""

    entries: tuple[tuple[str, float, bool], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    weights: tuple[float, float, float] = (-3.0, 1.0, 1.0)


_BUILT: dict[Model, ahocorasick.Automaton] = {}


def _automaton(model: Model) -> ahocorasick.Automaton:
    if model not in _BUILT:
        built = ahocorasick.Automaton()
        for phrase in model.exceptions:
            key = fold(phrase)
            built.add_word(key, (len(key), 0.0))
        for entry, weight, whole in model.entries:
            key = f" {entry} " if whole else f" {entry}"
            if not built.exists(key):
                built.add_word(key, (len(key), weight))
        built.make_automaton()
        _BUILT.clear()
        _BUILT[model] = built
    return _BUILT[model]


def features(text: str | None, model: Model) -> tuple[float, float]:
    """Weight of all hits and that weight per hundred words, both as log(1 + x).

    Entries that start at the same word count once, with the largest weight.
    """
    folded = fold(text)
    hits: dict[int, float] = {}
    excused = []
    for last, (length, weight) in _automaton(model).iter(folded):
        start = last - length + 1
        if weight:
            hits[start] = max(weight, hits.get(start, 0.0))
        else:
            excused.append((start, last))
    if excused:
        # By start, with the furthest end so far: a hit is excused by an interval that starts before it and ends after it.
        excused.sort()
        starts, ends = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))
        hits = {at: w for at, w in hits.items() if not (k := bisect_right(starts, at)) or ends[k - 1] <= at}
    total = sum(hits.values())
    words = folded.count(" ") - 1
    return float(np.log1p(total)), float(np.log1p(100.0 * total / max(1, words)))


def score(text: Column, model: Model) -> Column:
    """Probability-like score in [0, 1]; null and empty texts get the score of a text without hits."""

    @releasing
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, amount, density = model.weights
        for texts in batches:
            rows = [features(value, model) for value in texts]
            z = np.array([bias + amount * a + density * b for a, b in rows], dtype=float)
            yield pd.Series(1.0 / (1.0 + np.exp(-z)))

    return F.pandas_udf(scores, DoubleType())(text)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct words of each document with the word before their first place, a few documents at a time."""
    for frame in (whole.iloc[at : at + 128] for whole in batches for at in range(0, len(whole), 128)):
        out = []
        for text, toxic in zip(frame["text"], frame["toxic"]):
            words, before = fold(text).split(), ""
            seen = {}
            for word in words:
                seen.setdefault(word, before)
                before = word
            out.extend((word, prev, toxic) for word, prev in seen.items() if len(word) >= STEM.start)
        yield pd.DataFrame(out, columns=["word", "before", "toxic"])


def _forms(seed: str) -> Iterator[str]:
    """A seed word and its plural."""
    yield fold(seed).strip()
    yield fold(seed + ("es" if seed.endswith(("s", "x", "sh", "ch")) else "s")).strip()


def _phrases(model: Model):
    """Distinct pairs of words round the hits of each document, with its label."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(model)
        for frame in (whole.iloc[at : at + 128] for whole in batches for at in range(0, len(whole), 128)):
            out = set()
            for row, (text, toxic) in enumerate(zip(frame["text"], frame["toxic"])):
                folded = fold(text)
                for last, (length, weight) in automaton.iter(folded):
                    if weight:
                        start = last - length + 2
                        stop = folded.index(" ", start)
                        before, after = folded.rfind(" ", 0, max(0, start - 1)) + 1, folded.find(" ", stop + 1)
                        if start > 1:
                            out.add((row, folded[before:stop], toxic))
                        if after > 0:
                            out.add((row, folded[start:after], toxic))
            yield pd.DataFrame([row[1:] for row in sorted(out)], columns=["phrase", "toxic"])

    return found


def _learnt_exceptions(train: DataFrame, model: Model) -> Model:
    """The model with the phrases round a hit that several clean documents hold and no toxic one."""
    phrases = train.mapInPandas(releasing(_phrases(model)), "phrase string, toxic int").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    rows = phrases.where((F.col("toxic") == 0) & (F.col("n") >= EXCUSES)).orderBy(F.desc("n"), "phrase").limit(LEXICON_ROWS).collect()
    return replace(model, exceptions=(*model.exceptions, *sorted(row["phrase"] for row in rows)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out quarter."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # at most ``rows`` rows


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents; without labels, the seeds and fixed weights.

    ``docs`` has doc_id and text, ``labels`` has doc_id and toxic; other columns are not read. Rows with a null
    id or label teach nothing; of repeated labels the larger counts.
    """
    train = training_rows(docs, labels, rows).cache()
    words = train.mapInPandas(releasing(_words), "word string, before string, toxic int")
    words = words.groupBy("word", "before").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    words = words.groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("contexts"))
    stems = words.withColumn("stem", F.explode(F.array_distinct(F.array(*[F.substring("word", 1, size) for size in STEM]))))
    stems = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"), F.sum("contexts").alias("contexts"))
    stems = stems.where((F.col("contexts") >= CONTEXTS) & (F.col("toxic") >= SHARE * F.col("n")))
    found = stems.orderBy(F.desc("toxic"), "stem").limit(LEXICON_ROWS).collect()
    taken: dict[str, float] = {}
    for row in sorted(found, key=lambda row: (len(row["stem"]), row["stem"])):
        if not any(row["stem"][:size] in taken for size in STEM):
            taken[row["stem"]] = float(np.log((row["toxic"] + 1.0) / (row["n"] - row["toxic"] + 1.0)))
    seeds = {form: SEED_WEIGHT for seed in SEEDS for form in _forms(seed)}
    entries = [(word, weight, True) for word, weight in seeds.items()] + [(stem, weight, False) for stem, weight in taken.items()]
    model = _learnt_exceptions(train, Model(tuple(sorted(entries))))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [features(text, model) for text in frame["text"]]
            yield pd.DataFrame(rows, columns=["a", "b"]).assign(y=frame["toxic"].to_numpy())

    table = train.mapInPandas(releasing(measured), "a double, b double, y int").toPandas()  # at most ``rows`` rows of three numbers
    train.unpersist()
    return Model(model.entries, model.exceptions, _fit(table)) if table["y"].nunique() > 1 else model


def _fit(table: pd.DataFrame) -> tuple[float, float, float]:
    """Weights of a ridge logistic regression; the two features never lower a score."""
    x = np.column_stack([np.ones(len(table)), table["a"], table["b"]])
    y, used = table["y"].to_numpy(dtype=float), [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-x @ w))
            slope = x[:, used].T @ (y - p) - 0.1 * w[used]
            curve = (x[:, used] * (p * (1 - p))[:, None]).T @ x[:, used] + 0.1 * np.eye(len(used))
            w[used] += np.clip(np.linalg.solve(curve, slope), -4, 4)
        low = [k for k in used if k and w[k] < 0]
        if not low:
            return tuple(float(v) for v in w)
        used = [k for k in used if k not in low]


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold, in its own columns."""
    own = own_name(docs, "toxicity")
    return docs.withColumn(own, score(F.col(text), model)).where(F.col(own) < threshold).drop(own)
