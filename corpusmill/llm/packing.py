"""Packing into training sequences: shortest-pack-first over the length histogram.

Texts become token ids once. What a document has beyond full sequences is a tail shorter than a sequence, and
only the histogram of tail lengths reaches the driver. Lengths are placed longest first, each into the
shortest open packs that still hold it; packs are counts of patterns, not single packs. No more packs open
than the tokens need at least: once all are open, a length that fits none is cut to the largest gap and its
rest goes back to the histogram. The placements are runs of ranks within a length, and documents find theirs
by their rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.common import releasing, staged

SEQUENCE = 2048
#: Stems whose ids a worker remembers; once so many are known, later ones are encoded anew in each block.
MEMO = 200_000
#: Bytes of text that are encoded together, and rows that are cut into pieces together.
BLOCK, ROWS = 1_000_000, 512
#: Words that the tokenizer gets in one call; what it returns takes some hundred bytes a word.
CALL = 4_096
_TOKENS = "doc_id {}, part int, spot long, tokens int, tail int, rank long, full_before long, ids binary"
_PIECES = "doc_id {}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Encoder:
    """Ids of texts, a block at a time.

    A tokenizer that lower-cases, drops white space and ends words gives a word's ids wherever it stands. Then a
    block's distinct words are encoded once: a plain word is its letters in lower case and the signs after them, each
    known by itself, and common stems are remembered by the worker. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = _keeps_words_apart(_told(self.tokenizer))
        #: Stems by number, their ids one after the other; number 0 has none.
        self.stems = pa.array([""])
        self.flat, self.counts = np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        #: Whether an id ends a piece of a word.
        self.ends = np.zeros(self.size, dtype=bool)
        if self.by_word:
            suffix = self.tokenizer.model.end_of_word_suffix
            self.ends[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        calls = (texts[at : at + CALL] for at in range(0, len(texts), CALL))
        coded = [np.array(one.ids, dtype=np.uint32) for call in calls for one in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.concatenate(coded) if coded else np.empty(0, dtype=np.uint32), counts

    def _lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces, encoded as lines and told apart by the ids that end a piece."""
        ids, counts = [], []
        for at in range(0, len(pieces), CALL):
            part = pieces[at : at + CALL]
            found, _ = self._ids(["\n".join(part)])
            ends = np.flatnonzero(self.ends[found])
            many = np.diff(ends, prepend=-1)
            if len(ends) != len(part):
                found, many = self._ids(part)
            ids.append(found)
            counts.append(many)
        return np.concatenate([*ids, np.empty(0, dtype=np.uint32)]), np.concatenate([*counts, np.empty(0, dtype=np.int64)])

    def _pieces(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two piece numbers for each word, then the ids and id counts of all pieces that the numbers mean."""
        plain = pc.match_substring_regex(words, _PLAIN)
        first, second = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        known = words.filter(plain)
        stems = pc.utf8_lower(pc.utf8_rtrim(known, characters=_SIGNS))
        signs = pc.utf8_ltrim(known, characters=_LETTERS)
        used = pa.concat_arrays([stems, signs]).dictionary_encode()
        found = pc.index_in(used.dictionary, value_set=self.stems)
        fresh = used.dictionary.filter(found.is_null())
        numbers = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        # The numbers of a block go on after the remembered ones.
        numbers[numbers < 0] = len(self.stems) + np.arange(len(fresh))
        numbers = numbers[used.indices.to_numpy(zero_copy_only=False)]
        first[at], second[at] = numbers[: len(at)], numbers[len(at) :]
        ids, counts = self._lines(fresh.to_pylist())
        if len(self.stems) < MEMO:
            self.stems = pa.concat_arrays([self.stems, fresh])
            self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])
            ids, counts = ids[:0], counts[:0]
        others = words.filter(pc.invert(plain)).to_pylist()
        other_ids, other_counts = self._ids(others)
        rest = np.ones(len(words), dtype=bool)
        rest[at] = False
        first[rest] = len(self.counts) + len(counts) + np.arange(len(others))
        return first, second, np.concatenate([self.flat, ids, other_ids]), np.concatenate([self.counts, counts, other_counts])

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each, and how many each has. A very long text is encoded in parts."""
        if self.by_word and len(texts) == 1 and texts.nbytes > 2 * BLOCK:
            parts = [self._encode(pa.array([part]), end)[0][:-1] for part in _parts(texts[0].as_py())]
            ids = np.concatenate([*parts, np.array([end], dtype=np.uint32)])
            return ids, np.array([len(ids)])
        return self._encode(texts, end)

    def _encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids, counts = self._ids(texts.to_pylist())
            return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([_split(text) for text in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        first, second, flat, counts = self._pieces(words.dictionary)
        flat, counts = np.append(flat, np.uint32(end)), np.append(counts, 1)
        # Two pieces for each word, and the end after the words of each text.
        number, per_text = words.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = np.full(2 * len(number) + len(texts), len(counts) - 1, dtype=np.int64)
        place = 2 * np.arange(len(number)) + np.repeat(np.arange(len(texts)), per_text)
        pieces[place], pieces[place + 1] = first[number], second[number]
        many = counts[pieces]
        stops = np.cumsum(many)
        ids = flat[np.repeat((np.cumsum(counts) - counts)[pieces] - stops + many, many) + np.arange(stops[-1])]
        return ids, np.diff(stops[2 * np.cumsum(per_text) + np.arange(len(texts))], prepend=0)


def _told(tokenizer: Tokenizer) -> dict:
    """What the tokenizer's description says of its steps, without the vocabulary."""
    steps = {name: getattr(tokenizer, name) for name in ("normalizer", "pre_tokenizer")}
    return {
        **{name: json.loads(step.__getstate__()) if step else None for name, step in steps.items()},
        "model": {"end_of_word_suffix": getattr(tokenizer.model, "end_of_word_suffix", None)},
    }


def _keeps_words_apart(told: dict) -> bool:
    """Whether the tokenizer's own description says that each word between white space is encoded by itself, in lower case."""
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    before = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    split = before[0] if before else {}
    return (
        bool(told["model"].get("end_of_word_suffix")) and blank in steps and {"type": "Lowercase"} in steps
        and [step["type"] for step in steps if step not in (blank, {"type": "Lowercase"})] in ([], ["NFC"])
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and all(step["type"] == "ByteLevel" and not step["add_prefix_space"] and not step["use_regex"] for step in before[1:])
    )


def _split(text: str) -> list[str]:
    """Words between white space as the tokenizer sees it; str.split() takes four separators more for it."""
    return text.translate(_SPACES).split(" ")


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about BLOCK characters that end before white space."""
    start = 0
    while start < len(text):
        blank = _BLANK.search(text, start + BLOCK)
        stop = blank.start() if blank else len(text)
        yield text[start:stop]
        start = stop


_BLANK = re.compile("[ \t\n\x0b\x0c\r]")
# A plain word is one run of letters, each of which stays one letter in lower case, and perhaps a run of signs after it.
_SIGNS = ".,;:!?)]}%&*#|\"-"
_RANGES = (("A", "Z"), ("a", "z"), ("\u00c0", "\u00d6"), ("\u00d8", "\u00f6"), ("\u00f8", "\u012f"), ("\u0131", "\u024f"))
_LETTERS = "".join(chr(code) for low, high in _RANGES for code in range(ord(low), ord(high) + 1))
_PLAIN = rf"\A[{''.join(f'{low}-{high}' for low, high in _RANGES)}]+[{re.escape(_SIGNS)}]*\z"
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def id_kind(path: str, end: int) -> str:
    """The numpy type in which token rows hold ids: two bytes while the vocabulary fits."""
    return "<u2" if max(end + 1, _encoder(path).size) <= 1 << 16 else "<u4"


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, each at least one row."""
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        held += size
        if held >= limit:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def tokenise(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Token rows of all documents, written to the shared folder.

    ``part`` and ``spot`` name the row; ``rank`` counts the earlier tails of the same length in the part and
    ``full_before`` the full sequences before it. They are facts of the written files, whichever attempt of a
    task wrote them.
    """
    key, kind = docs.schema[doc_id].dataType.simpleString(), id_kind(path, end)
    width = int(kind[-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, spot, full = _encoder(path), TaskContext.get().partitionId(), 0, 0
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for start, stop in _blocks(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK):
                ids, counts = encoder.encode(texts.slice(start, stop - start), end)
                tails = (counts % sequence).tolist()
                ranks = []
                for tail in tails:
                    ranks.append(seen[tail])
                    seen[tail] += 1
                fulls = np.cumsum(counts // sequence)
                offsets = np.concatenate([[0], np.cumsum(counts)]) * width
                coded = pa.Array.from_buffers(pa.binary(), len(counts), [
                    None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array([part] * len(counts), pa.int32()),
                     pa.array(range(spot, spot + len(counts)), pa.int64()), pa.array(counts, pa.int32()),
                     pa.array(tails, pa.int32()), pa.array(ranks, pa.int64()),
                     pa.array(full + fulls - counts // sequence, pa.int64()), coded],
                    ["doc_id", "part", "spot", "tokens", "tail", "rank", "full_before", "ids"])
                spot += len(counts)
                full += int(fulls[-1])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return staged(chosen.mapInArrow(releasing(rows), _TOKENS.format(key)), "tokens")


def plan_packs(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int, int]]:
    """Placements for tails: (tail, first rank, count, start, length, first pack, offset).

    Ranks ``first rank .. + count`` of that tail length put their tokens ``start .. + length`` at ``offset`` of
    packs ``first pack .. + count``. Every rank of every length is placed whole or in cut parts, no pack holds
    more than ``sequence``, and there are as few packs as the sum allows. The size of the plan depends on the
    sequence length, not on the number of documents.
    """
    waiting = {length: deque([(length, 0, count, 0)]) for length, count in histogram.items() if length and count}
    most = -(-sum(length * count for length, count in histogram.items()) // sequence)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first pack, count)
    opened, placed = 0, []
    for length in range(sequence, 0, -1):
        queue = waiting.get(length, deque())
        largest = max(gaps, default=0)
        while queue:
            tail, rank, count, start = queue.popleft()
            while largest and not gaps.get(largest):
                largest -= 1
            if largest < length and opened < most:
                taken = min(count, most - opened)
                pack, gap, offset, size = opened, sequence, 0, length
                opened += taken
            else:
                run, many = gaps[largest].pop()
                taken = min(count, many)
                if many > taken:
                    gaps[largest].append((run + taken, many - taken))
                pack, gap, offset, size = run, largest, sequence - largest, min(length, largest)
            placed.append((tail, rank, taken, start, size, pack, offset))
            if gap > size:
                gaps[gap - size].append((pack, taken))
                largest = max(largest, gap - size)
            if size < length:
                rest = waiting.setdefault(length - size, deque())
                rest.append((tail, rank, taken, start + size))
            if count > taken:
                queue.appendleft((tail, rank + taken, count - taken, start))
    return placed


def _by_tail(plan: list) -> dict[int, list[tuple[list[int], list[tuple]]]]:
    """Per tail length, its placements sorted by first rank, one layer for each cut part."""
    layers: dict[int, list[tuple[list[int], list[tuple]]]] = {}
    for row in sorted(plan, key=lambda row: (row[0], row[1], row[3])):
        for ranks, rows in layers.setdefault(row[0], []):
            if rows[-1][1] + rows[-1][2] <= row[1]:
                break
        else:
            ranks, rows = [], []
            layers[row[0]].append((ranks, rows))
        ranks.append(row[1])
        rows.append(row)
    return layers


def pack(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. A document of k full
    sequences gives k pieces that fill sequences of their own; the tail goes where the plan puts it. Every id
    lies in exactly one piece, offsets have no gaps, and all sequences but one are full. Sequences of tails
    are numbered from 0, those of full pieces follow. Repeated rows and ids are packed like any others; other
    columns are not read; an empty table gives no pieces.
    """
    key, kind = docs.schema[doc_id].dataType.simpleString(), id_kind(path, end)
    tokens = tokenise(docs, path, end, doc_id, text, sequence)
    counts = tokens.groupBy("part", "tail").agg(
        F.count("*").alias("n"), F.sum(F.expr(f"tokens div {sequence}")).alias("full"))
    counts = staged(counts, "lengths")
    histogram = {row["tail"]: row["n"] for row in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # <= sequence rows
    plan = plan_packs(histogram, sequence)
    packs = 1 + max((row[5] + row[2] - 1 for row in plan), default=-1)
    shared = docs.sparkSession.sparkContext.broadcast(_by_tail(plan))

    # Ranks go on from part to part within a tail length. The full sequences of the parts are one number a part, that is a
    # task, and are summed on the driver.
    earlier = W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.select("part", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_start"))
    fulls = sorted(tuple(row) for row in counts.groupBy("part").agg(F.sum("full").alias("full")).collect())
    starts = accumulate((full for _, full in fulls), initial=0)
    fulls = docs.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(fulls, starts)], "part int, full_start long")
    offsets = ranks.join(fulls, "part")
    joined = tokens.join(offsets, ["part", "tail"]).select(
        "doc_id", "tokens", "tail", (F.col("rank") + F.col("rank_start")).alias("rank"),
        (F.col("full_before") + F.col("full_start")).alias("full"), "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = shared.value
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            source, rows = [], []
            columns = [batch.column(name).to_pylist() for name in ("tokens", "tail", "rank", "full")]
            ids = batch.column(5)
            for at, (total, tail, rank, full) in enumerate(zip(*columns)):
                full_tokens, coded = total - tail, np.frombuffer(ids[at].as_py(), dtype=kind).astype("<u4")
                cuts = [(k * sequence, sequence, packs + full + k, 0) for k in range(full_tokens // sequence)]
                for ranks, runs in layers.get(tail, []) if tail else []:
                    run = runs[bisect_right(ranks, rank) - 1]
                    if run[1] <= rank < run[1] + run[2]:
                        cuts.append((full_tokens + run[3], run[4], run[5] + rank - run[1], run[6]))
                for start, length, number, offset in cuts:
                    source.append(at)
                    part = coded[start : start + length].tobytes()
                    rows.append((start, length, part, zlib.crc32(part), total, number, offset))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(values, of) for values, of in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int32())), *made],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return joined.mapInArrow(releasing(pieces), _PIECES.format(key))
