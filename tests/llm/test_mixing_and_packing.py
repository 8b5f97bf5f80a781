"""Mixing and packing against plain loops, with odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_targets(sizes):
    """Share, stop at twice the size, share the excess again."""
    weights = [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / total for k in open_}
        left = 0.0
        for k in list(open_):
            target[k] += share[k]
            if target[k] >= 2.0 * sizes[k]:
                left += target[k] - 2.0 * sizes[k]
                target[k] = 2.0 * sizes[k]
                open_.discard(k)
    return target


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 10, 10], [1, 2, 3, 400, 5, 6], [0, 0], [0, 50], [7, 7, 7]])
def test_targets_as_by_sharing_again(spark, sizes):
    table = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    found = [r.target for r in mixing.source_targets(table).orderBy("source").collect()]
    assert found == pytest.approx(plain_targets(sizes), abs=1e-6)


def documents(spark):
    rows = [(k, "w " * (k % 17), None if k % 5 == 4 else f"s{k % 5 % 2 * (k % 3)}", 1, 2, 3) for k in range(300)]
    rows += [(None, "a b c", "s0", 1, 2, 3), (5, None, "s1", 1, 2, 3), (7, "", "s1", 1, 2, 3), (8, "x y", "s2", 1, 2, 3), (8, "x y", "s2", 1, 2, 3)]
    rows += [(9, "long " * 50_000, "s0", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target int, block int")


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by_source = defaultdict(lambda: [0, 0, None])
    sources = [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((i or -1, n) for i, _, n in sources)
    for r in found:
        got = by_source[(r.source_size, r.target)]
        got[0] += r.taken
        got[1] += r.size
    for (size, target), (taken, words, _) in by_source.items():
        assert abs(taken - target) <= 0.5 and words % max(1, size) == 0
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def plain_position(points, share):
    """The time at which the integral of the weights reaches a share of all, by summing small steps."""
    times = np.linspace(0, 1, 200_001)
    weights = np.interp(times, [x for x, _ in points], [w for _, w in points])
    sums = np.concatenate([[0.0], np.cumsum((weights[1:] + weights[:-1]) / 2)])
    return float(np.interp(share * sums[-1], sums, times))


BENT = (((0.0, 0.2), (0.25, 2.0), (0.75, 2.0), (1.0, 0.1)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (0.5, 0.0), (1.0, 1.0)))


@pytest.mark.parametrize("schedules", [mixing.SCHEDULES, BENT])
def test_training_order_repeats_documents_by_position(spark, schedules):
    docs = documents(spark)
    ordered = mixing.training_order(docs, schedules=schedules)
    assert ordered.columns == docs.columns
    copies = Counter()
    mixed = mixing.mix(docs, schedules=schedules).collect()
    for r in mixed:
        copies[r.doc_id] += r.copies
    rows = [(r.doc_id, r.source) for r in ordered.collect()]
    assert Counter(doc_id for doc_id, _ in rows) == +copies
    # The order itself: every copy's place by a plain program; ids that come once, so that copies are told apart.
    sized = [(r.doc_id, r.source, len((r.text or "").split())) for r in docs.collect()]
    sources = sorted({s for _, s, _ in sized if s is not None}) + [None]
    target = {r.doc_id: r.target for r in mixed}
    once = {i for i, n in Counter(i for i, _, _ in sized).items() if n == 1 and i is not None}
    places = defaultdict(list)
    for at, source in enumerate(sources):
        own = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for i, s, n in sized if s == source)
        begin, whole = 0, sum(n for _, n, _ in own)
        for _, n, i in own:
            if i in once:
                places[i] = [plain_position(schedules[at % 3], min(1.0, (begin + whole * k) / target[i])) for k in range(copies[i])]
            begin += n
    seen, line = Counter(), []
    for i, _ in rows:
        if i in once:
            line.append(places[i][seen[i]])
            seen[i] += 1
    assert len(line) > 100 and all(low <= high + 1e-4 for low, high in zip(line, line[1:]))


def test_mix_is_sorted_by_position_and_a_source_may_have_its_own_schedule(spark):
    docs = documents(spark)
    late = ((0.0, 0.0), (0.5, 0.0), (1.0, 1.0))
    found = mixing.mix(docs, given={"s1": late, None: BENT[0]})
    places = [r.position for r in found.collect() if r.position is not None]
    assert places == sorted(places) and len(places) > 100
    own = found.join(docs.select("doc_id", "source"), "doc_id").filter("source = 's1' AND position IS NOT NULL").collect()
    assert own and min(r.position for r in own) >= 0.5
    with pytest.raises(ValueError, match="not a schedule"):
        mixing.mix(docs, schedules=(((0.0, 1.0), (0.9, 1.0)),))


def test_positions_invert_the_demand(spark):
    """A source alone: position p of a document at words b solves target (1.5 p - 0.5 p^2) = b."""
    docs = spark.createDataFrame([(k, "w " * 10, "a") for k in range(40)], "doc_id long, text string, source string")
    found = mixing.mix(docs, schedules=(((0.0, 1.5), (1.0, 0.5)),)).collect()
    begins = sorted(r.position for r in found)
    for k, p in enumerate(begins):
        assert found[0].target * (1.5 * p - 0.5 * p * p) == pytest.approx(10 * k, abs=1e-6)


def test_empty_tables(spark):
    empty = documents(spark).limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.training_order(empty).count() == 0
    assert packing.pack(empty, PATH, 1).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=20))
def test_plans_place_everything_in_the_fewest_packs(histogram):
    plan = packing.plan_packs(histogram, 64)
    covered, packs = defaultdict(list), defaultdict(list)
    for tail, rank, count, start, length, pack, offset in plan:
        for k in range(count):
            covered[tail, rank + k].append((start, length))
            packs[pack + k].append((offset, length))
    assert set(covered) == {(tail, k) for tail, n in histogram.items() for k in range(n)}
    for (tail, _), parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == tail
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(packs) == -(-sum(tail * n for tail, n in histogram.items()) // 64)


def test_pieces_hold_every_id_once(spark):
    texts = ["Hello World, it's é!", None, "", " \t\n", "a" * 9000, "word " * 5000, "<|endoftext|> x", "é café x　y", "İstanbul ß ΣΑΣ"]
    texts += [f"text number {k} " * (k % 60) for k in range(120)]
    rows = [(k, text, 1, 2) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, rank int")
    tokenizer = Tokenizer.from_file(PATH)
    want = {k: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for k, text in enumerate(texts)}
    got, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, PATH, 1).collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(ids) and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: [x for _, ids in sorted(parts) for x in ids] for k, parts in got.items()} == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, want.values())) // 2048)


WORDS = st.lists(st.text(st.sampled_from("abzÀéİıſßΣς\u0301 \t\x1c\x85\u3000.,!?'-\"1²日<|>\n"), max_size=12), max_size=6)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.sampled_from([3, 2_000_000]))
def test_ids_equal_those_of_whole_texts(texts, block):
    encoder, kept = packing._encoder(PATH), packing.BLOCK
    packing.BLOCK = block
    try:
        ids, counts = encoder.encode(pa.array(texts, pa.string()), 1) if texts else (np.empty(0), [])
        alone = [encoder.encode(pa.array([text]), 1)[0].tolist() for text in texts]
    finally:
        packing.BLOCK = kept
    want = [[*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] for text in texts]
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == want if texts else True
    assert alone == want


def test_other_tokenizers_encode_whole_texts():
    encoder = packing._Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  World", "", " a\tb "]
    ids, counts = encoder.encode(pa.array(texts), 7)
    assert not encoder.by_word and packing._encoder(PATH).by_word
    want = [[*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 7] for text in texts]
    assert ids.tolist() == [x for part in want for x in part] and counts.tolist() == list(map(len, want))


def test_a_very_long_text_is_packed_in_parts(spark, monkeypatch):
    text = "Some words, and é more. " * 300_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = sorted(packing.pack(docs, PATH, 1).where("doc_id = 1").collect(), key=lambda r: r.start)
    once = Tokenizer.from_file(PATH).encode("Some words, and é more. ", add_special_tokens=False).ids
    assert np.frombuffer(b"".join(r.ids for r in rows), dtype="<u4").tolist() == once * 300_000 + [1]


def test_repeated_ids_and_null_ids_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert packing.pack(docs, PATH, 1).count() == 3
