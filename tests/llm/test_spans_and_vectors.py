"""Repeated passages, surrogates and vectors, with planted cases and odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import substrings, surrogates, vectors
from corpusmill.llm.common import merge_labels


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstué") for _ in range(rng.randint(2, 9))) for _ in range(words))


# --- repeated passages ----------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_gear_hashes_depend_on_sixteen_bytes(data):
    octets = np.frombuffer(data, dtype=np.uint8)
    found = substrings.gear_hashes(octets)
    for at in range(len(octets)):
        want = 0
        for back in range(min(16, at + 1)):
            want += int(substrings._GEAR[octets[at - back]]) << back
        assert int(found[at]) == want & 0xFFFF


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(0, 5))
def test_borders_keep_characters_whole(text, more):
    data = (text + "é" * (more * 700)).encode("utf-8", "surrogatepass")
    ends = [0, *substrings.borders(data).tolist()]
    assert ends[-1] == len(data) and all(0 < b - a <= substrings.MOST + 3 for a, b in zip(ends, ends[1:]))
    if "\ud800" > max(text, default=""):
        for a, b in zip(ends, ends[1:]):
            data[a:b].decode()


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    passages = [prose(rng, 60) for _ in range(20)]
    texts = [prose(rng, 150) for _ in range(80)]
    holders = {}
    for k, passage in enumerate(passages):
        for at in rng.sample(range(60), 3):
            cut = rng.randrange(len(texts[at]))
            texts[at] = texts[at][:cut] + " " + passage + " " + texts[at][cut:]
            holders.setdefault(at, []).append(passage)
    rows = [(k, text, "s", "r") for k, text in enumerate(texts)] + [(200, None, "s", "r"), (201, "", "s", "r"), (None, "tiny", "s", "r"), (202, "x" * 200_000, "s", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, row string")
    found = substrings.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == set(holders)
    for r in found:
        assert any(texts[r.doc_id][r.start : r.end] in passage or passage in texts[r.doc_id][r.start : r.end] or texts[r.doc_id][r.start + 20 : r.end - 20] in " ".join(holders[r.doc_id]) for passage in holders[r.doc_id])
        assert r.copies >= 2 and r.removed == (r.first_doc_id != r.doc_id)
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def test_copies_of_documents_and_repeats_inside_one(spark):
    rng = random.Random(7)
    text, inner = prose(rng, 80), prose(rng, 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, f"{inner} {inner}")], "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.end, r.copies) for r in substrings.repeated_passages(docs).collect())
    assert found == [(1, 0, len(text), 3), (1, 0, len(text), 3), (2, 0, len(text), 3)]


def test_removed_stretches_stay_whole_in_their_first_holder(spark):
    """Each small chunk of a passage is in an early document, too; passages overlap, meet and repeat."""
    rng = random.Random(8)
    one, two, three = (prose(rng, 60) for _ in range(3))
    runs = [(0, *substrings.borders(p.encode()).tolist()) for p in (one, two, three)]
    octets = [p.encode() for p in (one, two, three)]
    pieces = sorted({data[a:b].decode() for data, ends in zip(octets, runs) for a, b in zip(ends, ends[1:])}, key=len)
    early = prose(rng, 30) + "".join(p for piece in pieces for p in (piece, prose(rng, 12)))
    line = prose(rng, 12)
    texts = [early, *(f"{prose(rng, 40)} {p} {prose(rng, 40)}" for p in (
        one, f"{two} {line} {three}", f"{one} {two}", three, f"{two} {prose(rng, 20)} {one}", f"{line} " * 9, f"{line} " * 14, one + two + three))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = substrings.repeated_passages(docs).collect()
    left = {k: [] for k in range(len(texts))}
    for r in found:
        if r.removed:
            left[r.doc_id].append((r.start, r.end))
    kept = {}
    for k, text in enumerate(texts):
        edges = [0, *(edge for pair in sorted(left[k]) for edge in pair), len(text)]
        assert edges == sorted(edges)
        kept[k] = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    assert sum(r.removed for r in found) > 8 and not left[1]
    for r in found:
        stretch = texts[r.doc_id][r.start : r.end]
        assert any(stretch in part for part in kept[r.first_doc_id]), (r, stretch)
    for passage in (one, two, three):
        assert sum(any(passage[90:-90] in part for part in kept[k]) for k in kept) == 1


def test_spans_are_cut_out(spark):
    frame = spark.createDataFrame([("abcdef", [0, 1, 3, 5]), ("abc", None), (None, [0, 1])], "t string, s array<int>")
    assert [r.x for r in frame.select(substrings.without_spans("t", "s").alias("x")).collect()] == ["bcf", "abc", None]


# --- surrogates -----------------------------------------------------------------------------------

PEOPLE = [
    (1, "Call Mr. John Smith at +1 (212) 555-0147 or john.smith@mail.example.org."), (2, "John Smith? No, Mr. John Smith, 10.0.0.7 and 10.0.0.8."),
    (3, "Frau Müller paid with 4539 1488 0343 6467, ssn 123-45-6789."), (4, "г-жа Иванова and Κύριος Παπαδόπουλος, Mrs Anna-Maria O'Neil"),
    (5, "nothing to hide, version 3.14 of 2024-01-02, 123.4567 kg, 10 000 000"), (6, None), (7, ""), (8, "IBAN DE89 3704 0044 0532 0130 00."), (1, "Mr. John Smith again"),
    (None, "10.0.0.7"), (9, "word " * 60_000 + "end@x.org"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(i, t, "r", "f") for i, t in PEOPLE], "doc_id long, text string, replaced string, found string")
    made = surrogates.replace_entities(docs, "key")
    assert made.columns == ["doc_id", "text", "found", "replaced"]
    return docs, [(r.doc_id, r.text, [(x.kind, x.start, x.surrogate) for x in r.replaced]) for r in made.collect()]


def test_entities_are_gone_and_the_rest_stays(replaced):
    _, rows = replaced
    assert len(rows) == len(PEOPLE)
    everything = " ".join(text or "" for _, text, _ in rows)
    for secret in ("555-0147", "john.smith@", "10.0.0.7", "10.0.0.8", "4539 1488", "123-45-6789", "Mr. John", "Müller", "Иванова", "Παπα", "O'Neil", "3704", "end@x"):
        assert secret not in everything
    assert {(i, text) for i, text, spans in rows if not spans} == {(i, text) for i, text in PEOPLE if i in (5, 6, 7)}
    for _, text, spans in rows:
        for _, start, value in spans:
            assert text[start : start + len(value)] == value


def test_formats_genders_and_scripts(replaced):
    _, rows = replaced
    spans = {(i, kind): value for i, _, found in rows for kind, _, value in found}
    assert re.fullmatch(r"\+1 \([1-9]\d\d\) [1-9]\d\d-[1-9]\d{3}", spans[1, "phone"])
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.org", spans[1, "email"])
    assert re.fullmatch(r"[A-Z]\w+ [A-Z]\w+", spans[1, "name"])
    card = spans[3, "card"].replace(" ", "")
    digits = [int(d) for d in card][::-1]
    assert card[0] == "4" and sum(digits[::2]) % 10 == (-sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", spans[3, "ssn"])
    names = [value for i, _, found in rows if i == 4 for kind, _, value in found]
    assert re.search("[а-я]", names[0]) and names[0][-1] in "ая" and re.search("[α-ω]", names[1])
    assert spans[8, "iban"].startswith("DE") and len(spans[8, "iban"]) == len("DE89 3704 0044 0532 0130 00")


def test_same_entity_same_surrogate_and_distinct_ones_differ(spark, replaced):
    _, rows = replaced
    smith = {value for i, _, found in rows if i in (1, 2) for kind, _, value in found if kind == "name"}
    assert len(smith) == 1
    few = [(k, f"{a}.{b}.1.1") for k, (a, b) in enumerate((a, b) for a in range(1, 10) for b in range(1, 10))]
    made = surrogates.replace_entities(spark.createDataFrame(few, "doc_id long, text string"), "k").collect()
    assert len({r.text for r in made}) == len(few) and not {r.text for r in made} & {text for _, text in few}
    assert surrogates.replace_entities(spark.createDataFrame(few, "doc_id long, text string").limit(0), "k").count() == 0


# --- vectors --------------------------------------------------------------------------------------


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [base[k % 40] + rng.normal(scale=0.02 * (k % 9), size=16) for k in range(400)] + [rng.normal(size=16) for _ in range(100)]
    rows = [np.float32(row).tolist() for row in rows] + [np.float32(base[0]).tolist()] * 30
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    table = [(k, row, 0, "x") for k, row in enumerate(rows + odd)] + [(None, rows[0], 0, "x")]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, copies int, rep string")
    sound = np.array(rows + [rows[0]])
    unit = sound / np.linalg.norm(sound, axis=1)[:, None]
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    a, b = np.nonzero(links)
    labels = merge_labels(np.arange(len(sound)), a, b)
    ids = list(range(len(rows))) + [None]
    want = [(ids[k], int(links[k].sum()), int(labels[k]), ids[k] == int(labels[k])) for k in range(len(sound))]
    want += [(len(rows) + k, 0, len(rows) + k, True) for k in range(len(odd))]
    for tile in (8_192, 100):
        found = vectors.near_duplicates(frame, tile=tile).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=(50, 24)) * rng.uniform(0.01, 50)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        codes, scale, held, error = vectors.quantised(unit)
        approximate = (codes.astype(int) @ codes.astype(int).T) * np.outer(scale, scale)
        assert (np.abs(unit @ unit.T - approximate) <= np.outer(held, error) + error[:, None] + 1e-12).all()
