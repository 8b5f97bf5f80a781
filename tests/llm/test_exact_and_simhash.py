"""Exact and near copies against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from corpusmill.llm import exact, simhash

DOCS = "doc_id long, text string, full_hash string, fp string, digest string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    made = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        made.append(text)
        if k % 3 == 0:
            made += [text, text.replace(" ", "  ", 2), text + "\n"]
        if k % 4 == 0:
            changed = text.split()
            changed[rng.randrange(len(changed))] = "changed"
            made.append(" ".join(changed))
    made += [None, "", " \n\t", "one", "One", "É é", "x" * 300_000, "x" * 300_000 + "y"]
    return [(k, text) for k, text in enumerate(made)] + [(None, "w1 w2"), (7, made[7]), (7, made[7])]


def test_groups_of_equal_texts(spark, rows):
    found = exact.exact_groups(frame(spark, rows), digest_all=True).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = []
    for doc_id, text in rows:
        group = groups[bare(text)]
        best = min(group)
        kept = best[3] == doc_id and -best[0] == len(text or "")
        want.append((doc_id, best[3], len(group), kept, hashlib.sha256(bare(text).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_one_bit_map_still_gives_the_same_groups(spark, rows):
    usual = exact.exact_groups(frame(spark, rows), digest_all=True)
    crowded = exact.exact_groups(frame(spark, rows), bits=64, digest_all=True)
    assert sorted(map(repr, usual.collect())) == sorted(map(repr, crowded.collect()))


def test_unique_texts_are_not_hashed_in_full(spark):
    found = {r.doc_id: r.full_hash for r in exact.exact_groups(frame(spark, [(1, "a b"), (2, "ab"), (3, "abc")])).collect()}
    assert found[3] is None and found[1] == found[2]


def test_keep_one_row_of_each_group(spark, rows):
    docs = frame(spark, rows)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(map(bare, texts)) == sorted({bare(text) for _, text in rows})


def test_the_map_goes_by_the_number_of_pairs_and_lengths_come_first(spark, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_BITS", 64)
    docs = frame(spark, [(k, "x" * (k % 40) + str(k // 2 % 2)) for k in range(400)])
    words, bits = exact.survivor_map(docs)
    assert bits == 1024 and words.agg(F.sum(F.bit_count("word"))).first()[0] <= 40
    lonely = frame(spark, [(k, "y" * k) for k in range(50)])
    words, bits = exact.survivor_map(lonely)
    assert bits == 64 and words.count() == 0
    assert exact.exact_groups(docs).filter("kept").count() == 40


def test_rows_that_agree_in_id_and_text_leave_the_same_row_each_time(spark):
    rows = [(1, "same text", f"s{k}") for k in range(200)] + [(2, "sametext", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in (exact.keep_one, simhash.keep_one):
        runs = {tuple(sorted(map(tuple, keep(docs.repartition(n)).filter("doc_id = 1").collect()))) for n in (1, 3, 8)}
        assert len(runs) == 1 and len(next(iter(runs))) == 1


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact.exact_groups(empty).count() == 0 and exact.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for k in range(len(values)):
        for other in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            a, b = find(k), find(int(other))
            parent[max(a, b)] = min(a, b)
    roots = [find(k) for k in range(len(values))]
    smallest = {}
    for root, doc_id in zip(roots, ids):
        if doc_id is not None:
            smallest[root] = min(doc_id, smallest.get(root, doc_id))
    return [smallest.get(root) for root in roots], roots


def test_fingerprints_and_components(spark, rows):
    found = simhash.near_duplicates(frame(spark, rows)).select("doc_id", "fp", "component_id").collect()
    prints = [plain_fingerprint(text) for _, text in rows]
    want, _ = plain_components(prints, [doc_id for doc_id, _ in rows])
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    assert sorted(map(tuple, found), key=repr) == sorted(zip([i for i, _ in rows], signed, want), key=repr)


@pytest.mark.parametrize("block", [16_384, 8])
def test_dense_groups_of_fingerprints(spark, block):
    """Chains and clouds of fingerprints, in one block and in many."""
    rng = random.Random(block)
    values = {0, 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(60):
            values.add(at)
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    from corpusmill.llm.components import connected_components

    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), block)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    _, want = plain_components(values, signed)
    found, classes = {}, {}
    for value, root in zip(signed, want):
        found.setdefault(roots.get(value, value), set()).add(value)
        classes.setdefault(root, set()).add(value)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = list(map(set, simhash.position_triples()))
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_one_document_of_each_component_stays(spark, rows):
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(text) for _, text in rows]
    _, roots = plain_components(prints, [doc_id for doc_id, _ in rows])
    assert kept.count() == len(set(roots))
