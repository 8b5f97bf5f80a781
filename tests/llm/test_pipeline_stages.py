"""The stages against brute force, and the registered queries."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from corpusmill.llm import mixing, queries, toxicity
from test_exact_and_simhash import bare, plain_components, plain_fingerprint


def test_stages_keep_what_they_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, sf).cache()
    assert clean.columns == columns
    bias, amount, density = model.weights
    want = set()
    for doc_id, text in rows.items():
        a, b = toxicity.features(text, model)
        if bias + amount * a + density * b < -0.8472978603872037:  # logit of 0.3
            want.add(doc_id)
    assert {r.doc_id for r in clean.collect()} == want

    exact = stages["exact_dedup"](spark, clean, sf).cache()
    groups = {}
    for doc_id in want:
        groups.setdefault(bare(rows[doc_id]), []).append((-len(rows[doc_id]), doc_id))
    kept = {min(group)[1] for group in groups.values()}
    assert exact.columns == columns and sorted(r.doc_id for r in exact.collect()) == sorted(kept)

    near = stages["simhash_dedup"](spark, exact, sf).cache()
    ids = sorted(kept)
    components, _ = plain_components([plain_fingerprint(rows[i]) for i in ids], ids)
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(set(components))

    mixed = stages["mixing"](spark, near, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == copies

    packed = stages["packing"](spark, mixed, sf).collect()
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    for r in packed:
        assert lengths[r.doc_id] == r.doc_tokens * copies[r.doc_id]


def test_run_is_the_stages_in_turn(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_every_operator_has_a_query(spark):
    names = [re.match(r"op(\d+)_", name) for name in queries.QUERIES]
    assert sorted(int(m[1]) for m in names if m) == list(range(1, 14)) and "pipeline" in queries.QUERIES
