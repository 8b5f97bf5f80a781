"""Layers, diffs, datasets, prompts, markers."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import markers, prompts
from corpusmill.operators import dataset, diff, layers

LINES = "source_id string, layer_version int, ordinal int, content string"


def layered(spark, versions):
    """``{source: {version: [lines]}}`` as chunk rows."""
    rows = [
        (source, version, at, line)
        for source, by_version in versions.items() for version, lines in by_version.items() for at, line in enumerate(lines)
    ]
    return spark.createDataFrame(rows, LINES).withColumns({
        "chunk_id": F.concat("source_id", F.lit("-"), F.col("layer_version").cast("string"), F.lit("-"), F.col("ordinal").cast("string")),
        "doc_id": F.lit("d"), "geological_age": F.lit("Holocene"),
    })


def edited_sources(seed=3, count=40):
    rng, sources = random.Random(seed), {}
    for number in range(count):
        old = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 12)) for _ in range(rng.randint(1, 40))]
        new = [line for line in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 5)):
            new.insert(rng.randint(0, len(new)), f"new{rng.randint(0, 9)}")
        if rng.random() < 0.3:
            rng.shuffle(new)
        sources[f"s{number}"] = {1: old, 2: new or ["only"]}
    sources["same"] = {1: ["x", "y"], 2: ["x", "y"]}
    sources["rewritten"] = {1: ["a", "b"], 2: ["c", "d", "e"]}
    sources["lonely"] = {1: ["a"]}
    return sources


def test_line_rows_rebuild_the_new_layer_for_long_sources(spark):
    sources = edited_sources(seed=5)
    chunks = layered(spark, sources)
    rows: dict[str, list] = {}
    for row in diff.diff_lines(chunks, 1, 2).orderBy("source_id", "piece", "seq").collect():
        rows.setdefault(row.source_id, []).append(row)
    for source, versions in sources.items():
        if source == "lonely":
            assert source not in rows
            continue
        removed = [r.content for r in rows.get(source, []) if r.op == "-"]
        added = [r.content for r in rows.get(source, []) if r.op == "+"]
        kept_old, kept_new = list(versions[1]), list(versions[2])
        for line in removed:
            kept_old.remove(line)
        for line in added:
            kept_new.remove(line)
        assert Counter(kept_old) == Counter(kept_new)
    counted = {r.source_id: r for r in diff.layer_diff_counts(chunks, 1, 2).collect()}
    for source, row in counted.items():
        assert row.added_lines == sum(r.op == "+" for r in rows.get(source, []))


def test_applied_rows_give_the_new_layer(spark):
    sources = edited_sources(seed=7)
    chunks = layered(spark, sources)
    rows = diff.diff_lines(chunks, 1, 2)
    old = chunks.filter("layer_version = 1 AND source_id <> 'lonely'")
    made: dict[str, list] = {}
    for row in diff.apply_diff(old, rows).orderBy("source_id", "ordinal").collect():
        made.setdefault(row.source_id, []).append(row.content)
    assert made == {source: versions[2] for source, versions in sources.items() if source != "lonely"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_matched_lines_rise_are_equal_and_leave_no_more(old, new):
    left, right = diff.matched(np.array(old, dtype=np.int64), np.array(new, dtype=np.int64))
    assert [old[i] for i in left] == [new[j] for j in right]
    assert all(np.diff(left) > 0) and all(np.diff(right) > 0)
    for i, i_end, j, j_end in zip([-1, *left], [*left, len(old)], [-1, *right], [*right, len(new)]):
        assert not set(old[i + 1 : i_end]) & set(new[j + 1 : j_end])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_longest_rising_choice(values):
    best = [0] * len(values)
    for k, v in enumerate(values):
        best[k] = 1 + max((best[m] for m in range(k) if values[m] < v), default=0)
    picked = diff._rising(np.array(values, dtype=np.int64))
    assert len(picked) == max(best, default=0) and all(np.diff(np.array(values)[picked]) > 0)


@pytest.mark.parametrize("limit", [diff.PIECE_LINES, 30_000])
def test_a_hundred_thousand_repeated_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(diff, "PIECE_LINES", limit)
    rng = random.Random(9)
    old = [rng.choice(["}", "", "return", "x = 1"]) for _ in range(100_000)]
    new = old[:20_000] + ["added"] + old[20_000:70_000] + old[70_010:] + ["}", "end"]
    both = [("s", k, line, False) for k, line in enumerate(old)] + [("s", k, line, True) for k, line in enumerate(new)]
    lines = spark.createDataFrame(pd.DataFrame(both, columns=["source_id", "ordinal", "content", "is_new"])).repartition(8)
    rows = diff.diff_rows(lines).cache()
    if limit == diff.PIECE_LINES and limit > 100_000:
        assert rows.count() < 2_000
    made = diff.apply_diff(lines.filter("NOT is_new").select("source_id", "ordinal", "content"), rows).orderBy("ordinal").collect()
    assert [row.content for row in made] == new


def test_counts_do_not_take_rules_for_headers_and_see_moves(spark):
    chunks = layered(spark, {"rule": {1: ["a", "-- rule", "b"], 2: ["a", "b"]}, "moved": {1: ["x", "y"], 2: ["y", "x"]}})
    found = {r.source_id: (r.changed, r.added_lines, r.removed_lines) for r in diff.layer_diff_counts(chunks, 1, 2).collect()}
    assert found == {"rule": (True, 0, 1), "moved": (True, 1, 1)}


def test_diff_counts(spark):
    chunks = layered(spark, {"s": {1: ["alpha", "beta", "gamma"], 2: ["alpha", "BETA", "gamma", "delta"]}, "t": {1: ["x", "y"], 2: ["y", "x"]}})
    found = {r.source_id: (r.changed, r.added_lines, r.removed_lines) for r in diff.layer_diff_counts(chunks, 1, 2).collect()}
    assert found == {"s": (True, 2, 1), "t": (True, 1, 1)}


def test_text_diffs(spark):
    texts = spark.createDataFrame([(1, "a\nb\n", "a\nc"), (2, "", ""), (3, "same", "same"), (4, "", "x")], "k int, o string, n string")
    counts = {r.k: (r.changed, r.added_lines, r.removed_lines) for r in diff.text_diff_counts(texts, "k", "o", "n").collect()}
    assert counts == {1: (True, 1, 1), 2: (False, 0, 0), 3: (False, 0, 0), 4: (True, 1, 0)}


def test_running_folds_match_a_plain_loop(spark):
    rng = random.Random(1)
    points = [(f"s{n % 2}", n, rng.randint(0, 50)) for n in range(60)]
    frame = spark.createDataFrame(points, "source_id string, i int, j int")
    ups = {(r.source_id, r.i): r.max_j for r in diff.running(frame, "i", "j", F.max, block=7).collect()}
    downs = {(r.source_id, r.i): r.min_j for r in diff.running(frame, "i", "j", F.min, backwards=True, block=7).collect()}
    for source, i, _ in points:
        assert ups[source, i] == max(j for s, at, j in points if s == source and at <= i)
        assert downs[source, i] == min(j for s, at, j in points if s == source and at >= i)


def test_time_travel(spark):
    chunks = layered(spark, {"s": {1: ["Alpha fact.", "Beta fact."], 2: ["Alpha fact.", "Gamma fact.", "Delta fact."]}, "t": {1: ["x"]}})
    now = layers.time_travel(chunks).filter("source_id = 's'").collect()
    assert {(r.layer_version, r.is_latest, tuple(r.available_versions)) for r in now} == {(2, True, (1, 2))} and len(now) == 3
    old = layers.time_travel(chunks, 1).filter("source_id = 's'").collect()
    assert {(r.layer_version, r.is_latest) for r in old} == {(1, False)}
    assert layers.time_travel(chunks, 9).count() == 0
    wanted = spark.createDataFrame([("s",), ("u",)], "source_id string")
    assert {tuple(r) for r in layers.next_versions(wanted, chunks).collect()} == {("s", 3), ("u", 1)}


def test_pairs(spark):
    chunks = layered(spark, {"s": {1: ["First fact here. Second fact."]}})
    found = dataset.build_pairs(chunks, fmt="alpaca", templates=["summarise", "age"]).orderBy("template_no").collect()
    assert [(r.instruction, r.input, r.output) for r in found] == [
        ("Summarise this fossil record concisely.", "First fact here. Second fact.", "First fact here."),
        ("From which geological age is this fossil layer?", "First fact here. Second fact.", "Holocene")]
    chat = dataset.build_pairs(chunks, templates=["qa"]).first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"]
    assert chat.messages[1].content.endswith("\n\nFossil:\nFirst fact here. Second fact.")
    with pytest.raises(ValueError, match="unknown template"):
        dataset.build_pairs(chunks, templates=["nope"])
    with pytest.raises(ValueError, match="format"):
        dataset.build_pairs(chunks, fmt="csv")


def test_prompts_and_summaries(spark):
    def hits(contents):
        made = [F.struct(F.lit("Holocene").alias("geological_age"), F.lit(c).alias("content")) for c in contents]
        return F.array(*made) if made else F.array().cast("array<struct<geological_age:string,content:string>>")

    def value(column):
        return spark.range(1).select(column).first()[0]

    none = F.lit(None).cast("string")
    assert value(prompts.grounded_prompt(F.lit("q"), none, hits([]))) == (
        "Fossil context:\n(no fossils retrieved)\n\nTask: Summarise the relevant fossils for the query.\nQuery: q")
    assert value(prompts.grounded_prompt(F.lit("q"), F.lit("do"), hits(["a"]))) == "Fossil context:\n- [Holocene] a\n\nTask: do\nQuery: q"
    assert value(prompts.extractive_summary(none, hits([]))).startswith("No fossils matched")
    long = "x" * 198 + "  yz. more"
    for instruction in ("plain", "it's", "a \"b\"", "both ' and \"", "back\\slash\n"):
        expected = f"Based on 2 retrieved fossil fragment(s) (instruction: {instruction!r}):\n- One\n- " + ("x" * 198) + "…"
        assert value(prompts.extractive_summary(F.lit(instruction), hits([" One. Two.", long]))) == expected


LINE = (
    "2026-05-29 ERROR: request to /api failed with HTTP 503 after 1200ms; retries=3; error_rate=4.5%. Raised ConnectionError. See ERR-4521."
)


@pytest.mark.parametrize("line,expected", [
    (LINE, [
        ("date", "2026-05-29", "2026-05-29"), ("metric", "1200ms", "1200"), ("metric", "4.5%", "4.5"), ("metric", "retries=3", "3"),
        ("metric", "error_rate=4.5", "4.5"), ("error_code", "ERR-4521", None), ("error_code", "HTTP 503", "503"), ("error_code", "ConnectionError", None)]),
    ("On 2026-05-29 the error_rate was 4.5% with 12 errors.", [
        ("date", "2026-05-29", "2026-05-29"), ("metric", "4.5%", "4.5"), ("metric", "12 errors", "12")]),
    ("HTTP 500 then HTTP 500 again", [("error_code", "HTTP 500", "500")]),
    ("5/6/2024 E503 status 404", [("date", "5/6/2024", None), ("error_code", "E503", None), ("error_code", "status 404", "404")]),
    ("", []),
])
def test_markers(spark, line, expected):
    found = spark.createDataFrame([(line,)], "t string").select(markers.extract_markers(F.col("t")).alias("m"))
    assert [tuple(m) for m in found.first().m] == expected
    counts = found.select(markers.marker_counts(F.col("m"))).first()[0]
    assert counts == dict(Counter(kind for kind, _, _ in expected))
