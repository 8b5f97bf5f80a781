"""Cleaning, segmentation, packing, identity."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ids, text
from corpusmill.operators import chunking
from corpusmill.plans import QUERIES


def values(spark, items, expression, kind="string"):
    frame = spark.createDataFrame([(at, item) for at, item in enumerate(items)], f"at int, x {kind}")
    return [row[0] for row in frame.orderBy("at").select(expression(F.col("x"))).collect()]


def test_clean_text_strips_controls_and_tidies(spark):
    assert values(spark, ["a\x00b   c\r\n\r\n\r\nd"], text.clean_text) == ["ab c\n\nd"]


def test_clean_text_composes_after_dropping_controls_and_is_idempotent(spark):
    once = values(spark, ["e\x00́ fossil", "a­̈ b", "  x \n　y  \n"], text.clean_text)
    assert once == ["é fossil", "ä b", "x\ny"]
    assert values(spark, once, text.clean_text) == once


def test_compose_matches_the_standard_library(spark):
    samples = ["é", "éé", "한글", "ガ", "Å", "plain", "日本語", "–—…", "ѓ", None]
    expected = [None if s is None else unicodedata.normalize("NFC", s) for s in samples]
    assert values(spark, samples, text.compose) == expected


def test_code_points_left_to_the_jvm_never_compose():
    import re

    kept = re.compile(f"[{text.COMPOSED_ONLY}]")
    second = {
        unicodedata.decomposition(chr(c)).split()[1]
        for c in range(0x110000)
        if len(unicodedata.decomposition(chr(c)).split()) == 2 and "<" not in unicodedata.decomposition(chr(c))
    }
    for code in range(0x10000):
        char = chr(code)
        if kept.match(char):
            assert unicodedata.is_normalized("NFC", char) and not unicodedata.combining(char), hex(code)
            assert f"{code:04X}" not in second, hex(code)


def cleaned(body):
    """The cleaning rule in plain Python, to check the gated replacements against."""
    body = re.sub(r"\r\n?", "\n", body)
    body = "".join(c for c in body if c in "\n\t" or not unicodedata.category(c).startswith("C"))
    body = re.sub("[ \t]+", " ", unicodedata.normalize("NFC", body))
    body = "\n".join(line.strip(text.LINE_SPACE) for line in body.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", body).strip(text.ANY_SPACE)


def test_clean_text_equals_the_plain_rule_for_every_latin_character_and_edge(spark):
    odd = [chr(c) for c in range(0x300)] + list(text.ANY_SPACE) + ["\u200d", "\ue000", "\ufeff", "\u0301", "\U0001f600", "\U000e0001", "\u4e00", "  ", "\r\n\r\n\r"]
    samples = ["", *odd, *(f"e{c}a" for c in odd), *(f"{c}two words.{c}" for c in odd), *(f"日a{c}\n{c}b!{c}" for c in odd)]
    assert values(spark, [*samples, None], text.clean_text) == [*map(cleaned, samples), None]


def test_paragraphs_and_sentences_are_trimmed_of_every_space(spark):
    samples = ["", "\n", *(f"{c}One.{c}Two.{c}\n\n{c}\n \t\n{c}Three?{c}" for c in text.ANY_SPACE), "é.", "no break", " é"]
    parts = [[p for p in (q.strip(text.ANY_SPACE) for q in re.split(text.PARAGRAPH_BREAK, s)) if p] for s in samples]
    assert values(spark, [*samples, None], text.paragraphs) == [*parts, None]
    whole = [s.strip(text.ANY_SPACE) for s in samples]
    assert values(spark, samples, text.sentences) == [re.split(text.SENTENCE_BREAK, s) if s else [] for s in whole]


def test_cleaning_replaces_controls_twice_at_most(spark):
    frame = spark.createDataFrame([("a",)], "x string").select(text.clean_text(F.col("x")).alias("c"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count(r"[\p{C}") <= 2


def test_ascii_control_cleaning(spark):
    assert values(spark, [" a\x07b\r\nc   d\te \r"], text.clean_ascii_controls) == ["ab\nc d\te"]


@pytest.mark.parametrize("body,parts", [
    ("First. Second! Third?", ["First.", "Second!", "Third?"]),
    ("e.g. this stays. (New one) \"Quoted\" 3.5 m", ["e.g. this stays.", "(New one) \"Quoted\" 3.5 m"]),
    ("Um.  [x]. 'y'", ["Um.", "[x].", "'y'"]),
    ("   ", []), ("", []), ("no break", ["no break"]),
])
def test_sentences(spark, body, parts):
    assert values(spark, [body], text.sentences) == [parts]


def test_token_estimates(spark):
    assert values(spark, ["", "abcd", "a" * 8, "abcde"], text.estimate_tokens) == [0, 1, 2, 2]


def test_first_sentence_and_half(spark):
    assert values(spark, ["First fact here. Second fact.", "  alone "], text.first_sentence) == ["First fact here.", "alone"]
    assert values(spark, ["A one. B two. C three. D four. E five.", "  "], text.keep_first_half) == ["A one. B two.", "  "]


def greedy(sizes, budget, overlap):
    """The packing rule written as a plain loop, to check the fold against."""
    overlap = min(overlap, max(0, budget - 1))
    bounds, first, used = [], 0, 0
    for at, size in enumerate(sizes):
        if at > first and used + size > budget:
            bounds.append((first, at))
            first, used = at, 0
            if overlap:
                first, used = at - 1, sizes[at - 1]
                while first > bounds[-1][0] and used + sizes[first - 1] <= overlap:
                    first -= 1
                    used += sizes[first]
        used += size
    return bounds + [(first, len(sizes))] if sizes else bounds


@pytest.mark.parametrize("budget,overlap", [(256, 32), (20, 8), (20, 0), (20, 999), (16, 1)])
def test_packing_equals_the_plain_loop(spark, sf, budget, overlap):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = chunking.segment_documents(docs).select("tokens", chunking.pack(F.col("tokens"), budget, overlap).alias("b")).collect()
    for row in rows:
        assert [(b.first, b.end) for b in row.b] == greedy(row.tokens, budget, overlap)


def chunked(spark, body, **options):
    docs = spark.createDataFrame([("d", "s", "f", body)], "doc_id string, source_id string, filename string, text string")
    return chunking.chunk_documents(docs, layer_version=1, **options).orderBy("ordinal").collect()


def test_overlap_shares_sentences(spark):
    body = " ".join(f"Sentence{i} alpha bravo charlie delta." for i in range(8))
    sharing = [row.content for row in chunked(spark, body, max_tokens=20, overlap_tokens=8)]
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(sharing, sharing[1:]))
    apart = [row.content for row in chunked(spark, body, max_tokens=20, overlap_tokens=0)]
    assert " ".join(apart) == body
    assert len(chunked(spark, body, max_tokens=20, overlap_tokens=999)) >= len(sharing)


def test_oversized_segment_stays_whole_and_blank_text_gives_nothing(spark):
    assert len(chunked(spark, "word " * 100, max_tokens=10, overlap_tokens=0)) == 1
    assert chunked(spark, " \n\t ") == []


def test_chunk_rows(spark):
    row = chunked(spark, "Alpha fact. Beta fact.")[0]
    expected = hashlib.sha256(b"d\x000\x00Alpha fact. Beta fact.").hexdigest()
    assert (row.chunk_id, row.ordinal, row.geological_age, row.metadata) == (
        expected, 0, "Holocene", {"filename": "f", "tokens_est": "6"})


def test_json_string_equals_python(spark):
    samples = ['q"\\/\n\r\t\b\f', "\x00\x01\x1f\x7f", "é ü", "\U0001f600", "", "\\u000B literal"]
    assert values(spark, samples, ids.json_string) == [json.dumps(s, ensure_ascii=False) for s in samples]
    assert values(spark, samples, lambda x: ids.json_string(x, ascii_only=True)) == [json.dumps(s) for s in samples]


def test_metadata_chunk_id(spark):
    frame = spark.createDataFrame([("body", "s é", 3, None)], "t string, source string, i int, section string")
    found = frame.select(ids.metadata_chunk_id(F.col("t"), source=F.col("source"), chunk_index=F.col("i"), section=F.col("section"))).first()[0]
    shape = json.dumps({"source": "s é", "chunk_index": 3}, sort_keys=True, separators=(",", ":"))
    assert found == hashlib.sha256(f"body␞{shape}".encode()).hexdigest()
    with pytest.raises(Exception, match="non-empty"):
        frame.select(ids.metadata_chunk_id(F.lit(""))).collect()


def test_documents_without_text_do_not_end_the_chunk_id_query(spark, tmp_path):
    rows = [(1, "body", "en", "web"), (2, "", "de", "books"), (3, None, "fr", "news"), (4, "x", None, None), (4, "x", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["PRJ14_metadata_chunk_ids"](spark, str(tmp_path)).collect()

    def hashed(body, **fields):
        return hashlib.sha256(f"{body}␞{json.dumps(fields, sort_keys=True, separators=(',', ':'))}".encode()).hexdigest()

    assert sorted((r.doc_id, r.chunk_id) for r in found) == [
        (1, hashed("body", source="web", chunk_index=1)), (2, hashed("", source="books", chunk_index=2, section='Part "de"')),
        (3, None), (4, hashed("x", chunk_index=4)), (4, hashed("x", chunk_index=4))]


def test_prompt_key(spark):
    frame = spark.range(1).select(F.array(F.struct(
        F.lit("c1").alias("chunk_id"), F.lit(2).alias("layer_version"), F.lit("Pleistocene").alias("geological_age"))).alias("h"))
    key = lambda instruction: frame.select(ids.prompt_key(F.lit("m"), F.lit('q "x"'), instruction, F.col("h"))).first()[0]
    payload = {"model": "m", "query": 'q "x"', "instruction": "", "hits": [["c1", 2, "Pleistocene"]]}
    assert key(F.lit(None).cast("string")) == key(F.lit("")) == hashlib.sha256(
        json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def test_era_is_clamped(spark):
    assert values(spark, [-3, 1, 2, 10, 99], ids.era, "int") == ["Holocene", "Holocene", "Pleistocene", "Triassic", "Triassic"]


def test_content_types(spark):
    frame = spark.createDataFrame([
        ("a.TXT", ""), ("a.md", "application/octet-stream"), ("a.pdf", "text/plain; charset=x"), ("a.png", ""), ("a.txt", "image/png"), ("noext", "")],
        "f string, c string")
    assert [r[0] for r in frame.select(text.resolve_content_type(F.col("f"), F.col("c"))).collect()] == [
        "text/plain", "text/markdown", "text/plain", None, None, None]


def test_decoding_bad_bytes_and_mark(spark):
    raw = [b"\xef\xbb\xbfhi\r\nyou", b"caf\xe9", b"\xff\xfeok", b""]
    found = values(spark, [bytearray(b) for b in raw], text.decode_utf8, "binary")
    assert found == [b.decode("utf-8-sig", errors="replace").replace("\r\n", "\n").replace("\r", "\n") for b in raw]
