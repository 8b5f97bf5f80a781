"""Prefix trie, URL filter and lexical search against plain programs, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import lexical, prefix_trie, url_filter
from corpusmill.llm.common import staged
from corpusmill.llm.queries import RULES

WORDS = re.compile("[^\x20\x09-\x0d]+")


# ------------------------------------------------------------------ prefix trie


def plain_rebuilt(rows):
    """conv_id to its rebuilt list of (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), role, code, text))
    own = {conv: [(role, text) for _, role, _, text in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    nodes = defaultdict(list)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            nodes[tuple(turns[:depth])].append(conv)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for node in nodes:
        if node:
            kids[node[:-1]] += 1
    for node, members in nodes.items():
        words = len(WORDS.findall(node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not kids[node]
            saved[node[:depth]] += (len(members) - 1) * words
    rows = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(node))
        rows.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), kids[node], leaves[node],
                     saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def conversations(seed):
    pick = random.Random(seed)
    rows = []
    for conv in range(160):
        opening = pick.choice([[], ["hello there"], ["hello there", "how are you"], ["sys " * 4, "a", "b c", "d", "e f g", "h"]])
        turns = opening + [" ".join(pick.choices(["x", "y"], k=pick.randint(0, 2))) for _ in range(pick.randint(0, 5))] or ["only"]
        rows += [(conv, turn, pick.choice(["user", "bot"]) if turn > 6 else "user", text, 1, "c", 0) for turn, text in enumerate(turns)]
    rows += [(c, t, "user", f"same {t}", 1, "c", 0) for c in range(200, 260) for t in range(40)]  # equal copies, deep
    rows += [(c, t, "user", f"same {t if t < 25 else c}", 1, "c", 0) for c in range(300, 340) for t in range(30)]  # a deep common opening
    rows += [(400, t, "user", f"w{t} " * (t % 3), 1, "c", 0) for t in range(500)]  # one long conversation
    rows += [(500, None, None, None, 1, "c", 0), (500, 1, "user", None, 1, "c", 0), (500, None, "bot", "z", 1, "c", 0)]
    rows += [(501, 1, "user", "tie b", 1, "c", 0), (501, 1, "user", "tie a", 1, "c", 0), (501, 1, "user", "tie a", 1, "c", 0)]
    rows += [(None, 1, "user", "nobody", 1, "c", 0), (-7, 0, "user", "minus", 1, "c", 0), (-20, 0, "user", "base", 1, "c", 0)]
    rows += [(9_223_372_036_854_775_807, 0, "user", "largest", 1, "c", 0), (502, 0, "user", "v " * 300_000, 1, "c", 0)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("cap", [6, 120, 1_000_000])
def test_trie_equals_a_plain_trie(spark, cap):
    rows = conversations(3)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, path string, n int").repartition(5)
    own = staged(prefix_trie.sequences(turns), "own")
    found = prefix_trie.prefix_trie(prefix_trie.share_openings(own), cap).collect()
    assert sorted(map(tuple, found), key=repr) == plain_trie(plain_rebuilt(rows))


def test_trie_keeps_turnless_conversations_and_none(spark):
    schema = "conv_id long, path string"
    found = prefix_trie.prefix_trie(spark.createDataFrame([(4, ""), (2, ""), (11, "")], schema)).collect()
    assert list(map(tuple, found)) == [(2, 0, None, 3, 0, 1, 0, hashlib.sha256(b"2,4,11").hexdigest())]
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.share_openings(prefix_trie.sequences(empty)).collect() == []


def test_ids_of_a_sequence_are_hashed_in_order_over_many_pieces(spark):
    many = list(range(0, 30_000, 2))
    paths = spark.createDataFrame([(c, "") for c in many], "conv_id long, path string").repartition(9)
    found = prefix_trie._fold(paths).collect()
    assert [(r.n, r.lo, r.ends) for r in found] == [(len(many), 0, hashlib.sha256(",".join(map(str, many)).encode()).hexdigest())]


# ------------------------------------------------------------------- url filter


def plain_hits(text, terms):
    found = set()
    for term in terms:
        for at in range(len(text)):
            if text.startswith(term.text, at):
                end = at + len(term.text)
                start_ok = not at or not text[at - 1].isalnum()
                end_ok = end == len(text) or not text[end].isalnum()
                if {"both": start_ok and end_ok, "start": start_ok, "any": True}[term.bound]:
                    found.add(term)
    return found


def test_terms_equal_a_plain_search():
    pick = random.Random(1)
    terms = (*url_filter.vocabulary(), url_filter.Term("ab", 1.0, url_filter.ANY), url_filter.Term("a", 0.5), url_filter.Term("a", 0.5, url_filter.START))
    judge = url_filter.UrlFilter(terms)
    for _ in range(400):
        text = "".join(pick.choices(["a", "b", "-", "/", "free", "bets", "casino", "s", ".", "é", "1", "porn"], k=pick.randint(0, 9)))
        assert {terms[k] for k in judge.hits(text)} == plain_hits(text, terms), text


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/casino", "", "", None, "block"),
    ("http://A.NET", "a.net", "", None, "allow"), ("http://A.NET/", "a.net", "/", "net/", "block"), ("x://net/q", "net", "/q", "net/", "block"),
    ("http://w.example.net/en/x?y#z", "w.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://w.example.net/EN/x", "w.example.net", "/EN/x", "net/", "block"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"), ("http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"), ("http://casino.org/", "casino.org", "/", None, "block"),
    ("http://mycasino.com/", "mycasino.com", "/", None, "allow"), ("http://casinos.com/", "casinos.com", "/", None, "block"),
    ("http://www.essex.gov/sussex", "www.essex.gov", "/sussex", None, "allow"), ("http://free.com/free/free", "free.com", "/free/free", None, "allow"),
    ("http://free-bets.example.com/a", "free-bets.example.com", "/a", None, "block"), ("http://a.com?x=casino", "a.com", "", None, "allow"),
    ("http://a.com/%63asino", "a.com", "/%63asino", None, "block"), ("http://h#://x/y", "h", "", None, "allow"), ("://net/", "net", "/", "net/", "block"),
    ("http://a.net:80/", "a.net:80", "/", None, "allow"),
])
def test_urls_are_split_ruled_and_judged(url, host, path, rule, verdict):
    assert url_filter.UrlFilter(rules=RULES).judge(url)[:4] == (host, path, rule, verdict)


def test_equally_long_rules_and_large_tables(spark):
    judge = url_filter.UrlFilter((), (url_filter.Rule("allow", "a.b", "/cc"), url_filter.Rule("block", "x.a.b", "/"), url_filter.Rule("allow", "x.a.b", "/")))
    assert judge.judge("h://x.a.b/cc/d")[2:4] == ("x.a.b/", "block")
    assert judge.judge("h://a.b/cc")[2:4] == ("a.b/cc", "allow")
    rows = [(k, f"http://h{k % 7}.net/{k}" if k % 5 else None, "own", "x" * (k % 3)) for k in range(60)] + [(1, "http://h1.net/1", "own", "x")] * 2
    rows += [(99, "http://" + "long." * 20_000 + "org/fr/" + "y" * 100_000, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Verdict string, judged string")
    filter_ = url_filter.UrlFilter(rules=RULES)
    found = url_filter.judge(pages, filter_)
    assert found.columns == ["page_id", "url", "judged", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"]
    assert sorted(map(repr, found.select("page_id", "url", "verdict").collect())) == sorted(
        f"Row(page_id={i!r}, url={u!r}, verdict={filter_.judge(u)[3]!r})" for i, u, *_ in rows)
    kept = url_filter.keep_allowed(pages, filter_)
    assert kept.columns == pages.columns and kept.count() == sum(filter_.judge(u)[3] == "allow" for _, u, *_ in rows)
    assert url_filter.judge(pages.limit(0), filter_).count() == 0


# --------------------------------------------------------------- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, k=10):
    counted = [(doc, Counter(TERM.findall((text or "").translate(LOWER)))) for doc, text in docs]
    counted = [(doc, terms) for doc, terms in counted if terms]
    N, L = len(counted), sum(sum(terms.values()) for _, terms in counted)
    df = Counter(term for _, terms in counted for term in terms)
    out = []
    for item, text in items:
        scored = []
        for doc, terms in counted:
            n = sum(terms.values())
            m = 100 - 75 + (75 * n * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * terms[t]) // (1000 * terms[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in terms)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed):
    pick = random.Random(seed)
    vocabulary = ["the", "The", "cat", "dog", "é", "É", "日本", "x1", "a_b", "naïve", "\u00a0", "zz"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([0, 1, 5, 40])))) for k in range(300)]
    docs += [(1000 + k, "copy of one text, again") for k in range(40)] + [(7, "copy of one text, again"), (7, "copy of one text, again")]
    docs += [(None, "copy of one text, again"), (2000, None), (2001, ""), (2002, "... !"), (2003, "w1 " * 700_000 + "cat"), (2004, "\x00a\x7fb")]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([1, 3, 8])))) for k in range(12)]
    items += [(50, "copy TEXT copy"), (50, "again"), (51, None), (52, ""), (53, "unknown words"), (None, "cat"), (54, "w1 " * 5_000)]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"ITEMS": 5}, {"DOCS": 3, "TERMS": 2}, {"ENTRIES": 4, "PIECE": 7}])
def test_ranks_equal_a_plain_search(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = texts(5)
    found = lexical.rank_documents(
        spark.createDataFrame([(*row, 1, "x") for row in docs], "doc_id long, text string, score int, rank string").repartition(6),
        spark.createDataFrame([(*row, 2) for row in items], "item_id long, text string, doc_id int"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_ranks(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")
    assert lexical.rank_documents(blank, items).collect() == []


def test_products_stay_exact_where_sums_would_not(monkeypatch):
    monkeypatch.setattr(lexical.Weights, "step", 50)
    round_ = [(0, Counter({b"a": 9, b"b": 1})), (1, Counter({b"b": 4, b"c": 2}))]
    weights = lexical.Weights(round_, {b"a": 0, b"b": 1, b"c": 2}, 40, np.array([30, 1, 0]))
    assert weights.largest.max() > 4 * weights.step
    tiles = list(weights.tiles(np.arange(3)))
    assert np.array_equal(np.concatenate(tiles), np.arange(3))
    whole = np.zeros((3, 2))
    for tile in tiles:
        parts = list(weights.dense(tile))
        assert all(part.max() <= weights.step for part in parts)
        assert all(part.max(axis=1).sum() <= weights.step for part in parts)
        whole[tile] += sum(parts, np.zeros((len(tile), 2)))
    expected = [[9 * lexical.term_weight(40, 30), 0], [lexical.term_weight(40, 1), 4 * lexical.term_weight(40, 1)], [0, 0]]
    assert whole.tolist() == expected
