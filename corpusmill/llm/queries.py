"""The registered queries of these operators: whole tables, production parameters, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import (
    crossparse, exact, lexical, mixing, packing, prefix_trie, secret_scan, simhash, substrings, surrogates, toxicity, url_filter, vectors,
)
from corpusmill.llm.common import held_out, prepare, staged
from corpusmill.plans.base import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark, folder):
            return function(prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


TOKENIZER = "word_bpe_49k.json"
END = 1
#: Key of the surrogates of the registered query; a deployment passes its own.
KEY = "registered query"


@query("op1_toxicity")
def toxicity_scores(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def _shown(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@query("op2_secret_scan")
def secrets(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents"))
    counts = [_number(rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*[rule.kind for rule in secret_scan.BASE]))
    return found.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


@query("op3_simhash_near_duplicates")
def near_duplicates(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_exact_duplicates", """
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
hashed AS (SELECT doc_id, points, sha256(t) AS h FROM bare),
best AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM hashed)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM best""")
def exact_duplicates(spark, folder):
    found = exact.exact_groups(table(spark, folder, "documents"), digest_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


@query("op5_repeated_passages")
def repeated_passages(spark, folder):
    return substrings.repeated_passages(table(spark, folder, "documents"))


@query("op6_surrogates")
def surrogate_texts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, KEY)


@query("op7_language")
def languages(spark, folder):
    docs = table(spark, folder, "documents")
    found = crossparse.identify(docs, crossparse.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_near_vectors")
def near_vectors(spark, folder):
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op9_curriculum_mix", """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS bend,
 2.0::DOUBLE * source_size AS most FROM ranked),
levels AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT level FROM levels WHERE level * w < most ORDER BY most / w, rank LIMIT 1),
targets AS (SELECT source, source_size, bend, CASE WHEN (SELECT count(*) FROM level) = 0 THEN most ELSE least(most, (SELECT level FROM level) * w) END AS target FROM levels),
placed AS (SELECT d.*, t.source_size, t.target, t.bend, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
 CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
took AS (SELECT *, (passes * size + greatest(0, least(size, floor(target - passes * source_size + 0.5) - b)))::BIGINT AS taken FROM placed),
timed AS (SELECT *, CASE WHEN taken > 0 THEN least(1.0::DOUBLE, b / target) END AS d FROM took)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 THEN (taken * 2 + size) // (size * 2) ELSE 0 END AS copies,
 round(2.0::DOUBLE * d / (1 + bend + sqrt(greatest(0.0::DOUBLE, (1 + bend) * (1 + bend) - 4 * bend * d))), 9) AS position FROM timed""")
def curriculum_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).withColumn("position", F.round("position", 9))


@query("op10_packed_sequences")
def packed_sequences(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), END)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


# CRC-32 of the decimal id, bit by bit: 256 stands for one shift.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(o.conv_id::VARCHAR, ''),
 lambda x: [ascii(x)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))), lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""


@query("op11_prefix_trie", f"""
WITH coded AS (SELECT conv_id, turn, coalesce(role, '') AS r, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, r, k) AS l FROM coded GROUP BY 1),
chosen AS (SELECT o.conv_id, o.l, b.l AS base, ({_CRC} % 4)::INT AS h FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
rebuilt AS (SELECT conv_id, list_concat(coalesce(base[1:h], []), l[h + 1:]) AS l FROM chosen),
prefixes AS (SELECT conv_id, d, len(l) = d AS ends, l[d].w AS w, array_to_string(list_transform(l[1:d], lambda x: x.k), '') AS p FROM rebuilt, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)),
nodes AS (SELECT p, d, min(conv_id) AS lo, count(*) AS n, coalesce(max(w), 0) AS w, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefixes GROUP BY 1, 2),
kids AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (p)),
under AS (SELECT left(p, 32 * u) AS p, sum((n - 1) * w) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM told) GROUP BY 1)
SELECT t.lo AS conv_id, t.d AS depth, a.lo AS parent_conv_id, t.n AS n_convs, t.kids AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(t.ids) AS ends_sha256
FROM told t JOIN under u USING (p) LEFT JOIN nodes a ON t.d > 0 AND a.p = left(t.p, 32 * (t.d - 1))""")
def conversation_trie(spark, folder):
    own = staged(prefix_trie.sequences(table(spark, folder, "conversations")), "conversations")
    return prefix_trie.prefix_trie(prefix_trie.share_openings(own))


RULES = tuple(url_filter.Rule(*rule) for rule in (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")))


def _listed(values):
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def _hits(strict):
    """Number of terms in SQL: whole words are looked up among the url's words, others at the words' starts."""
    terms = [term for term in url_filter.vocabulary() if term.strict == strict]
    whole = _listed(t.text for t in terms if t.bound == url_filter.BOTH)
    starts = _listed(t.text for t in terms if t.bound == url_filter.START)
    found = f"len(list_intersect(words, {whole}))"
    return f"({found} + len(list_filter({starts}, lambda t: len(list_filter(words, lambda x: starts_with(x, t))) > 0)))::INT" if starts != "[]" else f"{found}::INT"


_SHOWN_RULES = ", ".join(
    f"{{'v': '{r.verdict}', 'h': '{r.host}', 'p': '{r.path}'}}" for r in sorted(RULES, key=lambda r: (-len(r.shown), -len(r.host), r.verdict != "block")))


@query("op12_url_filter", f"""
WITH rests AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
cut AS (SELECT page_id, mark, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE url END AS rest FROM rests),
hosts AS (SELECT page_id, mark, rest, CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS host FROM cut),
parts AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 CASE WHEN mark > 0 THEN regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') ELSE '' END AS path,
 translate(url_decode(regexp_extract(rest, '^[^?#]*')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS seen FROM hosts),
words AS (SELECT page_id, host, path, regexp_extract_all(seen, '[\\pL\\pN]+') AS words FROM parts),
judged AS (SELECT page_id, host, path, list_filter([{_SHOWN_RULES}], lambda r: (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.p))[1] AS r,
 {_hits(True)} AS n_strict, {_hits(False)} AS n_soft FROM words)
SELECT page_id, host, path, CASE WHEN r IS NULL THEN NULL ELSE r.h || r.p END AS rule,
 CASE WHEN r IS NOT NULL THEN r.v WHEN n_strict > 0 OR n_soft > 1 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, n_strict + 0.5::DOUBLE * n_soft AS weight FROM judged""")
def url_verdicts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.UrlFilter(rules=RULES)).drop("url")


def _terms_of(name, id_):
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""(SELECT no, {id_}, unnest(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
 FROM (SELECT row_number() OVER () AS no, {id_}, text FROM {name}))"""


@query("op13_lexical_search", f"""
WITH d AS (SELECT no, doc_id, term, count(*) AS tf FROM {_terms_of("documents", "doc_id")} GROUP BY ALL),
i AS (SELECT no AS item, item_id, term, count(*) AS q FROM {_terms_of("benchmark", "item_id")} GROUP BY ALL),
sizes AS (SELECT no, sum(tf)::BIGINT AS n FROM d GROUP BY 1),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM d, totals GROUP BY term, docs),
lengths AS (SELECT no, 100 - 75 + ((75 * n * docs) // words) AS m FROM sizes, totals),
scored AS (SELECT i.item, i.item_id, d.no, d.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
 FROM i JOIN d USING (term) JOIN weights USING (term) JOIN lengths l ON l.no = d.no GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""")
def lexical_search(spark, folder):
    return lexical.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
