"""Queries over vectors and what is built from hits: search, prompts, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import ids, prompts, text, vectors
from corpusmill.operators import ann, cache, embed, generate, graph, layers, topk
from corpusmill.plans import inputs as I
from corpusmill.plans.base import query, table, with_sql
from corpusmill.session import scratch_path

K = 5
# Settings of the two approximate searches under which recall stays above the bound.
HYPERPLANES, TABLES, PROBES = 3, 16, 16


def _vectors(spark, folder):
    """Embeddings as vector rows: two models by number, sources by label."""
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("source_id"),
        F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model_id"), F.size("embedding").alias("embed_dim"),
        (F.col("label") % 12 + 1).cast("int").alias("layer_version"), ids.era(F.col("label") % 12 + 1).alias("geological_age"),
        "embedding", "vec_id", "label")


_VECTORS_SQL = (
    "vecs AS (SELECT 'v' || vec_id AS chunk_id, 'label-' || label AS source_id, 'm' || vec_id % 2 AS model_id, len(embedding)::INTEGER AS embed_dim, "
    "(label % 12 + 1)::INTEGER AS layer_version, " + I.sql_era("(label % 12 + 1)") + " AS geological_age, embedding::DOUBLE[] AS embedding, vec_id, label FROM embeddings)"
)


def _centres(spark, folder):
    """One query per label: the mean of its vectors."""
    long = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = long.groupBy("label", "at").agg(F.avg("x").alias("x"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells"))
    return listed.select(
        F.concat(F.lit("q"), F.col("label").cast("string")).alias("query_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("scope"),
        F.transform("cells", lambda c: c["x"]).alias("query_embedding"), "label")


_CENTRES_SQL = (
    "centres AS (SELECT 'q' || label AS query_id, 'label-' || label AS scope, label, list(x ORDER BY place) AS query_embedding FROM "
    "(SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2) GROUP BY label)"
)


def _ranked_sql(queries: str = "centres", condition: str = "true", score: str = "list_cosine_similarity(v.embedding, q.query_embedding)", k: int = K) -> str:
    return (
        f"ranked AS (SELECT query_id, chunk_id, score, rank FROM (SELECT q.query_id, v.chunk_id, round({score}, 9) AS score, "
        f"row_number() OVER (PARTITION BY q.query_id ORDER BY round({score}, 9) DESC, v.chunk_id)::INTEGER AS rank FROM {queries} q JOIN vecs v ON {condition}) WHERE rank <= {k})"
    )


_SHOW = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked"


def _shown(ranked):
    return ranked.withColumn("score", F.round("score", 6))


@query("PRJ12_provenance_filter", with_sql(_VECTORS_SQL, select="SELECT chunk_id, source_id, layer_version FROM vecs WHERE model_id = 'm1' AND embed_dim = 64 AND source_id = 'label-3'"))
def provenance(spark, folder):
    return layers.provenance(_vectors(spark, folder), "m1", 64, "label-3").select("chunk_id", "source_id", "layer_version")


@query("VEC1_hash_embedding", "SELECT 'doc-' || doc_id || '.txt' AS source_id, 64 AS dim, 1.0::DOUBLE AS norm FROM documents")
def hash_embedding(spark, folder):
    """Embed every document; the numbers themselves come from numpy's generator, which SQL does not have."""
    docs = I.documents(spark, folder).select("source_id", F.col("text").alias("content"))
    embedded = embed.embed(docs, lambda: embed.HashEmbedder(64))
    return embedded.select("source_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query("VEC2_normalise", """SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 4) AS norm, round(e[1] / n, 4) AS head FROM
 (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS e, (label + 1) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def normalise(spark, folder):
    scaled = table(spark, folder, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)))
    unit = scaled.withColumn("unit", vectors.normalise(F.col("e")))
    return unit.select("vec_id", F.round(vectors.norm(F.col("unit")), 4).alias("norm"), F.round(F.col("unit")[0].cast("double"), 4).alias("head"))


@query("VEC3_dimension_check", "SELECT vec_id, (vec_id % 3 <> 0) AS accepted FROM embeddings")
def dimension_check(spark, folder):
    mixed = table(spark, folder, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    good, rejected = topk.check_dimensions(mixed, 64)
    return good.select("vec_id", F.lit(True).alias("accepted")).unionByName(rejected.select("vec_id", F.lit(False).alias("accepted")))


@query("VEC4_exact_top_k", with_sql(_VECTORS_SQL, _CENTRES_SQL, _ranked_sql(), select=_SHOW))
def exact_top_k(spark, folder):
    return _shown(topk.top_k(_vectors(spark, folder), _centres(spark, folder), K))


@query("VEC4_every_vector_as_query", with_sql(
    _VECTORS_SQL, "everyone AS (SELECT chunk_id || '-' || n AS query_id, embedding AS query_embedding FROM vecs, range(9) t(n))", _ranked_sql("everyone", k=3), select=_SHOW))
def every_vector(spark, folder):
    """Every vector asked nine times: more queries than travel to tasks at once."""
    rows = _vectors(spark, folder)
    times = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n")
    queries = rows.select("chunk_id", F.col("embedding").alias("query_embedding"), times)
    queries = queries.select(F.concat_ws("-", "chunk_id", "n").alias("query_id"), "query_embedding")
    return _shown(topk.top_k(rows, queries, 3))


@query("VEC5_scoped_top_k", with_sql(_VECTORS_SQL, _CENTRES_SQL, _ranked_sql(condition="v.source_id = q.scope"), select=_SHOW))
def scoped_top_k(spark, folder):
    return _shown(topk.top_k(_vectors(spark, folder), _centres(spark, folder), K, scope="source_id", query_scope="scope"))


@query("VEC6_inner_product", with_sql(_VECTORS_SQL, _CENTRES_SQL, _ranked_sql(score="list_dot_product(v.embedding, q.query_embedding)"), select=_SHOW))
def inner_product(spark, folder):
    return _shown(topk.top_k(_vectors(spark, folder), _centres(spark, folder), K, metric="dot"))


#: Share of the exact neighbours that an approximate search must find.
RECALL = 0.9


def _asked_again(spark, folder):
    """Every 50th vector as a query."""
    rows = _vectors(spark, folder).filter("vec_id % 50 = 0")
    return rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _verdict(spark, folder, found):
    """Per query: all hits carry the score that the vectors give, and the searches' recall is high enough."""
    queries, rows = _asked_again(spark, folder), _vectors(spark, folder)
    found = found.cache()
    share = ann.recall(found, topk.top_k(rows, queries, K)).select((F.col("recall") >= RECALL).alias("recalled"))
    scored = found.join(queries, "query_id").join(rows.select("chunk_id", "embedding"), "chunk_id")
    right = F.abs(vectors.cosine(F.col("query_embedding"), F.col("embedding")) - F.col("score")) < 1e-6
    per_query = scored.groupBy("query_id").agg(F.bool_and(right).alias("scores_right"), F.count("*").alias("hits"))
    return per_query.join(F.broadcast(share)).select("query_id", "hits", "scores_right", "recalled")


_VERDICT_SQL = f"SELECT 'v' || vec_id AS query_id, {K}::BIGINT AS hits, true AS scores_right, true AS recalled FROM embeddings WHERE vec_id % 50 = 0"


@query("VEC7_hyperplane_search", _VERDICT_SQL)
def hyperplane(spark, folder):
    codes = ann.HyperplaneCodes(64, bits=HYPERPLANES, tables=TABLES)
    path = scratch_path(spark, "planes")
    ann.write_cells(ann.hyperplane_index(_vectors(spark, folder), codes), path, "chunk_id")
    return _verdict(spark, folder, ann.hyperplane_search(spark.read.parquet(path), codes, _asked_again(spark, folder), K))


#: Share of the table that a graph search may score per query.
SCORED = 0.1
ROTATIONS = 12


def _rotated(spark, folder):
    """Every vector in twelve rotations of its components, five places apart."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(ROTATIONS - 1))).alias("turn")
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", turn)
    turned = F.concat(F.expr("slice(embedding, turn * 5 + 1, size(embedding))"), F.expr("slice(embedding, 1, turn * 5)"))
    return rows.select(F.concat_ws("-", F.concat(F.lit("v"), F.col("vec_id")), "turn").alias("chunk_id"), turned.alias("embedding"), "vec_id", "turn")


@query("VEC7_graph_search", f"""SELECT 'v' || vec_id || '-0' AS query_id, {K}::BIGINT AS hits, true AS scores_right, true AS recalled, true AS few_scored
 FROM embeddings WHERE vec_id % 50 = 0""")
def graph_search(spark, folder):
    """A neighbour graph over all rotated vectors, asked for every 50th vector: hits, recall and the share of rows scored."""
    rows = _rotated(spark, folder)
    path = scratch_path(spark, "graph")
    graph.write_graph_index(rows, path, dim=64)
    index = spark.read.parquet(path)
    asked = rows.filter("vec_id % 50 = 0 AND turn = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = graph.graph_search(index, asked, K).withColumnRenamed("id", "chunk_id")
    told = ann.recall(found, topk.top_k(rows, asked, K)).select((F.col("recall") >= RECALL).alias("recalled"))
    share = found.agg(F.avg("scored").alias("scored")).join(index.agg(F.count("*").alias("n"))).select((F.col("scored") < SCORED * F.col("n")).alias("few_scored"))
    scored = found.join(asked, "query_id").join(rows.select("chunk_id", "embedding"), "chunk_id")
    right = F.abs(vectors.cosine(F.col("query_embedding"), F.col("embedding")) - F.col("score")) < 1e-6
    per_query = scored.groupBy("query_id").agg(F.bool_and(right).alias("scores_right"), F.count("*").alias("hits"))
    return per_query.join(F.broadcast(told)).join(F.broadcast(share)).select("query_id", "hits", "scores_right", "recalled", "few_scored")


@query("VEC8_inverted_lists", _VERDICT_SQL)
def inverted(spark, folder):
    rows = _vectors(spark, folder)
    lists = ann.train_inverted_lists(rows, dim=64)
    path = scratch_path(spark, "lists")
    ann.write_cells(ann.inverted_index(rows, lists), path, "chunk_id")
    found = ann.coded_search(spark.read.parquet(path), lists, _asked_again(spark, folder), K, nprobe=PROBES, refine=20)
    return _verdict(spark, folder, found)


@query("VEC10_index_stats", with_sql(_VECTORS_SQL, select="SELECT model_id, embed_dim, count(*) AS vectors FROM vecs GROUP BY ALL"))
def index_stats(spark, folder):
    return topk.index_stats(_vectors(spark, folder))


@query("AGG10_rows_per_provenance", with_sql(_VECTORS_SQL, select="SELECT model_id, embed_dim, layer_version, count(*) AS n FROM vecs GROUP BY ALL"))
def rows_per_provenance(spark, folder):
    return _vectors(spark, folder).groupBy("model_id", "embed_dim", "layer_version").agg(F.count("*").alias("n"))


@query("WIN1_hit_rank", with_sql("ranked AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INTEGER AS rank FROM lineitem)", select="SELECT * FROM ranked WHERE rank <= 3"))
def hit_rank(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    return topk.rank(lines, 3, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


@query("SRT2_nearest_rows", "SELECT vec_id FROM (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(embedding, lambda x: 1.0::DOUBLE)), 9) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 50")
def nearest_rows(spark, folder):
    ones = F.transform("embedding", lambda x: F.lit(1.0))
    scored = table(spark, folder, "embeddings").withColumn("s", F.round(vectors.dot(F.col("embedding"), ones), 9))
    return scored.orderBy(F.col("s").desc(), "vec_id").limit(50).select("vec_id")


# --- prompts and answers --------------------------------------------------------------------------


def _contents(spark, folder):
    """Vector rows with the document of the same number as their content."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return _vectors(spark, folder).drop("embedding").join(docs, "vec_id")


_CONTENTS_SQL = "filled AS (SELECT v.*, d.text AS content FROM vecs v JOIN documents d ON d.doc_id = v.vec_id)"
_HITS_SQL = (
    "hits AS (SELECT r.query_id, list(struct_pack(rank := r.rank, chunk_id := f.chunk_id, layer_version := f.layer_version, "
    "geological_age := f.geological_age, content := f.content) ORDER BY r.rank) AS hits FROM ranked r JOIN filled f ON f.chunk_id = r.chunk_id GROUP BY r.query_id)"
)


def _asked(spark, folder):
    """Label queries with their text and instruction: none, plain, or with a quote in it."""
    label = F.col("label")
    instruction = F.when(label % 3 == 1, "Keep it short").when(label % 3 == 2, "Don't ramble")
    return _centres(spark, folder).select(
        "query_id", "scope", "query_embedding", F.concat(F.lit("what about label "), label.cast("string")).alias("query"), instruction.alias("instruction"))


_ASKED_SQL = (
    "asked AS (SELECT query_id, scope, query_embedding, 'what about label ' || label AS query, CASE label % 3 WHEN 1 THEN 'Keep it short' WHEN 2 THEN 'Don''t ramble' END AS instruction FROM centres)"
)


def _with_hits(spark, folder, asked, scoped=False):
    scope = {"scope": "source_id", "query_scope": "scope"} if scoped else {}
    ranked = topk.top_k(_vectors(spark, folder), asked, K, **scope)
    lists = topk.hit_lists(topk.hits(ranked, _contents(spark, folder)))
    none = F.array().cast(lists.schema["hits"].dataType)
    return asked.join(lists, "query_id", "left").withColumn("hits", F.coalesce("hits", none))


_RAG_SQL = [_VECTORS_SQL, _CENTRES_SQL, _ASKED_SQL, _ranked_sql(), _CONTENTS_SQL, _HITS_SQL]
_CONTEXT = "array_to_string(list_transform(hits, lambda h: '- [' || h.geological_age || '] ' || h.content), chr(10))"
_LEAD = I.sql_strip(f"split_part({I.sql_strip('h.content')}, '. ', 1)")
_SUMMARY = (
    "'Based on ' || len(hits) || ' retrieved fossil fragment(s)' || CASE WHEN instruction IS NULL THEN '' WHEN contains(instruction, '''') THEN ' (instruction: \"' || instruction || '\")' "
    "ELSE ' (instruction: ''' || instruction || ''')' END || ':' || chr(10) || array_to_string(list_transform(list_transform(hits, lambda h: " + _LEAD + "), "
    "lambda t: '- ' || CASE WHEN length(t) > 200 THEN rtrim(t[1:200], ' ' || chr(10)) || '…' ELSE t END), chr(10))"
)


@query("RAG1_grounded_prompts", with_sql(*_RAG_SQL, select=f"SELECT query_id, 'Fossil context:' || chr(10) || {_CONTEXT} || chr(10) || chr(10) || 'Task: ' || coalesce(instruction, 'Summarise the relevant fossils for the query.') || chr(10) || 'Query: ' || query AS prompt FROM asked JOIN hits USING (query_id)"))
def grounded_prompts(spark, folder):
    asked = _with_hits(spark, folder, _asked(spark, folder))
    return asked.select("query_id", prompts.grounded_prompt(F.col("query"), F.col("instruction"), F.col("hits")).alias("prompt"))


@query("RAG2_chat_system_prompts", with_sql(*_RAG_SQL, select=f"SELECT query_id, 'S' || chr(10) || chr(10) || 'Fossil context for this conversation:' || chr(10) || {_CONTEXT} AS system FROM hits"))
def chat_prompts(spark, folder):
    asked = _with_hits(spark, folder, _asked(spark, folder))
    return asked.select("query_id", prompts.chat_system(F.col("hits"), "S").alias("system"))


@query("RAG3_edit_prompts", "SELECT doc_id, 'Instruction: Shorten for ' || lang || chr(10) || chr(10) || 'Slide text to revise:' || chr(10) || text AS prompt FROM documents")
def edit_prompts(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", prompts.edit_prompt(F.col("text"), F.concat(F.lit("Shorten for "), F.col("lang"))).alias("prompt"))


def last_user_turns(turns):
    """The last user turn per conversation; conversations without one give no row."""
    said = turns.filter("role = 'user'").groupBy("conv_id")
    return said.agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("query"))


@query("RAG4_last_user_turns", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_turns(spark, folder):
    return last_user_turns(table(spark, folder, "conversations"))


@query("RAG5_extractive_summaries", with_sql(*_RAG_SQL, select=f"SELECT query_id, {_SUMMARY} AS summary FROM asked JOIN hits USING (query_id)"))
def summaries(spark, folder):
    asked = _with_hits(spark, folder, _asked(spark, folder))
    return asked.select("query_id", prompts.extractive_summary(F.col("instruction"), F.col("hits")).alias("summary"))


@query("RAG6_extractive_edits", f"SELECT doc_id, {I.sql_half('text')} AS edited FROM documents")
def edits(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.keep_first_half(F.col("text")).alias("edited"))


_KEY = (
    "sha256('{\"hits\": [' || array_to_string(list_transform(hits, lambda h: '[\"' || h.chunk_id || '\", ' || h.layer_version || ', \"' || h.geological_age || '\"]'), ', ') "
    "|| '], \"instruction\": ' || to_json(coalesce(instruction, ''))::VARCHAR || ', \"model\": \"mock-llm-v1\", \"query\": ' || to_json(query)::VARCHAR || '}')"
)


@query("RAG7_retrieve_and_summarise", with_sql(*_RAG_SQL, select=f"""
SELECT query_id, {_KEY} AS key, CASE WHEN query_id < 'q5' THEN 'cached ' || query_id ELSE {_SUMMARY} END AS value, query_id < 'q5' AS cached, true AS cached_next_time FROM asked JOIN hits USING (query_id)"""))
def retrieve_and_summarise(spark, folder):
    """Search for all queries at once, answer from the cache where it can, summarise the rest."""
    asked = _with_hits(spark, folder, _asked(spark, folder))
    keyed = asked.withColumn("key", ids.prompt_key(F.lit("mock-llm-v1"), F.col("query"), F.col("instruction"), F.col("hits"))).drop("query_embedding")
    kept = keyed.filter("query_id < 'q5'").select("key", F.concat(F.lit("cached "), "query_id").alias("value"))
    summarise = lambda missing: missing.withColumn("value", prompts.extractive_summary(F.col("instruction"), F.col("hits")))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    store = cache.cache_table(spark, scratch_path(spark, "answers"), buckets=8)
    store.upsert(kept.withColumns({"put_at": now, "last_used": now}))
    answered = cache.serve(store, keyed, summarise, now)
    again = cache.serve(store, keyed, summarise, now).select("query_id", F.col("cached").alias("cached_next_time"))
    return answered.join(again, "query_id").select("query_id", "key", "value", "cached", "cached_next_time")


_CHAT_SQL = [
    _VECTORS_SQL,
    "asked AS (SELECT 'c' || conv_id AS query_id, 'label-' || label AS scope, embedding AS query_embedding, arg_max(text, turn) AS query, NULL::VARCHAR AS instruction "
    "FROM conversations JOIN vecs ON vec_id = conv_id WHERE role = 'user' GROUP BY ALL)",
    _ranked_sql("asked", "v.source_id = q.scope"), _CONTENTS_SQL, _HITS_SQL,
]


@query("RAG8_chat_answers", with_sql(*_CHAT_SQL, select=f"SELECT query_id, query, {_SUMMARY} AS answer, array_to_string(list_transform(hits, lambda h: h.chunk_id), ',') AS citations FROM asked JOIN hits USING (query_id)"))
def chat_answers(spark, folder):
    """Answer each conversation's last user turn from its own source, with citations."""
    turns = last_user_turns(table(spark, folder, "conversations"))
    rows = _vectors(spark, folder).select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("query_embedding"), F.col("source_id").alias("scope"))
    asked = turns.join(rows, "conv_id").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("query_id"), "scope", "query_embedding", "query", F.lit(None).cast("string").alias("instruction"))
    found = _with_hits(spark, folder, asked, scoped=True)
    return found.select(
        "query_id", "query", prompts.extractive_summary(F.col("instruction"), F.col("hits")).alias("answer"),
        F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ",").alias("citations"))


@query("RAG9_generation_summary", """SELECT count(*) AS rows, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 2 = 0) AS cache_hits,
 count(*) FILTER (doc_id % 3 = 0) AS fallback_count, count(*) FILTER (doc_id % 9 = 0) AS errors FROM documents""")
def generation(spark, folder):
    """A model that fails on every third row, and a fallback that fails on every ninth."""

    def primary(row):
        if row["doc_id"] % 3 == 0:
            raise TimeoutError("slow")
        return {"text": " ".join(row["text"].split()), "cache_hit": row["doc_id"] % 2 == 0}

    def fallback(row):
        if row["doc_id"] % 9 == 0:
            raise RuntimeError("down")
        return row["text"].upper()

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return generate.generation_summary(generate.generate(docs, primary, fallback))
