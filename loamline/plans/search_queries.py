"""Vector search and answers over ``embeddings`` and stand-ins for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import urls
from loamline.operators import search
from loamline.plans.registry import query, table
from loamline.providers import HashEmbedder

_SCORED = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS distance FROM embeddings, q)"""


def _first(vectors):
    return vectors.orderBy("vec_id").limit(1)


@query(f"WITH {_SCORED} SELECT vec_id, label, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    """The ten vectors nearest to the first."""
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _first(v), 10, "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS n FROM s)
SELECT query_id, vec_id, CAST(n AS INTEGER) AS rank, round(d, 6) AS distance FROM r WHERE n <= 5""")
def vector_topk_batch(spark, sf_dir):
    """The five vectors nearest to every hundredth."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.top_k_batch(v, asked, 5, "vec_id").select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_SCORED} SELECT vec_id, round(distance, 6) AS distance FROM scored WHERE distance <= 0.8 ORDER BY scored.distance, vec_id LIMIT 20")
def vector_threshold(spark, sf_dir):
    """Vectors within 0.8 of the first, the 20 of a search at most (nothing but itself is within 0.45 here)."""
    v = table(spark, sf_dir, "embeddings")
    return search.top_k(v, _first(v), search.clamp(100), "vec_id", 0.8).select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def hash_index(spark, sf_dir):
    """An index of all documents by hashed words and the document nearest to the first benchmark item."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.lit("d").alias("digest"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit("").alias("symbol"), F.col("text").alias("content"))
    vectors = search.build_index(chunks, HashEmbedder())
    first = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
    asked = search.build_index(first.select(F.lit("q").alias("digest"), F.col("item_id").cast("string").alias("chunk_id"), F.lit("question").alias("path"), F.lit("").alias("symbol"), F.col("text").alias("content")), HashEmbedder())
    return search.top_k(vectors.where("embedding is not null"), asked, 8).select("chunk_id", F.round("distance", 6).alias("distance"))


@query("""
WITH m AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src3')
SELECT doc_id, CASE WHEN lang <> 'en' AND n_chars <> 1000 THEN 'provider_identity,chunk_version' WHEN lang <> 'en' THEN 'provider_identity' WHEN n_chars <> 1000 THEN 'chunk_version' ELSE '' END AS differs
FROM m ORDER BY CASE WHEN lang <> 'en' THEN 1 ELSE 0 END + CASE WHEN n_chars <> 1000 THEN 1 ELSE 0 END, doc_id LIMIT 1""")
def nearest_key(spark, sf_dir):
    """The index key of a repository (source) nearest to a wanted one."""
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("digest"), F.col("source").alias("repo"), F.lit("c").alias("commit_sha"), F.col("lang").alias("provider_identity"), F.col("n_chars").cast("string").alias("chunk_version"), F.lit("").alias("index_scope"))
    wanted = dict(zip(urls.KEY_PARTS, ["src3", "c", "en", "1000", ""]))
    return search.nearest_key(manifest, wanted).select(F.col("digest").alias("doc_id"), F.array_join("differs", ",").alias("differs"))


@query("""
WITH s AS (SELECT conv_id, turn, role, text, (conv_id % 7) / 10.0 AS best FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(text, ' ') = '' THEN 'empty_question' WHEN role = 'system' THEN 'index_missing' WHEN turn = 9 THEN 'embedding_failed' WHEN best > 0.45 THEN 'below_threshold'
  WHEN length(text) > 800 THEN 'llm_failed' WHEN turn = 2 THEN 'empty_answer' ELSE 'ok' END AS note FROM s""")
def answer_note(spark, sf_dir):
    """Outcome of questions (turns of conversations) by the first stage that stops them."""
    own = table(spark, sf_dir, "conversations")
    best = (F.col("conv_id") % 7) / 10
    return own.select("conv_id", "turn", search.note(F.col("text"), F.col("role") != "system", F.col("turn") != 9, best, F.when(F.col("turn") == 2, " ").otherwise("x"), F.length("text") > 800).alias("note"))


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 404 WHEN event_type = 'signup' THEN 409 WHEN value < 1 THEN 400 WHEN event_type = 'click' THEN 409 WHEN user_id < 20 THEN 502 ELSE 200 END AS INTEGER) AS status FROM events""")
def search_status(spark, sf_dir):
    """Status of searches, tests in their order."""
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", search.search_status(e != "error", e != "signup", F.when(F.col("value") < 1, " ").otherwise("q"), e != "click", F.col("user_id") >= 20).alias("status"))


@query(r"""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents),
six AS (SELECT source, n, 'doc/' || doc_id || ':1-9' AS c FROM d WHERE n <= 6)
SELECT source AS question_id, 'See [' || max(c) FILTER (n = 2) || '] and [9], then [' || max(c) FILTER (n = 1) || '].' AS text, max(c) FILTER (n = 1) || ',' || max(c) FILTER (n = 2) AS citations FROM six GROUP BY source""")
def cited_answers(spark, sf_dir):
    """Answers with snippet numbers turned into citations; unknown numbers stay."""
    from loamline.operators.ranking import top_per

    six = top_per(table(spark, sf_dir, "documents"), 6, ["source"], "n_chars", "doc_id", name="n")
    numbered = six.select(F.col("source").alias("question_id"), "n", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(":1-9")).alias("citation"))
    answers = numbered.select("question_id").distinct().withColumn("answer", F.lit("See [2] and [9], then [1]."))
    return search.cited(answers, numbered).select("question_id", "text", F.array_join("citations", ",").alias("citations"))
