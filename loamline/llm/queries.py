"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import adaptive_quality, anchor_simhash, ball_tree, bit_planes, byte_bpe, chaining, es_mixing, filter_audit, gru_lm, kn_langid, pu_toxicity, spelling_variants, url_lists
from loamline.llm.storage import shared_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multilingual_tokenizer() -> tuple[str, str]:
    """Rank file and pre-token pattern of the public multilingual tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    path, pattern = multilingual_tokenizer()
    out = byte_bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, with_decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has as well."""
    return chaining.passages(_table(spark, sf_dir, "documents"))


#: Dated entries of two lists for the query on ``pages``: list, kind, value, action, date.
LIST_ENTRIES = [
    ("adult", "domain", "casino-win.example.com", "add", "2024-01-15"),
    ("adult", "domain", "casino-win.example.com", "remove", "2024-06-01"),
    ("adult", "domain", "casino-win.example.com", "add", "2024-09-10"),
    ("adult", "domain", "casino-win.example.org", "add", "2023-11-01"),
    ("adult", "domain", "casino-win.example.net", "add", "2024-03-01"),
    ("adult", "domain", "casino-win.example.net", "remove", "2024-03-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "domain", "cheap-pills.example.org", "add", "2024-01-01"),
    ("spam", "domain", "cheap-pills.example.org", "add", "2024-05-01"),
    ("spam", "domain", "cheap-pills.example.net", "add", "2024-04-01"),
    ("spam", "domain", "blog.cheap-pills.example.net", "remove", "2024-04-15"),
    ("spam", "domain", "example.net", "add", "2024-12-01"),
    ("spam", "prefix", "thther.example.org/en/", "add", "2024-03-01"),
    ("spam", "prefix", "thther.example.org/en/", "remove", "2024-10-01"),
    ("spam", "url", "https://thther.example.org/en/685", "add", "2024-01-01"),
]


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by LIST_ENTRIES as of its fetch date.

    ``pages`` has no fetch date; day ``page_id`` mod 366 of 2024 stands in.
    """
    entries = spark.createDataFrame(LIST_ENTRIES, "list string, kind string, value string, action string, dated string").withColumn("dated", F.to_date("dated"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_on"))
    out = url_lists.judge(captures, entries)
    return out.select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), F.col("n_active").cast("long").alias("n_active"), "blocked", "matched", "list")


OP3_SQL = f"""
WITH entries(list, kind, value, action, dated) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in LIST_ENTRIES)}),
intervals AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, kind, value ORDER BY dated, action) AS until FROM entries),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '.')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT c.*, i.list, i.kind || ' ' || i.value AS matched,
         count(i.kind) OVER (PARTITION BY c.page_id, c.url) AS n_active,
         row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY CASE i.kind WHEN 'url' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END, length(i.value) DESC, i.list) AS nth
  FROM captures c LEFT JOIN intervals i
    ON i.action = 'add' AND c.fetched_on >= i.dated AND (i.until IS NULL OR c.fetched_on < i.until)
   AND CASE i.kind WHEN 'url' THEN regexp_replace(c.url, '#.*$', '') = i.value
                   WHEN 'prefix' THEN starts_with(c.host || c.path, i.value) AND (right(i.value, 1) = '/' OR c.host || c.path = i.value)
                   ELSE c.host = i.value OR ends_with(c.host, '.' || i.value) END)
SELECT page_id, host, CAST(fetched_on AS VARCHAR) AS fetched_on, n_active, n_active > 0 AS blocked, matched, list FROM hits WHERE nth = 1
"""


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    return pu_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every whole document, learned outside the held-out tenth."""
    return gru_lm.score(_table(spark, sf_dir, "documents"))


def op6_kn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    return kn_langid.identify(_table(spark, sf_dir, "documents"))


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, thresholds per language and source."""
    out = adaptive_quality.with_verdicts(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows by inner product for every fiftieth vector, against all."""
    out = ball_tree.top_k(_table(spark, sf_dir, "embeddings"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP8_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_es_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 3, 1, 2."""
    return es_mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
         / coalesce(greatest(0.05, 1 - CAST(4 * (length(text) - length(translate(text, '#*$%&|<>', ''))) AS DOUBLE) / greatest(length(text), 1)), 1.0) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM totals),
aims AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max((budget - capped) / free) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def op10_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word SimHash classes of all documents, links at two bits or fewer."""
    out = anchor_simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order of them, by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT part, doc_id,
         CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
         + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask
  FROM texts),
labelled AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN labelled USING (doc_id) GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, sum(bit) FILTER (position(letter IN filter_order) = step) AS own, coalesce(sum(bit) FILTER (position(letter IN filter_order) < step), 0) AS earlier
  FROM orders, range(1, 6) r(step), letters GROUP BY filter_order, step),
effects AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (own + earlier) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT part, CAST(mask AS BIGINT) AS mask, n, good, toxic FROM counts), (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(earlier AS BIGINT) AS earlier FROM steps)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM effects
"""

def english_tokenizer() -> str:
    """Text of the public byte-level tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written as compressed planes and read back."""
    path = f"{shared_root(spark)}/loamline/planes-{uuid.uuid4().hex}"
    return bit_planes.round_trip(_table(spark, sf_dir, "documents"), path, english_tokenizer())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_variants.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chaining": op2_chaining,
    "op3_url_lists": op3_url_lists,
    "op4_pu_toxicity": op4_pu_toxicity,
    "op5_gru_lm": op5_gru_lm,
    "op6_kn_langid": op6_kn_langid,
    "op7_adaptive_quality": op7_adaptive_quality,
    "op8_ball_tree": op8_ball_tree,
    "op9_es_mixing": op9_es_mixing,
    "op10_anchor_simhash": op10_anchor_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_bit_planes": op12_bit_planes,
    "op13_spelling_variants": op13_spelling_variants,
}

#: SQL can't express the others: tokenisers, trained models, sketches, XXH64 and CRC-32.
ORACLES: dict[str, str] = {"op3_url_lists": OP3_SQL, "op8_ball_tree": OP8_SQL, "op9_es_mixing": OP9_SQL, "op11_filter_audit": OP11_SQL}
