"""Ranking, budgets and runs over stand-in relations, named in each docstring."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import ranking
from loamline.plans.registry import query, table

PART_SCORE = """
bounds AS (SELECT min(p_retailprice) AS a, max(p_retailprice) - min(p_retailprice) AS b, CAST(min(p_size) AS DOUBLE) AS c, CAST(max(p_size) - min(p_size) AS DOUBLE) AS d FROM part),
ranked AS (SELECT p_partkey AS path, round(0.6::DOUBLE * ((p_retailprice - a) / b) + 0.4::DOUBLE * ((p_size - c) / d), 9) AS score FROM part, bounds)"""


def _parts(spark, sf_dir):
    """Parts as files: price as centrality, size as churn."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("centrality"), F.col("p_size").alias("churn"))
    return ranking.file_rank(own).select("path", F.round("score", 9).alias("score"))


@query(f"WITH {PART_SCORE} SELECT path, score FROM ranked")
def file_rank(spark, sf_dir):
    """Blend of normalised centrality and churn of parts."""
    return _parts(spark, sf_dir)


@query(f"WITH {PART_SCORE} SELECT path, score FROM ranked ORDER BY score DESC, path LIMIT 10")
def top_targets(spark, sf_dir):
    """The ten files to review."""
    return ranking.top(_parts(spark, sf_dir), 10, F.desc("score"), "path")


@query("""
SELECT p_partkey AS path, round(CASE WHEN b > 0 THEN (p_retailprice - a) / b ELSE 0 END, 9) AS norm_price, 0.0::DOUBLE AS norm_flat
FROM part JOIN (SELECT p_brand AS g, min(p_retailprice) AS a, max(p_retailprice) - min(p_retailprice) AS b FROM part GROUP BY 1) ON g = p_brand""")
def min_max_rank(spark, sf_dir):
    """Normalised prices within a brand; a column without a span is all 0."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_brand", F.col("p_retailprice").alias("price"), F.lit(7).alias("flat"))
    return ranking.min_max(own, ["price", "flat"], ["p_brand"]).select("path", F.round("norm_price", 9).alias("norm_price"), "norm_flat")


MODULE_SCORE = """
sums AS (SELECT c_nationkey AS name, sum(CAST(round(c_acctbal * 100) AS BIGINT)) / 100.0::DOUBLE AS centrality, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1),
b AS (SELECT min(centrality) AS a, max(centrality) - min(centrality) AS s, min(n) AS c, max(n) - min(n) AS d FROM sums),
ranked AS (SELECT name, round(0.65::DOUBLE * (CASE WHEN s > 0 THEN (centrality - a) / s ELSE 0 END) + 0.35::DOUBLE * (CASE WHEN d > 0 THEN (n - c) / d ELSE 0 END), 9) AS score FROM sums, b)"""


def _modules(spark, sf_dir):
    """Nations as modules: balances in whole cents as summed centrality, customers as files."""
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("name")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / 100).alias("centrality"), F.count(F.lit(1)).alias("n_files"))
    return ranking.module_rank(own).select("name", F.round("score", 9).alias("score"))


@query(f"WITH {MODULE_SCORE} SELECT name, score FROM ranked")
def module_rank(spark, sf_dir):
    """Scores of modules from summed centrality and size."""
    return _modules(spark, sf_dir)


@query(f"""WITH {MODULE_SCORE}, best AS (SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS priority FROM ranked)
SELECT name, score, CAST(priority AS INTEGER) AS priority, CASE WHEN priority <= 3 THEN 'deep' ELSE 'shallow' END AS depth FROM best WHERE priority <= 12""")
def rule_plan(spark, sf_dir):
    """The twelve modules to analyse, three of them deeply."""
    return ranking.rule_plan(_modules(spark, sf_dir), 12)


@query(f"""WITH {MODULE_SCORE}, best AS (SELECT name, score FROM ranked ORDER BY score DESC, name LIMIT 12),
kept AS (SELECT best.name, score, row_number() OVER (ORDER BY score DESC, best.name) AS priority FROM best JOIN nation ON n_nationkey = best.name WHERE n_regionkey <> 1)
SELECT name, score, CAST(priority AS INTEGER) AS priority, CASE WHEN priority <= 3 THEN 'deep' ELSE 'shallow' END AS depth FROM kept WHERE priority <= 6""")
def semantic_plan(spark, sf_dir):
    """Six modules of the first twelve after decisions (here: a region is rejected); none is filled in."""
    decisions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), (F.col("n_regionkey") != 1).alias("keep"))
    return ranking.semantic_plan(_modules(spark, sf_dir), decisions, 6)


@query("""
WITH scores AS (SELECT s_suppkey AS path, s_acctbal AS score FROM supplier)
SELECT path, seq, score FROM (SELECT c_custkey AS path, -c_custkey AS seq, coalesce(score, 0.0) AS score FROM customer LEFT JOIN scores ON path = c_custkey ORDER BY score DESC, path LIMIT 50) ORDER BY seq""")
def index_sample(spark, sf_dir):
    """The 50 files of most centrality in their original order (customers by the balance of the supplier of the same key)."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (-F.col("c_custkey")).alias("seq"))
    return ranking.index_sample(files, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_acctbal").alias("score")), 50)


@query("""
WITH w AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
SELECT doc_id, source, CAST(rn AS INTEGER) AS rn, CAST(used AS BIGINT) AS used FROM w WHERE rn <= 6 AND (rn = 1 OR used <= 2000)""")
def snippet_budget(spark, sf_dir):
    """Per source the shortest documents within a budget of 2000 characters, six at most."""
    return ranking.prefix_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["n_chars", "doc_id"], "n_chars", 2000, 6).select("doc_id", "source", "rn", "used")


COPIES = "copies AS (SELECT s_suppkey AS repo, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS size, s_acctbal AS last_used, s_nationkey = 3 AS running FROM supplier)"


@query(f"""WITH {COPIES}, t AS (SELECT sum(size) AS total, sum(size) FILTER (NOT running) AS free FROM copies),
w AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_used, repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM copies WHERE NOT running)
SELECT repo, size, last_used, CAST(total - gone AS BIGINT) AS used_before FROM w, t WHERE total - gone > 30000000 AND free >= 3000000""")
def lru_quota(spark, sf_dir):
    """Copies to delete for a quota (suppliers; balance as size and as time of last use)."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"), F.round(F.abs("s_acctbal") * 100).cast("long").alias("size"), F.col("s_acctbal").alias("last_used"), (F.col("s_nationkey") == 3).alias("running"))
    return ranking.lru_evictions(own, 30_000_000)


@query("SELECT o_custkey AS path, o_orderpriority AS strength, o_orderkey AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_evidence(spark, sf_dir):
    """Each customer's strongest order: most urgent, then first."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("strength"), F.col("o_orderkey").alias("evidence"))
    return ranking.best_evidence(own, "path", "strength", "evidence")


@query("""
SELECT p_partkey, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN ':' || p_partkey ELSE '' END AS unique_name FROM part""")
def unique_names(spark, sf_dir):
    """Part names, with the key where a name repeats."""
    return ranking.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", F.col("p_partkey").cast("string")).select("p_partkey", "unique_name")


@query("""
WITH m AS (SELECT o_custkey AS task, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey AS task, CASE WHEN m.task IS NULL THEN 'disk' ELSE 'memory' END AS origin, coalesce(m.value, c_acctbal) AS value FROM customer LEFT JOIN m ON m.task = c_custkey""")
def merge_history(spark, sf_dir):
    """Entries in memory before those on disk (pending orders before customers)."""
    disk = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.lit("disk").alias("origin"), F.col("c_acctbal").alias("value"))
    memory = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("task")).agg(F.max("o_totalprice").alias("value")).select("task", F.lit("memory").alias("origin"), "value")
    return ranking.merge_history(disk, memory, "task")


@query("""
WITH d AS (SELECT DISTINCT user_id, CAST(extract(day FROM ts) AS INTEGER) AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d)
SELECT user_id, min(day) AS "start", max(day) AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def gaps_islands(spark, sf_dir):
    """Runs of consecutive days on which a user has events."""
    return ranking.islands(table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day")), ["user_id"], "day")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events) WHERE n = 1")
def ordered_dedupe(spark, sf_dir):
    """The first event of each kind of every user."""
    own = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type"))
    return ranking.ordered_distinct(own, "key", "ts").select("user_id", "event_type", "value")


@query("""
WITH r AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) AS b FROM events)
SELECT event_id FROM r x WHERE EXISTS (SELECT 1 FROM r y WHERE y.user_id = x.user_id AND y.event_type = x.event_type AND y.event_id < x.event_id
  AND (least(x.b, y.b) - greatest(x.a, y.a) + 1) / (x.b - x.a + 1) >= 0.6)""")
def read_overlap(spark, sf_dir):
    """Reads that an earlier one covers by 60 % (events of a user and kind as reads of a path)."""
    k = F.get_json_object("props", "$.k").cast("long")
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type", F.floor("value").alias("start"), (F.floor("value") + k).alias("end"))
    return ranking.overlapped_reads(own, ["user_id", "event_type"]).select(F.col("seq").alias("event_id"))
