"""Report checks and review outcomes over stand-ins: orders as claims, lines as citations, suppliers as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import report, review
from loamline.plans.registry import query, table
from loamline.providers import RuleJudge


def _citations(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    start = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") - 2).otherwise(F.col("l_linenumber"))
    return own.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("path"), start.alias("line"), (F.col("l_quantity") - 2).cast("int").alias("end_line"))


def _checked(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").where("s_nationkey <> 5").select(F.col("s_suppkey").alias("path"), F.floor(F.abs("s_acctbal") / 50).cast("int").alias("n_lines"))
    return report.check_citations(_citations(spark, sf_dir), files)


def _judged(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    return report.judge_claims(claims, _checked(spark, sf_dir))


CHECKED = """
cites AS (SELECT l_orderkey AS claim_id, l_suppkey AS path, CASE WHEN l_returnflag = 'R' THEN l_linenumber - 2 ELSE l_linenumber END AS line, CAST(l_quantity - 2 AS INTEGER) AS end_line FROM lineitem),
files AS (SELECT s_suppkey AS path, CAST(floor(abs(s_acctbal) / 50) AS INTEGER) AS n_lines FROM supplier WHERE s_nationkey <> 5),
checked AS (SELECT c.*, CASE WHEN f.path IS NULL THEN 'unknown_path' WHEN line < 1 THEN 'bad_line' WHEN end_line < line THEN 'inverted' WHEN end_line > n_lines THEN 'beyond_end' END AS problem FROM cites c LEFT JOIN files f ON f.path = c.path),
counts AS (SELECT claim_id, count(*) AS n, count(*) FILTER (problem IS NULL) AS v FROM checked GROUP BY claim_id),
judged AS (SELECT o_orderkey AS claim_id, coalesce(n, 0) AS n_citations, coalesce(v, 0) AS n_valid,
  CASE WHEN coalesce(n, 0) = 0 THEN 'no_citation' WHEN v = n THEN 'valid' ELSE 'invalid_citation' END AS verdict, coalesce(n, 0) > 0 AND v < n AND v > 0 AS salvageable FROM orders LEFT JOIN counts ON claim_id = o_orderkey)"""


@query(f"WITH {CHECKED} SELECT coalesce(problem, 'ok') AS problem, count(*) AS n FROM checked GROUP BY 1")
def citation_check(spark, sf_dir):
    """Problems of all citations."""
    return _checked(spark, sf_dir).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHECKED} SELECT * FROM judged")
def claim_verdicts(spark, sf_dir):
    """Verdict of every claim."""
    return _judged(spark, sf_dir)


@query(f"WITH {CHECKED} SELECT c.claim_id, c.path, c.line, c.end_line, j.verdict FROM checked c JOIN judged j ON j.claim_id = c.claim_id WHERE c.problem IS NULL AND (j.verdict = 'valid' OR j.salvageable)")
def claim_salvage(spark, sf_dir):
    """Citations that stay with their claims."""
    return report.salvage(_judged(spark, sf_dir), _checked(spark, sf_dir)).select("claim_id", "path", "line", "end_line", "verdict")


@query(f"WITH {CHECKED} SELECT count(*) FILTER (verdict = 'valid') AS valid, count(*) FILTER (verdict = 'no_citation') AS no_citation, count(*) FILTER (verdict = 'invalid_citation') AS invalid_citation, count(*) FILTER (salvageable) AS salvaged FROM judged")
def validation_summary(spark, sf_dir):
    """Numbers of verdicts."""
    return report.summary(_judged(spark, sf_dir))


@query("""
SELECT c_custkey AS name, CASE WHEN f THEN 'failed' ELSE 'no result' END AS reason FROM customer LEFT JOIN (SELECT o_custkey AS k, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus = 'O') AS f FROM orders GROUP BY 1) s ON k = c_custkey WHERE k IS NULL OR f OR (NOT o AND NOT f)""")
def missing_parts(spark, sf_dir):
    """Planned modules (customers) without an analysis (an open order): failed (finished orders alone) or silent."""
    orders = table(spark, sf_dir, "orders")
    analysed = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("name")).distinct()
    failed = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("name")).distinct().join(analysed, "name", "left_anti").withColumn("reason", F.lit("failed"))
    return report.missing_modules(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), analysed, failed)


def _candidates(spark, sf_dir):
    """Labelled or not, every document is a candidate: toxic ones are certain."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("category"), "doc_id", F.when(F.col("toxic") == 1, "certain").when(F.col("toxic") == 0, "contextual").otherwise("unknown").alias("confidence"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("evidence"))


@query("SELECT documents.doc_id, CASE WHEN toxic = 1 THEN 'report' ELSE 'suppress' END AS verdict FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def judged_candidates(spark, sf_dir):
    """Verdicts of the rule judge, eight candidates at a time."""
    return review.judge_candidates(_candidates(spark, sf_dir), RuleJudge()).select("doc_id", "verdict")


@query("""
WITH v AS (SELECT source AS category, CASE WHEN toxic = 1 THEN 'report' WHEN toxic = 0 THEN 'suppress' ELSE 'unjudged' END AS verdict FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
c AS (SELECT category, count(*) AS n, count(*) FILTER (verdict = 'report') AS hits, count(*) FILTER (verdict = 'unjudged') AS unjudged FROM v GROUP BY 1)
SELECT category, n, hits, unjudged, CASE WHEN n > 0 AND unjudged = n THEN 'failed' ELSE 'executed' END AS status,
  CASE WHEN n > 0 AND unjudged = n THEN 'not executed: failed' WHEN hits > 0 THEN hits || ' found' ELSE 'executed, nothing found' END AS description FROM c""")
def candidate_alignment(spark, sf_dir):
    """Outcomes by category where verdicts (labels) are aligned by a left join and missing ones stay unjudged."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "report").when(F.col("toxic") == 0, "suppress").otherwise("unjudged")
    judged = docs.join(labels, "doc_id", "left").select(F.col("source").alias("category"), verdict.alias("verdict"))
    return review.outcomes(judged, docs.select(F.col("source").alias("category")))


@query("""
SELECT CASE WHEN s IN ('high', 'medium', 'low') THEN s ELSE 'other' END AS severity, count(*) AS n FROM (SELECT lower(split_part(o_orderpriority, '-', 2)) AS s FROM orders) GROUP BY 1""")
def severity_tally(spark, sf_dir):
    """Tally of severities (order priorities)."""
    return review.severity_tally(table(spark, sf_dir, "orders").select(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("severity")))


@query("""
SELECT event_type AS repo_id, event_id AS line, CAST(floor(n / 8) AS INTEGER) AS batch, CAST(n % 8 AS INTEGER) AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1 AS n FROM events)""")
def judge_batches(spark, sf_dir):
    """Candidates (events) numbered within batches of eight."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id"), F.col("user_id").alias("path"), F.col("event_id").alias("line"), F.lit("k").alias("kind"))
    return review.batch_ids(own).select("repo_id", "line", "batch", "id")


@query(f"""
WITH {CHECKED}, why AS (SELECT claim_id, array_to_string(list_sort(list_distinct(list(problem)))[:3], ',') AS problems FROM checked WHERE problem IS NOT NULL GROUP BY claim_id)
SELECT j.claim_id, 'claim ' || j.claim_id AS text, coalesce(problems, 'no citation') AS problems FROM judged j LEFT JOIN why ON why.claim_id = j.claim_id WHERE j.verdict <> 'valid' AND NOT j.salvageable""")
def rejected_claims(spark, sf_dir):
    """Dropped claims with their problems."""
    judged = _judged(spark, sf_dir).withColumn("text", F.concat(F.lit("claim "), F.col("claim_id").cast("string")))
    return report.rejected_notes(judged, _checked(spark, sf_dir)).select("claim_id", "text", F.array_join("problems", ",").alias("problems"))


#: A written report for every event: a short one and then the whole, one with odd parts, no object, and two of equal length.
WRITTEN_REPORTS = """written AS (
  SELECT event_id AS report_id, CASE event_id % 4
    WHEN 0 THEN 'Short: {"summary": " s ", "dependencies": []} and whole: {"summary": " full ", "module_breakdown": [{"text": " m' || CAST(event_id AS STRING) || ' ", "citations": ["a.py", {"path": "b.py", "line": 3, "end_line": 9}, {"line": 1}, 7]}, {"text": 5}, "odd", {"text": "n", "citations": "x"}], "key_flows": [{"text": "f"}]}'
    WHEN 1 THEN '```json' || chr(10) || '{"summary": 4, "tech_stack": "none", "entrypoints": [{"text": "  "}]}' || chr(10) || '```'
    WHEN 2 THEN '[1] is no object, ' || event_type
    ELSE '{"dependencies": [{"text": "d", "citations": [{"path": "c.py", "line": "5"}]}]} {"dependencies": [{"text": "later"}]}' END AS reply FROM events)"""


@query("""
WITH e AS (SELECT event_id AS report_id, event_id % 4 AS i FROM events),
claims(i, section, nth, text, cited) AS (VALUES (0, 'module_breakdown', 0, NULL, 'a.py;b.py:3-9'), (0, 'module_breakdown', 3, 'n', ''), (0, 'key_flows', 0, 'f', ''), (3, 'dependencies', 0, 'd', 'c.py'))
SELECT report_id, CASE i WHEN 0 THEN 'full' ELSE '' END AS summary, CASE i WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 1 END AS n_claims, section, nth, CASE WHEN section IS NOT NULL THEN coalesce(text, 'm' || report_id) END AS text, cited
FROM e LEFT JOIN claims USING (i) WHERE i <> 2""")
def written_reports(spark, sf_dir):
    """Reports, claims and citations out of replies, with defaults for what is missing."""
    text = WRITTEN_REPORTS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    reports, claims = report.parsed_reports(spark.sql(f"WITH {text} SELECT * FROM written", events=table(spark, sf_dir, "events")))
    lines = lambda c: F.when(c["line"].isNotNull(), F.concat(F.lit(":"), c["line"].cast("string"), F.lit("-"), c["end_line"].cast("string"))).otherwise("")
    shown = claims.select("report_id", "section", "nth", "text", F.array_join(F.transform("citations", lambda c: F.concat(c["path"], lines(c))), ";").alias("cited"))
    return reports.join(shown, "report_id", "left")
