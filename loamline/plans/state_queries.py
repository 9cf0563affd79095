"""Stateful operators over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import ranking, report
from loamline.plans.registry import query, table
from loamline.streaming import limits


@query("SELECT event_id AS seq, user_id AS task_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events")
def progress_monotone(spark, sf_dir):
    """Percent that never falls (users as tasks)."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"), F.get_json_object("props", "$.k").cast("long").alias("percent"))
    return ranking.running_max(own, ["task_id"], "seq", "percent").select("seq", "task_id", "shown")


@query("""
WITH c AS (SELECT event_id, user_id, count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS done FROM events)
SELECT event_id AS seq, user_id AS task_id, done AS completed, CAST(floor(35 + 40.0::DOUBLE * (done::DOUBLE / greatest(12, done, 1))) AS BIGINT) AS percent FROM c""")
def module_interpolate(spark, sf_dir):
    """Percent by completed modules of twelve planned (views as completions)."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"), "event_type")
    return ranking.module_progress(own, ["task_id"], "seq", F.col("event_type") == "view", F.lit(12)).select("seq", "task_id", "completed", "percent")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def last_n_events(spark, sf_dir):
    """The last 20 events of each task."""
    return ranking.last_n(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 20)


@query("""
SELECT user_id AS task_id, event_type AS key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY event_id) AS state FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL
UNION ALL SELECT user_id, event_type, CAST(max_by(value, event_id) AS VARCHAR) FROM events WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY ALL""")
def delta_merge(spark, sf_dir):
    """State from deltas: three keys collect, the others keep their last value."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"))
    return report.merged_state(own, ["view", "click", "error"]).select("task_id", "key", F.array_join("values", ",").alias("state"))


@query("""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT client, 0::BIGINT AS n, 0::BIGINT AS seq, []::DOUBLE[] AS stamps, false AS allowed, false AS asked FROM (SELECT DISTINCT client FROM e)
  UNION ALL
  SELECT e.client, e.n, e.seq,
         CASE WHEN e.event_type = 'error' THEN f.stamps[:-2]
              WHEN len(list_filter(f.stamps, lambda s: s > e.ts - 86400)) < 2 THEN list_append(list_filter(f.stamps, lambda s: s > e.ts - 86400), e.ts)
              ELSE list_filter(f.stamps, lambda s: s > e.ts - 86400) END,
         e.event_type <> 'error' AND len(list_filter(f.stamps, lambda s: s > e.ts - 86400)) < 2, e.event_type <> 'error'
  FROM f JOIN e ON e.client = f.client AND e.n = f.n + 1)
SELECT client, seq, allowed, CAST(len(stamps) AS INTEGER) AS in_window FROM f WHERE asked""")
def rate_limit(spark, sf_dir):
    """Two submissions a day and user; an error refunds the last one."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("seq"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("ts"), F.when(F.col("event_type") == "error", "refund").otherwise("submit").alias("op"))
    return limits.rate_limit(own, 86400.0, 2).select("client", "seq", "allowed", "in_window")


@query("""
WITH RECURSIVE e AS (
  SELECT CAST(user_id - user_id % 20 AS VARCHAR) AS gate, event_id AS seq, event_type = 'purchase' AS release, CAST(user_id AS VARCHAR) AS task, row_number() OVER (PARTITION BY user_id - user_id % 20 ORDER BY event_id) AS n FROM events),
f AS (
  SELECT gate, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::VARCHAR AS task_id, []::VARCHAR[] AS running, []::VARCHAR[] AS waiting, NULL::VARCHAR AS result, NULL::VARCHAR AS promoted FROM (SELECT DISTINCT gate FROM e)
  UNION ALL
  SELECT gate, n, seq, task,
         CASE WHEN release AND runs THEN list_concat(list_filter(r, lambda x: x <> task), w[1:1]) WHEN NOT release AND NOT runs AND NOT waits AND len(r) < 2 THEN list_append(r, task) ELSE r END,
         CASE WHEN release AND runs THEN w[2:] WHEN release THEN list_filter(w, lambda x: x <> task) WHEN NOT runs AND NOT waits AND len(r) >= 2 AND len(w) < 3 THEN list_append(w, task) ELSE w END,
         CASE WHEN release THEN CASE WHEN runs OR waits THEN 'released' ELSE 'unknown' END WHEN runs OR (NOT waits AND len(r) < 2) THEN 'running' WHEN waits OR len(w) < 3 THEN 'queued' ELSE 'rejected' END,
         CASE WHEN release AND runs THEN w[1] END
  FROM (SELECT e.*, f.running AS r, f.waiting AS w, list_contains(f.running, e.task) AS runs, list_contains(f.waiting, e.task) AS waits FROM f JOIN e ON e.gate = f.gate AND e.n = f.n + 1))
SELECT gate, seq, task_id, result, CASE WHEN result = 'queued' THEN CAST(list_position(waiting, task_id) AS INTEGER) ELSE 0 END AS place, promoted FROM f WHERE n > 0""")
def gate_fifo(spark, sf_dir):
    """Gates of two slots and three places, one for every twenty users: purchases release, all other events acquire."""
    user = F.col("user_id")
    own = table(spark, sf_dir, "events").select((user - user % 20).alias("gate"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "release").otherwise("acquire").alias("op"), user.cast("string").alias("task_id"))
    return limits.gate(own, 2, 3)


@query("""
SELECT event_id, CASE WHEN user_id < 10 THEN 'no_credentials' WHEN event_type = 'error' THEN 'rate_limited' WHEN value < 5 THEN 'invalid_url' WHEN event_type = 'signup' THEN 'no_space' WHEN event_type = 'click' THEN 'queue_full' WHEN event_type = 'view' THEN 'queued' ELSE 'accepted' END AS decision FROM events""")
def submission_order(spark, sf_dir):
    """First test that a submission fails, in the fixed order."""
    e = F.col("event_type")
    gate = F.when(e == "click", "rejected").when(e == "view", "queued").otherwise("running")
    return table(spark, sf_dir, "events").select("event_id", limits.admission(F.col("user_id") >= 10, e != "error", F.col("value") >= 5, e != "signup", gate).alias("decision"))


@query("""
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS client, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS ts, event_type = 'error' AS refund, event_id % 7 <> 0 AS credentials, event_id % 5 <> 0 AS url_ok, event_type <> 'signup' AS fits,
         CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'rejected' ELSE 'running' END WHEN 'view' THEN 'queued' ELSE 'running' END AS gate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT client, 0::BIGINT AS n, 0::BIGINT AS seq, []::DOUBLE[] AS stamps, NULL::VARCHAR AS decision FROM (SELECT DISTINCT client FROM e)
  UNION ALL
  SELECT client, n, seq, CASE WHEN refund THEN old[:-2] WHEN decision IN ('accepted', 'queued') THEN list_append(held, ts) ELSE held END, decision
  FROM (
    SELECT *, CASE WHEN refund THEN NULL WHEN NOT credentials THEN 'no_credentials' WHEN len(held) >= 3 THEN 'rate_limited' WHEN NOT url_ok THEN 'invalid_url' WHEN NOT fits THEN 'no_space' WHEN gate = 'rejected' THEN 'queue_full' WHEN gate = 'queued' THEN 'queued' ELSE 'accepted' END AS decision
    FROM (SELECT e.*, f.stamps AS old, list_filter(f.stamps, lambda s: s > e.ts - 259200) AS held FROM f JOIN e ON e.client = f.client AND e.n = f.n + 1)))
SELECT client, seq, decision, CAST(len(stamps) AS INTEGER) AS in_window FROM f WHERE decision IS NOT NULL""")
def joint_admission(spark, sf_dir):
    """Submissions against credentials, three in three days, address, room and gate; only admitted ones count, an error refunds the last."""
    e, i = F.col("event_type"), F.col("event_id")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    gate = F.when((e == "click") & (i % 2 == 0), "rejected").when(e == "view", "queued").otherwise("running")
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), i.alias("seq"), seconds.alias("ts"), F.when(e == "error", "refund").otherwise("submit").alias("op"), (i % 7 != 0).alias("credentials"), (i % 5 != 0).alias("url_ok"), (e != "signup").alias("fits"), gate.alias("gate_result"))
    return limits.admissions(own, 259200.0, 3).select("client", "seq", "decision", "in_window")


@query("""
WITH c AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) AS b,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 ORDER BY event_id) AS same,
  sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS output FROM events)
SELECT event_id AS seq, CASE WHEN floor(n / 4) > 8 THEN 'rounds' WHEN same > 2 THEN 'repeated'
  WHEN EXISTS (SELECT 1 FROM c y WHERE y.user_id = c.user_id AND y.event_type = c.event_type AND y.event_id < c.event_id AND least(y.b, c.b) - greatest(y.a, c.a) + 1 >= 0.6 * (c.b - c.a + 1)) THEN 'overlap'
  WHEN output > 60000 THEN 'output' END AS stop FROM c""")
def agent_guards(spark, sf_dir):
    """Why a call ends an agent's loop (a user's events as an agent's calls)."""
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("long")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.floor(n / 4).alias("round"), F.col("event_type").alias("tool"), (k % 7).alias("arguments"), F.col("event_type").alias("path"), F.floor("value").alias("start"), (F.floor("value") + k).alias("end"), F.floor(F.col("value") * 100).alias("output_chars"))
    return limits.agent_guards(own).select("seq", "stop")
