"""Small operators over stand-in columns: admission, states, payload rows, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import paths, text, urls
from loamline.operators import imports, lookup, payloads, ranking, report, review
from loamline.plans.registry import query, table
from loamline.plans.repository_queries import LINKS, REPO, WRITTEN, _duck, python_edges, python_files
from loamline.streaming import limits


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'tree_truncated' WHEN o_custkey * 10 > 8000 THEN 'too_many_files' WHEN o_totalprice * 10 > 1572864 THEN 'too_large' END AS reason FROM orders""")
def admission_reason(spark, sf_dir):
    """First reason against a repository (orders: customer as number of files, price as size)."""
    own = table(spark, sf_dir, "orders")
    return own.select("o_orderkey", urls.admission(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") * 10, F.col("o_totalprice") * 10).alias("reason"))


@query("""
WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 429 ELSE 500 + event_id % 50 END AS status FROM events)
SELECT event_id, CASE WHEN status = 200 THEN NULL WHEN status = 404 THEN 'not_found' WHEN status IN (401, 403) THEN 'no_access' WHEN status = 429 THEN 'rate_limited' ELSE 'network_error' END AS reason FROM s""")
def metadata_reason(spark, sf_dir):
    """Rejection reasons of metadata responses."""
    i = F.col("event_id") % 6
    status = F.when(i == 0, 200).when(i == 1, 404).when(i == 2, 401).when(i == 3, 403).when(i == 4, 429).otherwise(500 + F.col("event_id") % 50)
    return table(spark, sf_dir, "events").select("event_id", urls.http_reason(status).alias("reason"))


_SAID = ["fatal: repository not found", "fatal: Authentication failed for it", "error: RPC failed; curl 56", "fatal: Could not resolve host: x", "remote: Permission denied, early EOF", "something else"]
_SAID_SQL = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAID))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_found' WHEN 1 THEN 'no_access' WHEN 2 THEN 'network_error' WHEN 3 THEN 'network_error' WHEN 4 THEN 'no_access' ELSE 'not_found' END AS reason, event_id % 6 IN (2, 3) AS retry FROM events""")
def clone_failures(spark, sf_dir):
    """Why a clone failed and whether to try again, permanent causes first."""
    output = F.expr(f"CASE event_id % 6 {_SAID_SQL} END")
    return table(spark, sf_dir, "events").select("event_id", urls.clone_failure(output).alias("r")).select("event_id", "r.reason", "r.retry")


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'a/.env' WHEN 1 THEN 'keys/' || p_partkey || '.PEM' WHEN 2 THEN '.netrc' WHEN 3 THEN 'a/x.py' WHEN 4 THEN '.env.example' WHEN 5 THEN 'b/.key' ELSE 'b/my.key' END AS path FROM part)
SELECT p_partkey, path, p_partkey % 7 IN (0, 1, 2, 6) AS shaped FROM p""")
def secret_shaped(spark, sf_dir):
    """Which files are shaped like secrets by name."""
    path = F.expr("CASE p_partkey % 7 WHEN 0 THEN 'a/.env' WHEN 1 THEN 'keys/' || p_partkey || '.PEM' WHEN 2 THEN '.netrc' WHEN 3 THEN 'a/x.py' WHEN 4 THEN '.env.example' WHEN 5 THEN 'b/.key' ELSE 'b/my.key' END")
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), paths.secret_shaped(path).alias("shaped"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'a/c' WHEN 4 THEN NULL ELSE 'src/' || p_partkey END AS target FROM part""")
def safe_targets(spark, sf_dir):
    """Normalised targets inside a working copy: the root, absolute ones, ones that leave it, folded ones."""
    asked = F.expr("CASE p_partkey % 6 WHEN 0 THEN ' . ' WHEN 1 THEN '/etc/passwd' WHEN 2 THEN 'a/../../b' WHEN 3 THEN './a/b/../c' WHEN 4 THEN 'C:/x' ELSE 'src//' || p_partkey END")
    return table(spark, sf_dir, "part").select("p_partkey", lookup.safe_target(asked).alias("target"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 200 WHEN event_type = 'error' THEN 410 ELSE 409 END AS status FROM events")
def workspace_states(spark, sf_dir):
    """Whether a working copy's files are there, were cleared, or never were."""
    return table(spark, sf_dir, "events").select("event_id", lookup.workspace_status(F.col("user_id") % 3 == 0, F.col("event_type") == "error").alias("status"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://tionsh\.example\.net/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+') THEN regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) || '/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/[^/]+/([^/?#]+)', 1), '\.git$', '') ELSE url END AS slug
FROM pages""")
def repository_slugs(spark, sf_dir):
    """owner/name of addresses on the default host, else the address."""
    moved = F.regexp_replace("url", r"^(https?)://tionsh\.example\.net/", "$1://github.com/")
    return table(spark, sf_dir, "pages").select("page_id", F.when(moved == F.col("url"), F.col("url")).otherwise(payloads.repo_slug(moved)).alias("slug")).select("page_id", F.regexp_replace("slug", "^(https?)://github.com/", "$1://tionsh.example.net/").alias("slug"))


@query("SELECT DISTINCT user_id AS repo FROM events WHERE event_type NOT IN ('signup', 'error')")
def running_repositories(spark, sf_dir):
    """Working copies of unfinished tasks."""
    e = F.col("event_type")
    status = F.when(e == "signup", "completed").when(e == "error", "failed").otherwise("running")
    return payloads.running_repos(table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), status.alias("status")))


@query("""
WITH c AS (SELECT c_custkey AS repo, c_custkey % 50 AS last_used FROM customer), u AS (SELECT o_custkey AS repo, max(o_orderkey % 100) AS t FROM orders GROUP BY 1)
SELECT c.repo, greatest(last_used, coalesce(t, last_used)) AS last_used FROM c LEFT JOIN u ON u.repo = c.repo""")
def touched_copies(spark, sf_dir):
    """Last use of working copies after successful uses."""
    copies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), (F.col("c_custkey") % 50).alias("last_used"))
    return payloads.touched(copies, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") % 100).alias("at")))


@query("""
SELECT c_custkey AS task_id, c_acctbal AS created_at, c_name AS repo, c_phone_ AS commit_sha, CAST(coalesce(n, 0) AS INTEGER) AS finding_count
FROM (SELECT *, c_mktsegment AS c_phone_ FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def history_entries(spark, sf_dir):
    """Rows of a history with their numbers of findings."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_acctbal").alias("created_at"), F.col("c_name").alias("repo"), F.col("c_mktsegment").alias("commit_sha"))
    return payloads.history_rows(tasks, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("task_id")))


@query("""
WITH d AS (SELECT event_id, event_type = 'error' AS f, event_id % 10 = 0 AS terminal, event_id % 13 = 0 AS brings, CAST(event_id % 90 AS INTEGER) AS percent FROM events)
SELECT event_id, f OR brings AS failed, CASE WHEN terminal AND (f OR brings) THEN NULL WHEN terminal THEN 100 ELSE percent END AS percent FROM d""")
def delta_rows(spark, sf_dir):
    """Progress rows of deltas: failures by event or by what they bring; a failed end has no percent."""
    i = F.col("event_id")
    failures = F.when(i % 13 == 0, F.array(F.lit("x"))).when(i % 2 == 0, F.array().cast("array<string>"))
    own = table(spark, sf_dir, "events").select(i, F.when(F.col("event_type") == "error", True).alias("event_failed"), (i % 10 == 0).alias("terminal"), failures.alias("failures"), (i % 90).cast("int").alias("percent"))
    return payloads.delta_events(own).select("event_id", "failed", "percent")


@query("SELECT 'event' AS row, event_type AS node, count(*) AS n, count(*) FILTER (value < 5) AS failed FROM events GROUP BY 2 UNION ALL SELECT 'failure', event_type, count(*), count(*) FROM events WHERE value < 5 GROUP BY 2")
def node_rows(spark, sf_dir):
    """Every run of a node is an event, a failed one a failure as well."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.lit("s").alias("scope"), F.col("event_id").alias("duration_ms"), F.lit("").alias("summary"), F.when(F.col("value") < 5, "low").alias("error"))
    failures, events = payloads.node_rows(runs)
    counted = events.groupBy(F.lit("event").alias("row"), "node").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"))
    return counted.union(failures.groupBy(F.lit("failure").alias("row"), "node").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("failed")))


@query("""
WITH j AS (SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus = 'P') AS unjudged FROM orders GROUP BY 1)
SELECT category, category || ': ' || n || ' candidates, ' || hits || ' reported' AS text, CASE WHEN hits > 0 THEN hits || ' found' ELSE 'executed, nothing found' END AS description FROM j WHERE unjudged < n""")
def findings_summary(spark, sf_dir):
    """Texts on the outcome of each category."""
    status = F.col("o_orderstatus")
    judged = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.when(status == "F", "report").when(status == "P", "unjudged").otherwise("suppress").alias("verdict"))
    out = review.outcomes(judged, judged.select("category"))
    return out.where("status = 'executed'").join(payloads.findings_summary(out), "category").select("category", "text", "description")


@query("""
WITH d AS (SELECT event_id AS seq, user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
past AS (SELECT * FROM d WHERE back > 5), l AS (SELECT task_id, max(seq) AS last FROM past GROUP BY 1)
SELECT seq, task_id, 'replay' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM past) WHERE n <= 10
UNION ALL SELECT seq, d.task_id, 'live' FROM d LEFT JOIN l ON l.task_id = d.task_id WHERE back <= 7 AND (last IS NULL OR seq > last)""")
def replayed_events(spark, sf_dir):
    """A subscriber's view: the last ten past events, then the live ones; what is in both comes once."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("task_id"))
    marked = ranking.top_per(own, 1 << 30, ["task_id"], F.desc("seq"), name="back")
    return limits.replay(marked.where("back > 5").select("seq", "task_id"), marked.where("back <= 7").select("seq", "task_id"), 10).select("seq", "task_id", "origin")


@query("""
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN CAST(event_id % 300 AS VARCHAR) ELSE '-5' END AS s, CASE event_id % 3 WHEN 0 THEN NULL ELSE CAST(event_id % 900 AS VARCHAR) END AS e FROM events),
n AS (SELECT event_id, greatest(coalesce(TRY_CAST(s AS INTEGER), 1), 1) AS start, TRY_CAST(e AS INTEGER) AS e FROM r)
SELECT event_id, start, coalesce(e, start + 199) AS "end" FROM n""")
def read_ranges(spark, sf_dir):
    """Ranges of reads from loose arguments."""
    start, end = limits.read_range(F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN CAST(event_id % 300 AS STRING) ELSE '-5' END"), F.expr("CASE event_id % 3 WHEN 0 THEN NULL ELSE CAST(event_id % 900 AS STRING) END"))
    return table(spark, sf_dir, "events").select("event_id", start.alias("start"), end.alias("end"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter(['before', text, 'after'], lambda x: trim(x, ' ') <> ''), chr(10)) AS shown FROM conversations WHERE NOT contains(text, chr(10))""")
def without_thinking(spark, sf_dir):
    """Replies without thinking markers and blank lines."""
    own = table(spark, sf_dir, "conversations").where(~F.col("text").contains("\n"))
    return own.select("conv_id", "turn", text.without_thinking(F.concat(F.lit("before<think>\n\n"), "text", F.lit("</think>  \n after").substr(1, 8), F.lit("\n  \nafter"))).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || '... (truncated)' ELSE text END AS shown FROM documents")
def truncated_texts(spark, sf_dir):
    """Texts cut to 300 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), 300).alias("shown"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/b' || p_partkey || '.js,a/b' || p_partkey || '.ts,a/b' || p_partkey || '.tsx' WHEN 1 THEN 'lib/x,lib/x.ts,lib/x/index.ts,src/x,src/x.ts,src/x/index.ts,x,x.ts,x/index.ts' ELSE 'main.ts,main.ts.ts,main.ts/index.ts' END AS candidates FROM part""")
def source_candidates(spark, sf_dir):
    """Source files that a manifest's target may stand for."""
    from loamline.operators.entrypoints import typescript_candidates

    target = F.expr("CASE p_partkey % 3 WHEN 0 THEN './a/b' || p_partkey || '.js' WHEN 1 THEN './lib/x' ELSE 'main.ts' END")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(typescript_candidates(target), ",").alias("candidates"))


@query("SELECT o_custkey AS src, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS targets FROM orders WHERE o_orderpriority < '2' GROUP BY 1")
def edge_lists(spark, sf_dir):
    """Targets of each source in order."""
    own = table(spark, sf_dir, "orders").where("o_orderpriority < '2'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return payloads.edge_lists(own).select("src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("""
WITH r AS (SELECT o_custkey AS reply, o_orderkey AS nth, CAST(floor(o_totalprice) AS BIGINT) % 7 AS n FROM orders)
SELECT reply, nth, n FROM (SELECT *, row_number() OVER (PARTITION BY reply ORDER BY n DESC, nth) AS place FROM r) WHERE place = 1""")
def best_candidate(spark, sf_dir):
    """Of several readings of a reply the one with the most items, the first of equals."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reply"), F.col("o_orderkey").alias("nth"), F.sequence(F.lit(1), F.lit(7)).alias("all"), (F.floor("o_totalprice").cast("long") % 7).alias("n"))
    items = F.when(F.col("n") == 0, F.array().cast("array<int>")).otherwise(F.expr("slice(all, 1, cast(n as int))"))
    picked = report.best_reading(own.select("reply", "nth", items.alias("items")), "reply", "nth", "items")
    return picked.select("reply", "nth", F.size("items").cast("long").alias("n"))


@query("""
SELECT CAST(n_nationkey + 20 AS INTEGER) AS name FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)""")
def unknown_decisions(spark, sf_dir):
    """Names in a plan's decisions that no module has."""
    nation = table(spark, sf_dir, "nation")
    decisions = nation.select((F.col("n_nationkey") + 20).cast("int").alias("name"), F.lit(True).alias("keep"))
    return ranking.unknown_names(nation.select(F.col("n_nationkey").cast("int").alias("name")), decisions)


@query("""
WITH m AS (SELECT conv_id AS name, max(turn) AS turns, max_by(text, turn) AS text FROM conversations GROUP BY 1) SELECT name, CASE WHEN name % 5 = 0 OR name % 7 = 0 THEN 'failed' ELSE 'analysed' END AS state, CASE WHEN name % 5 = 0 OR name % 7 = 0 THEN NULL ELSE 'stopped early: rounds' END AS limitation FROM m WHERE trim(left(text, 100), ' ') <> '' AND NOT contains(text, '<')""")
def forced_summaries(spark, sf_dir):
    """What an agent that was stopped gives: a failure if its summary is blank or degenerate, else an analysis with the reason as its limitation."""
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("name")).agg(F.max_by("text", "turn").alias("text"))
    own = own.where((F.trim(F.substring("text", 1, 100)) != "") & ~F.col("text").contains("<"))
    reply = F.when(F.col("name") % 5 == 0, F.lit(" ")).when(F.col("name") % 7 == 0, F.repeat(F.lit("abcd"), 80)).otherwise(F.substring("text", 1, 100))
    return limits.forced_summary(own.select("name", reply.alias("reply"), F.lit("rounds").alias("stop"))).select("name", "state", "limitation")


@query("SELECT c_custkey AS k, 'owner' || c_custkey || '__na__me' AS workdir, 'owner' || c_custkey AS owner, 'na__me' AS name FROM customer")
def workdirs(spark, sf_dir):
    """Working folders of repository identifiers in several spellings, and back by the known owner and name."""
    k = F.col("c_custkey")
    spelled = F.concat(F.expr("CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/' WHEN 1 THEN 'http://github.com/' WHEN 2 THEN 'github.com/' ELSE '' END"), F.lit("owner"), k.cast("string"), F.lit("/na__me"), F.when(k % 2 == 0, ".git").otherwise(""))
    own = table(spark, sf_dir, "customer").select(k.alias("k"), urls.identifier(spelled).alias("i"))
    return own.select("k", urls.workdir(F.col("i.owner"), F.col("i.name")).alias("workdir"), "i.owner", "i.name")


@query("SELECT event_id, 'a=' || CASE WHEN length(event_type) > 4 THEN '<' || length(event_type) || ' chars>' ELSE event_type END || ' k=[2]' AS text FROM events")
def output_summaries(spark, sf_dir):
    """Sorted keys of a node's output with sizes of lists and lengths of long strings."""
    own = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("k"), F.lit("[1, 2]"), F.lit("a"), F.to_json(F.struct(F.col("event_type").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("event_type").alias("v")))) - 6)).alias("output"))
    return own.select("event_id", payloads.output_summary(F.col("output"), 4).alias("text"))


@query("""
SELECT event_id, category, call, (category = 'security' AND call IN ('execute', 'system', 'slack_token')) OR (category = 'error_handling' AND call = 'requests') AS told
FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'security' ELSE 'error_handling' END AS category, ['execute', 'requests', 'system', 'slack_token', 'nowhere'][event_id % 5 + 1] AS call FROM events)""")
def scope_texts(spark, sf_dir):
    """Whether the text on what a category looks for names a call or a pattern."""
    scope = F.create_map(*[F.lit(x) for pair in review.scope_texts().items() for x in pair])
    call = F.element_at(F.array(*[F.lit(c) for c in ("execute", "requests", "system", "slack_token", "nowhere")]), (F.col("event_id") % 5 + 1).cast("int"))
    own = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "security").otherwise("error_handling").alias("category"), call.alias("call"))
    return own.withColumn("told", F.element_at(scope, F.col("category")).contains(F.col("call")))


@query("""
WITH f AS (SELECT p_partkey AS k, 'a/' || p_partkey || '.py' AS path, p_size AS centrality, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 5 AS BIGINT) END AS churn FROM part)
SELECT count(*) AS n FROM (SELECT * FROM f LIMIT 10)""")
def review_target_count(spark, sf_dir):
    """Ten files of a repository are worth a review."""
    own = table(spark, sf_dir, "part").select(F.lit("r").alias("repo_id"), F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.col("p_size").cast("double").alias("score"), F.col("p_partkey").alias("k"))
    churn = own.where("k % 3 = 0").select("repo_id", "path", (F.col("k") % 5).alias("n"))
    return review.review_targets(own, own, churn).agg(F.count(F.lit(1)).alias("n"))


@query(_duck(f"""
WITH {WRITTEN}, {LINKS}, e AS (SELECT DISTINCT repo_id, src, dst FROM links)
SELECT repo_id, least(10, count(DISTINCT src)) AS n FROM e WHERE (repo_id, src) NOT IN (SELECT repo_id, dst FROM e) GROUP BY repo_id"""))
def roots_of_repositories(spark, sf_dir):
    """Files of each repository that import others and that nothing imports."""
    from loamline.operators.entrypoints import root_entries

    return root_entries(python_edges(spark, sf_dir)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


@query(_duck(f"SELECT {REPO} AS repo_id, count(*) AS n, min('pkg' || c_custkey % 7 || '/mod' || c_custkey) AS first_stem FROM customer GROUP BY 1"))
def stem_index(spark, sf_dir):
    """Stems of a repository's files."""
    return imports.stem_index(python_files(spark, sf_dir)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("first_stem"))
