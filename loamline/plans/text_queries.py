"""Text, path and address operators over stand-in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.functions import json_reply, paths, text, urls
from loamline.operators import lookup, ranking, review
from loamline.plans.registry import query, table
from loamline.sources import repos

#: DuckDB's pattern for the line breaks of text.LINE_BREAK.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = f"""cut AS (SELECT doc_id, text, regexp_split_to_array(text, '{BREAK}') AS p FROM documents),
lines AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM cut)"""


@query(f"WITH {LINES} SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines_py, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS n_lines_nl FROM lines")
def doc_lines(spark, sf_dir):
    """Both line counts of documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(t)).alias("n_lines_py"), text.n_lines_nl(t).cast("int").alias("n_lines_nl"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n FROM lines),
starts AS (SELECT doc_id, n, unnest(CASE WHEN n <= 5 THEN [1::BIGINT] ELSE generate_series(1, n - 1, 4) END) AS s FROM n WHERE n > 0)
SELECT doc_id, s AS "start", least(s + 4, n) AS "end" FROM starts""")
def line_chunks(spark, sf_dir):
    """Documents in windows of five lines, one shared."""
    counted = table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("n"))
    own = counted.select("doc_id", F.explode(ranking.line_windows(F.col("n"), 5, 1)).alias("w"))
    return own.select("doc_id", "w.start", "w.end")


@query("""
WITH names AS (SELECT DISTINCT p_name || ' ' || p_type AS v FROM part), c AS (SELECT v, unnest(string_split(v, '')) AS ch FROM names),
n AS (SELECT v, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)
SELECT v AS value, round(-sum(n / length(v) * log2(n / length(v))), 9) AS entropy FROM n GROUP BY v""")
def entropy(spark, sf_dir):
    """Entropy of part names."""
    own = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("value")).distinct()
    return own.select("value", F.round(text.entropy(F.col("value")), 9).alias("entropy"))


@query("""
WITH v AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_name ELSE c_mktsegment END AS value FROM customer)
SELECT c_custkey, CASE WHEN length(value) <= 8 THEN repeat('*', length(value)) ELSE left(value, 3) || repeat('*', length(value) - 6) || right(value, 3) END AS shown FROM v""")
def redact(spark, sf_dir):
    """Hidden values."""
    value = F.when(F.col("c_nationkey") < 12, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.redact(value).alias("shown"))


_QUOTED = ", ".join(f"'{x}'" for x in text.PLACEHOLDERS + text.KNOWN_VALUES)


@query(f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS value FROM conversations),
b AS (SELECT value, lower(regexp_replace(regexp_replace(value, '^[<>{{}}\\[\\]]+', ''), '[<>{{}}\\[\\]]+$', '')) AS bare FROM w)
SELECT value, bare IN ({_QUOTED}) OR starts_with(bare, '$') OR starts_with(bare, '%(') OR starts_with(bare, '{{{{') OR starts_with(bare, 'os.environ') OR starts_with(bare, 'process.env')
  OR len(list_distinct(list_filter(string_split(bare, ''), lambda c: c <> ''))) <= 2 AS placeholder FROM b""")
def placeholder_filter(spark, sf_dir):
    """Which words of conversations could only stand for a secret."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("value")).distinct()
    return words.select("value", text.is_placeholder(F.col("value")).alias("placeholder"))


@query("""
WITH v AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS a, lower(regexp_replace(split_part(p_name, ' ', 2), '[^A-Za-z0-9]', '', 'g')) AS b FROM part)
SELECT p_partkey, a <> '' AND b <> '' AND (a = b OR length(b) >= 6 AND (contains(a, b) OR contains(b, a))) AS mirrors FROM v""")
def mirrors_name(spark, sf_dir):
    """Whether the second word of a part's name only repeats it."""
    return table(spark, sf_dir, "part").select("p_partkey", text.mirrors_name(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("mirrors"))


_SCANS = " UNION ALL ".join(f"SELECT '{t}' AS source, {k} AS id, '{n}' AS pattern, unnest(regexp_extract_all({c}, '{p}')) AS match FROM {t}" for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")) for n, p in review.SECRETS.items())


@query(_SCANS)
def secret_scan(spark, sf_dir):
    """Secrets of fixed formats in all texts."""
    out = None
    for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        own = review.secret_formats(table(spark, sf_dir, t).select(F.col(k).alias("id"), c), c, "id").withColumn("source", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out.select("source", "id", "pattern", "match")


@query("""
WITH t AS (SELECT doc_id, text, right(text, 400) AS tail FROM documents),
x AS (SELECT *, list_transform([4, 6, 8, 12], lambda w: (length(tail) - length(replace(tail, left(tail, w), ''))) / w) AS n FROM t)
SELECT doc_id, length(text) >= 200 AND (
  (trim(left(tail, 4), ' ') <> '' AND n[1] >= 8 AND n[1] * 4 >= 0.4 * length(tail)) OR (trim(left(tail, 6), ' ') <> '' AND n[2] >= 8 AND n[2] * 6 >= 0.4 * length(tail)) OR
  (trim(left(tail, 8), ' ') <> '' AND n[3] >= 8 AND n[3] * 8 >= 0.4 * length(tail)) OR (trim(left(tail, 12), ' ') <> '' AND n[4] >= 8 AND n[4] * 12 >= 0.4 * length(tail)) OR
  len(list_distinct(list_filter(string_split(tail, ''), lambda c: c <> ''))) / length(tail) < 0.08) AS degenerate FROM x""")
def degenerate_text(spark, sf_dir):
    """Documents that end in repetition."""
    return table(spark, sf_dir, "documents").select("doc_id", text.degenerate(F.col("text")).alias("degenerate"))


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


@query(f"""
WITH f AS (SELECT page_id, {_URL_PATH} AS p FROM pages)
SELECT page_id, regexp_replace(p, '^/', '') AS path, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN ends_with(p, '.html') THEN 'HTML' ELSE 'Other' END AS language FROM f""")
def file_profile(spark, sf_dir):
    """Pages as files: path, name and language of their addresses."""
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), "^/", "").alias("path"))
    return own.select("page_id", "path", paths.file_name(F.col("path")).alias("name"), paths.language(F.col("path")).alias("language"))


@query(f"""
WITH f AS (SELECT page_id, {_URL_PATH} AS p FROM pages)
SELECT page_id, trim(regexp_replace(p, '/+', '/', 'g'), '/') AS folded, regexp_replace(trim(p, '/'), '/?[^/]*$', '') AS parent, '' AS outside FROM f""")
def path_normalise(spark, sf_dir):
    """Paths with dots folded: through a sibling and back, one up from a child, and out of the root."""
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("p"))
    up = paths.normalise(F.concat(F.lit("./x/.."), F.col("p")))
    return own.select("page_id", up.alias("folded"), paths.normalise(F.concat(F.rtrim(F.col("p"), F.lit("/")), F.lit("/.."))).alias("parent"), paths.normalise(F.concat(F.lit("a/../.."), F.col("p"))).alias("outside"))


@query(r"""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://tionsh\.example\.net/([^?#]*)', 1), '/') AS x FROM pages WHERE regexp_matches(url, '^https?://tionsh\.example\.net/')),
r AS (SELECT page_id, list_filter(x, lambda c: c <> '') AS x FROM p)
SELECT pages.page_id, x[1] AS owner, regexp_replace(x[2], '\.git$', '') AS name FROM pages LEFT JOIN r ON r.page_id = pages.page_id AND len(x) >= 2 AND regexp_matches(x[1], '^[A-Za-z0-9._-]+$') AND regexp_matches(x[2], '^[A-Za-z0-9._-]+$')
  AND NOT contains(x[2], '..') AND NOT starts_with(x[2], '-')""")
def url_repository(spark, sf_dir):
    """Owner and name of addresses on one host."""
    return table(spark, sf_dir, "pages").select("page_id", urls.repository(F.col("url"), "tionsh.example.net").alias("r")).select("page_id", "r.owner", "r.name")


@query("""
SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN c_name WHEN c_nationkey < 16 THEN c_mktsegment ELSE 'unknown' END AS client FROM customer""")
def client_key(spark, sf_dir):
    """Key of a client from a forwarding header, its address, or neither."""
    n = F.col("c_nationkey")
    forwarded = F.when(n < 8, F.concat(F.lit(" "), "c_name", F.lit(" , 10.0.0.1"))).when(n < 12, F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", urls.client_key(forwarded, F.when(n < 16, F.col("c_mktsegment"))).alias("client"))


@query("""
SELECT doc_id, left(sha256(source || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || 'local:hash64:v1' || chr(0) || 'v1' || CASE WHEN n_chars > 2000 THEN chr(0) || 'top' || n_chars ELSE '' END), 16) AS digest FROM documents""")
def cache_digest(spark, sf_dir):
    """Digests of index keys, with a scope for sampled ones."""
    scope = urls.scope_label(F.when(F.col("n_chars") > 2000, F.col("n_chars")).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", urls.cache_digest(F.col("source"), F.col("doc_id"), F.lit("local:hash64:v1"), F.lit("v1"), scope).alias("digest"))


@query("""
WITH d AS (SELECT *, lead(source) OVER w AS s2, lead(lang) OVER w AS l2, lead(doc_id) OVER w AS nxt FROM documents WINDOW w AS (PARTITION BY n_chars ORDER BY doc_id))
SELECT doc_id, nxt, array_to_string(list_filter([CASE WHEN source <> s2 THEN 'repo' END, CASE WHEN doc_id <> nxt THEN 'commit_sha' END, CASE WHEN lang <> l2 THEN 'provider_identity' END], lambda x: x IS NOT NULL), ',') AS differs FROM d WHERE nxt IS NOT NULL""")
def key_diff(spark, sf_dir):
    """Parts in which the keys of documents of the same length differ."""
    from pyspark.sql import Window

    w = Window.partitionBy("n_chars").orderBy("doc_id")
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *[F.lead(c).over(w).alias(f"{c}2") for c in ("source", "lang", "doc_id")]).where("doc_id2 is not null")
    diff = urls.key_diff({"repo": F.col("source"), "commit_sha": F.col("doc_id"), "provider_identity": F.col("lang")}, {"repo": F.col("source2"), "commit_sha": F.col("doc_id2"), "provider_identity": F.col("lang2")})
    return own.select("doc_id", F.col("doc_id2").alias("nxt"), F.array_join(diff, ",").alias("differs"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS json FROM events")
def json_props(spark, sf_dir):
    """JSON out of a reply with a fence around it, and a value of it."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    own = table(spark, sf_dir, "events").select("event_id", json_reply.first_json(reply).alias("json"))
    return own.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"), "json")


#: A reply for every event: prose around two spans, fences in a row, quotes left bare inside a string, a bare array, and no JSON at all.
REPLIES = """replies AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN 'Here: {"a": ' || CAST(event_id AS STRING) || ', "b": [1, {"c": 2}]} and then {"d": "x}y"} done'
    WHEN 1 THEN '```text' || chr(10) || 'plain' || chr(10) || '```' || chr(10) || 'Now:' || chr(10) || '```json' || chr(10) || '{"e": ' || CAST(event_id AS STRING) || '}' || chr(10) || '```' || chr(10) || 'and [1, 2]'
    WHEN 2 THEN 'So: {"say": "he said "hi" to ' || event_type || '", "n": [' || CAST(event_id AS STRING) || ']}'
    WHEN 3 THEN ' [' || CAST(event_id AS STRING) || ', {"z": null}] '
    WHEN 4 THEN 'no } json { here ] of ' || event_type
    ELSE 'broken {"q": [1, 2}} then [3] and ```' || chr(10) || '{"left": "open"}' END AS reply FROM events)"""


@query(f"""
WITH {REPLIES.replace("AS STRING)", "AS VARCHAR)")}, told AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN ['{{"a": ' || event_id || ', "b": [1, {{"c": 2}}]}}', '{{"d": "x}}y"}}']
    WHEN 1 THEN ['{{"e": ' || event_id || '}}', '[1, 2]']
    WHEN 2 THEN ['{{"say": "he said \\"hi\\" to ' || event_type || '", "n": [' || event_id || ']}}']
    WHEN 3 THEN ['[' || event_id || ', {{"z": null}}]']
    WHEN 5 THEN ['{{"left": "open"}}', '[3]'] END AS v FROM events)
SELECT event_id, CAST(nth AS INTEGER) AS nth, v[nth] AS value FROM (SELECT event_id, v, unnest(range(1, len(v) + 1)) AS nth FROM told WHERE v IS NOT NULL)""")
def json_replies(spark, sf_dir):
    """Every JSON value of replies, in order: fenced blocks, balanced spans, the whole; repaired where quotes are left bare."""
    own = spark.sql(f"WITH {REPLIES.replace('{', '{{').replace('}', '}}').replace('FROM events', 'FROM {events}')} SELECT * FROM replies", events=table(spark, sf_dir, "events"))
    return own.select("event_id", F.posexplode(json_reply.json_values("reply")).alias("at", "value")).select("event_id", (F.col("at") + 1).alias("nth"), "value")


@query("""SELECT target, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS importers FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""")
def external_importers(spark, sf_dir):
    """Link targets with the pages that have them."""
    from loamline.operators.graph import importers

    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    return importers(links).select("target", F.array_join(F.transform("importers", lambda x: x.cast("string")), ",").alias("importers"))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def reason_histogram(spark, sf_dir):
    """Reasons of failures up to the colon, the five most frequent."""
    from loamline.operators.report import top_reasons

    parsed = table(spark, sf_dir, "events").select(F.lit("unparsed").alias("status"), F.concat("event_type", F.lit("："), F.col("user_id").cast("string")).alias("reason"))
    return top_reasons(repos.unparsed_reasons(parsed))


@query("""
SELECT event_type AS repo_id, user_id AS path, count(DISTINCT event_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 500 GROUP BY ALL""")
def churn(spark, sf_dir):
    """Commits per path among the last 500 (events of a kind as a repository's commits, users as paths)."""
    commits = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id"), F.col("event_id").alias("commit_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("path"))
    return repos.churn(commits)


@query(f"""
WITH {LINES}, s AS (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS n FROM lines WHERE len(l) > 0),
d AS (SELECT doc_id AS path, n AS start_line FROM s WHERE regexp_extract(line, '^([A-Za-z]+)', 1) = 'The')
SELECT CAST(path AS VARCHAR) AS path, CAST(start_line AS INTEGER) AS start_line, (SELECT count(*) FROM d) AS total FROM d ORDER BY 1, 2 LIMIT 12""")
def definition_lookup(spark, sf_dir):
    """Definitions of a name: lines of documents that begin with that word."""
    own = lookup.line_table(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "path")
    symbols = own.select("path", F.regexp_extract("content", "^([A-Za-z]+)", 1).alias("name"), F.col("line").alias("start_line")).withColumn("qualified_name", F.col("name"))
    return lookup.definitions(symbols, "The").select("path", "start_line", "total")


@query(f"""
WITH {LINES}, s AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(l) AS line, unnest(generate_series(1, len(l))) AS n FROM lines WHERE len(l) > 0),
def AS (SELECT DISTINCT path FROM s WHERE regexp_extract(line, '^([A-Za-z]+)', 1) = 'Thing'),
usr AS (SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS path FROM documents d JOIN documents e ON e.source = d.source AND CAST(e.doc_id AS VARCHAR) IN (SELECT path FROM def) AND e.doc_id <> d.doc_id),
f AS (SELECT path, 0 AS far FROM def UNION ALL SELECT path, 1 FROM usr WHERE path NOT IN (SELECT path FROM def) ORDER BY far, path LIMIT 40)
SELECT s.path, CAST(n AS INTEGER) AS line, left(trim(line, ' '), 100) AS content FROM s JOIN f ON f.path = s.path WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])Thing($|[^A-Za-z0-9_])') ORDER BY far, s.path, n LIMIT 30""")
def reference_lookup(spark, sf_dir):
    """Lines that name a symbol, its defining documents first, then others of their source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "source", "text")
    symbols = lookup.line_table(docs, "path").select("path", F.regexp_extract("content", "^([A-Za-z]+)", 1).alias("name")).withColumn("qualified_name", F.col("name"))
    defined = symbols.where("name = 'Thing'").select(F.col("path").alias("dst")).distinct()
    own = docs.select(F.col("path").alias("dst"), "source").join(defined, "dst", "left_semi")
    # A document refers to the first and the last defining one of its source, one of which is another.
    ends = own.groupBy("source").agg(F.array_distinct(F.array(F.min("dst"), F.max("dst"))).alias("ends"))
    edges = docs.select(F.col("path").alias("src"), "source").join(ends, "source").select("src", F.explode("ends").alias("dst")).where("src <> dst")
    return lookup.references(symbols, edges, docs.select("path", "text"), "Thing")


@query("""
WITH w AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-z_./\\-]+'), lambda x: regexp_replace(regexp_replace(x, '^[./]+', ''), '[.]+$', '')))) AS word FROM benchmark),
f AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS path FROM part UNION SELECT DISTINCT lower(left(event_type, 2)) FROM events UNION SELECT 'src/' || c FROM (SELECT unnest(['the', 'that', 'with', 'and', 'in', 'que', 'la']) AS c))
SELECT DISTINCT item_id, f.path FROM w JOIN f ON f.path = w.word OR regexp_extract(f.path, '([^/]*)$', 1) = w.word""")
def cited_paths(spark, sf_dir):
    """Files that benchmark items name, in full or by a name that only one file has."""
    files = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("path")).union(table(spark, sf_dir, "events").select(F.lower(F.substring("event_type", 1, 2)))).distinct()
    files = files.union(spark.createDataFrame([(f"src/{c}",) for c in ("the", "that", "with", "and", "in", "que", "la")], "path string"))
    return lookup.cited_paths(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), files).select(F.col("id").alias("item_id"), "path")
