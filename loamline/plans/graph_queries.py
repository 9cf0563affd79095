"""Graph operators over a stand-in for imports.

A customer is a file, a nation a module. On each day a customer's order refers
to the customer of the day's next order; urgent and high priorities are
imports at import time. Whole ``orders``, no sampling.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.operators import graph, modules
from loamline.plans.registry import query, table


def _checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder of this machine only for a local session that names none; on a cluster executors share no such folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and not sc.getConf().get("spark.checkpoint.dir"):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "loamline-checkpoints"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(day).alias("dst"), (F.col("o_orderpriority") < "3").alias("at_import_time"))
    return own.where("dst is not null")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(imports(spark, sf_dir))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("name"))


EDGES = """imports AS (
  SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS dst, o_orderpriority < '3' AS at_import_time
  FROM orders),
edges AS (SELECT src, dst, bool_or(at_import_time) AS at_import_time FROM imports WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
OWNED = EDGES + """,
files AS (SELECT c_custkey AS path, c_nationkey AS name FROM customer),
owned AS (SELECT e.src, e.dst, a.name AS src_module, b.name AS dst_module FROM edges e JOIN files a ON e.src = a.path JOIN files b ON e.dst = b.path)"""


@query(f"WITH {EDGES} SELECT src, dst, at_import_time FROM edges")
def edge_build(spark, sf_dir):
    """Edges from imports: distinct, without loops, at import time if any import is."""
    return edges(spark, sf_dir)


@query(f"WITH {EDGES} SELECT dst AS node, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS imported_by, count(*) AS n FROM edges GROUP BY dst")
def reverse_edges(spark, sf_dir):
    """Importers of every file."""
    out = graph.reverse_edges(edges(spark, sf_dir))
    return out.select("node", F.array_join(F.transform("imported_by", lambda x: x.cast("string")), ",").alias("imported_by"), F.size("imported_by").cast("long").alias("n"))


@query(f"WITH {EDGES} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM edges WHERE at_import_time) AND c_acctbal >= 0")
def zero_indegree(spark, sf_dir):
    """Files that nothing imports at import time and that are no entry points (here: customers in debt)."""
    customer = table(spark, sf_dir, "customer")
    return graph.zero_indegree(customer.select(F.col("c_custkey").alias("node")), edges(spark, sf_dir).where("at_import_time"), customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("node")))


@query("""
WITH pairs AS (SELECT DISTINCT o_custkey AS src, -1 - l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT src AS node, count(*) AS out_degree FROM pairs WHERE src NOT IN (SELECT dst FROM pairs) GROUP BY src ORDER BY out_degree DESC, node LIMIT 10""")
def graph_roots(spark, sf_dir):
    """The ten files of most imports that nothing imports: customers over the suppliers they bought from."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()
    return graph.graph_roots(pairs)


@query(f"""
WITH RECURSIVE {EDGES},
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
degree AS (SELECT n.node, count(e.dst) AS d FROM nodes n LEFT JOIN edges e ON e.src = n.node GROUP BY n.node),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
rank AS (
  SELECT 0 AS i, node, 1.0::DOUBLE / n AS score FROM nodes, size
  UNION ALL
  SELECT i, node, score FROM (
    SELECT r.i + 1 AS i, t.node,
           0.15::DOUBLE / any_value(s.n) + 0.85::DOUBLE * (sum(CASE WHEN e.src IS NOT NULL THEN r.score / d.d ELSE 0 END) + sum(CASE WHEN d.d = 0 AND r.node = t.node THEN 0 ELSE 0 END)
           + any_value(lost.l) / any_value(s.n)) AS score
    FROM nodes t CROSS JOIN size s
    CROSS JOIN (SELECT coalesce(sum(CASE WHEN d.d = 0 THEN r.score ELSE 0 END), 0) AS l FROM rank r JOIN degree d ON d.node = r.node) lost
    LEFT JOIN edges e ON e.dst = t.node
    JOIN rank r ON r.node = coalesce(e.src, t.node)
    JOIN degree d ON d.node = r.node
    WHERE r.i < 30
    GROUP BY r.i, t.node))
SELECT node, round(score, 9) AS score FROM rank WHERE i = 30""")
def pagerank(spark, sf_dir):
    """PageRank of files after 30 rounds."""
    _checkpoints(spark)
    return graph.pagerank(edges(spark, sf_dir)).select("node", F.round("score", 9).alias("score"))


CYCLES = """two AS (SELECT a.src AS x, a.dst AS y, a.at_import_time AND b.at_import_time AS t FROM edges a JOIN edges b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst),
three AS (
  SELECT a.src AS x, a.dst AS y, b.dst AS z, a.at_import_time AND b.at_import_time AND c.at_import_time AS t
  FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst)"""


@query(f"""
WITH {EDGES}, {CYCLES}
SELECT x || '>' || y AS members, 2 AS length, t AS import_time FROM two
UNION ALL SELECT x || '>' || y || '>' || z, 3, t FROM three""")
def cycles_bounded(spark, sf_dir):
    """All cycles of two and three files, and whether they are at import time."""
    return graph.short_cycles(edges(spark, sf_dir), 3)


@query(f"""
WITH RECURSIVE {EDGES},
sides AS (SELECT src, dst FROM edges WHERE at_import_time UNION SELECT dst, src FROM edges WHERE at_import_time),
reach AS (SELECT DISTINCT src AS node, src AS seen FROM sides UNION SELECT r.node, s.dst FROM reach r JOIN sides s ON s.src = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def components(spark, sf_dir):
    """Undirected components of the graph at import time."""
    _checkpoints(spark)
    return graph.components(edges(spark, sf_dir).where("at_import_time"))


@query(f"WITH {OWNED} SELECT src_module, dst_module, count(*) AS n_edges FROM owned WHERE src_module <> dst_module GROUP BY ALL")
def module_edges(spark, sf_dir):
    """Edges between modules."""
    return modules.module_edges(modules.owned_edges(edges(spark, sf_dir), owners(spark, sf_dir)))


@query(f"""
WITH {OWNED}, ends AS (SELECT src_module AS name, src_module = dst_module AS inside FROM owned UNION ALL SELECT dst_module, false FROM owned WHERE src_module <> dst_module),
totals AS (SELECT name, count(*) FILTER (inside) AS i, count(*) FILTER (NOT inside) AS e FROM ends GROUP BY name)
SELECT f.name, count(*) AS n_files, coalesce(any_value(i), 0) AS internal_edges, coalesce(any_value(e), 0) AS external_edges FROM files f LEFT JOIN totals t ON t.name = f.name GROUP BY f.name""")
def module_totals(spark, sf_dir):
    """Size, internal and external edges of every module."""
    return modules.module_table(owners(spark, sf_dir), edges(spark, sf_dir))


@query(f"""
WITH {OWNED}, n AS (SELECT name, count(*) AS n FROM files GROUP BY name),
pairs AS (SELECT DISTINCT least(src_module, dst_module) AS a, greatest(src_module, dst_module) AS b, least(src, dst) AS x, greatest(src, dst) AS y FROM owned WHERE src_module <> dst_module)
SELECT a, b, count(*) AS pairs, round(count(*) / (any_value(na.n) * any_value(nb.n)), 9) AS density FROM pairs JOIN n na ON na.name = a JOIN n nb ON nb.name = b GROUP BY a, b""")
def coupling(spark, sf_dir):
    """Coupling density of module pairs."""
    f = owners(spark, sf_dir)
    return modules.coupling(modules.owned_edges(edges(spark, sf_dir), f), f).withColumn("density", F.round("density", 9))


LAYERS = OWNED + """,
pairs AS (SELECT least(src_module, dst_module) AS a, greatest(src_module, dst_module) AS b, count(*) FILTER (src_module < dst_module) AS forward, count(*) FILTER (src_module > dst_module) AS backward
          FROM owned WHERE src_module <> dst_module GROUP BY 1, 2),
layers AS (SELECT *, least(forward, backward) AS minority, least(forward, backward) / (forward + backward) AS share, CASE WHEN forward <= backward THEN 'forward' ELSE 'backward' END AS against FROM pairs
           WHERE forward + backward >= 4 AND least(forward, backward) > 0 AND least(forward, backward) / (forward + backward) < 0.3)"""


@query(f"WITH {LAYERS} SELECT a, b, forward, backward, minority, round(share, 9) AS share, against FROM layers")
def layering(spark, sf_dir):
    """Module pairs with a few edges against their direction (share under 0.3: this graph has hardly any below 0.2)."""
    return modules.layering(modules.owned_edges(edges(spark, sf_dir), owners(spark, sf_dir)), share=0.3).withColumn("share", F.round("share", 9))


@query(f"""
WITH {LAYERS}, {CYCLES}
SELECT 'structure' AS category, 'oversized_module' AS kind, CAST(name AS VARCHAR) AS path, n || ' files in one module' AS message, 'low' AS severity FROM (SELECT name, count(*) AS n FROM files GROUP BY name) WHERE n > 40
UNION ALL SELECT 'structure', 'import_cycle', CAST(x AS VARCHAR), x || ' -> ' || y, 'medium' FROM two WHERE t
UNION ALL SELECT 'structure', 'import_cycle', CAST(x AS VARCHAR), x || ' -> ' || y || ' -> ' || z, 'medium' FROM three WHERE t
UNION ALL SELECT 'structure', 'layering', a || ' / ' || b, minority || ' edges against the usual direction', 'medium' FROM layers""")
def structural_findings(spark, sf_dir):
    """Oversized modules, cycles at import time and edges against a layering as findings."""
    e, own = edges(spark, sf_dir), owners(spark, sf_dir)
    sizes = own.groupBy(F.col("name").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n_files"))
    rings = graph.short_cycles(e, 3).withColumn("members", F.split("members", ">"))
    return modules.structural_findings(sizes, rings, modules.layering(modules.owned_edges(e, own), share=0.3))


@query(f"WITH {LAYERS} SELECT o.src, o.dst, o.src_module, o.dst_module FROM owned o JOIN layers l ON l.a = least(src_module, dst_module) AND l.b = greatest(src_module, dst_module) AND (src_module < dst_module) = (l.against = 'forward') WHERE src_module <> dst_module")
def layering_edges(spark, sf_dir):
    """The edges against the direction."""
    owned = modules.owned_edges(edges(spark, sf_dir), owners(spark, sf_dir))
    return modules.minority_edges(owned, modules.layering(owned, share=0.3))


@query(f"""
WITH {OWNED}, slice AS (SELECT src_module AS name, src, dst FROM owned WHERE src_module <> dst_module UNION ALL SELECT dst_module, src, dst FROM owned WHERE src_module <> dst_module)
SELECT name, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM slice GROUP BY name""")
def neighbour_slice(spark, sf_dir):
    """Edges with one end in a module."""
    return graph.neighbours(edges(spark, sf_dir), owners(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"""
WITH {EDGES}
SELECT 'imports' AS direction, dst AS other FROM (SELECT dst FROM edges WHERE src = 0 ORDER BY dst LIMIT 30)
UNION ALL SELECT 'imported_by', src FROM (SELECT src FROM edges WHERE dst = 0 ORDER BY src LIMIT 30)""")
def dependency_query(spark, sf_dir):
    """What one file imports and what imports it, at most 30 each."""
    return graph.dependencies(edges(spark, sf_dir), 0)


@query("SELECT c_nationkey AS name, count(*) AS n_files FROM customer GROUP BY 1 ORDER BY n_files DESC, name LIMIT 10")
def largest_modules(spark, sf_dir):
    """The ten largest modules of an overview."""
    none = spark.createDataFrame([], "members array<string>, length int")
    return graph.overview(none, owners(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n_files")))[1]


@query("""
SELECT DISTINCT n_regionkey AS repo, CASE WHEN f.n > 310 THEN 'nation ' || c_nationkey ELSE 'customer ' || c_custkey END AS node, CASE WHEN f.n > 310 THEN 'directory' ELSE 'file' END AS granularity
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT n_regionkey AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) f ON f.r = n_regionkey""")
def degraded_nodes(spark, sf_dir):
    """Regions as repositories: those of over 310 files degrade to directories."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    files = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("repo"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("dir"))
    return graph.degrade(files, "dir", 310, ["repo"])


@query(f"""
WITH {EDGES} SELECT src AS path, dst AS target FROM edges WHERE NOT at_import_time""")
def deferred_edges(spark, sf_dir):
    """Edges that no import at import time supports: all edges but those."""
    e = edges(spark, sf_dir)
    early = e.where("at_import_time").select(F.col("src").alias("path"), F.col("dst").alias("target"))
    return e.select(F.col("src").alias("path"), F.col("dst").alias("target")).exceptAll(early)
