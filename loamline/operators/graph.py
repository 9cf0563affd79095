"""Dependency graphs: edges, roots, PageRank, components, cycles.

Edges are ``src``, ``dst`` (and ``at_import_time``), nodes one id column; every
table may carry group columns such as ``repo_id`` in ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.joins import exchanged

DAMPING, ROUNDS = 0.85, 30


def build_edges(imports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct edges without loops; at import time if any of the supporting imports is."""
    return imports.where("src <> dst").groupBy(*by, "src", "dst").agg(F.bool_or("at_import_time").alias("at_import_time"))


def importers(external: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """External targets with their importing files, sorted."""
    return external.groupBy(*by, "target").agg(F.sort_array(F.collect_set("path")).alias("importers"))


def reverse_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*by, F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"))


def zero_indegree(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None, node: str = "node") -> DataFrame:
    """Nodes that nothing refers to and that are no entry points."""
    out = nodes.join(edges, nodes[node] == edges.dst, "left_anti")
    return out if entry_points is None else out.join(entry_points.select(node), node, "left_anti")


def graph_roots(edges: DataFrame, n: int = 10) -> DataFrame:
    """Nodes with outgoing and no incoming edges: the ``n`` of most outgoing edges, ties by node."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    return out.join(edges, out.node == edges.dst, "left_anti").orderBy(F.desc("out_degree"), "node").limit(n)


def degrade(files: DataFrame, directory: str, most: int, by: Sequence[str]) -> DataFrame:
    """Nodes of the groups' graphs: files, or directories without edges in groups of more than ``most`` files."""
    n = files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"))
    out = files.join(n, list(by))
    node = F.when(F.col("n_files") > most, F.col(directory)).otherwise(F.col("path"))
    return out.select(*by, node.alias("node"), F.when(F.col("n_files") > most, "directory").otherwise("file").alias("granularity")).distinct()


#: Rounds that one plan does; then the powers so far are written, which cuts the lineage.
ROUNDS_A_PLAN = 10


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``node``, ``score`` after exactly ``rounds`` rounds from equal shares; dangling nodes spread over all.

    Repeated edges count once. Every round is one join of the links with what
    the nodes hold and one sum, whatever the size; the rounds of a plan share
    one exchange of the links by source, so a round exchanges only sums. What damping and
    dangling nodes add is the same for all nodes, so scores are sums of the
    powers A^j 1 of the links with one factor each, which follow from the
    powers' sums (a row a round); the rounds themselves need no sum over all
    nodes. Powers are checkpointed a few at a time.
    """
    edges = edges.select("src", "dst").distinct()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = edges.join(out, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")).checkpoint()
    ends = links.select(F.col("src").alias("node")).union(links.select("dst"))
    last = (ends if nodes is None else nodes.select("node")).distinct().select("node", F.lit(1.0).alias("held"), F.lit(0).alias("power")).checkpoint()
    n = last.count()
    powers = [last]
    for first in range(1, rounds + 1, ROUNDS_A_PLAN):
        some = []
        for i in range(first, min(first + ROUNDS_A_PLAN, rounds + 1)):
            last = links.join(last, links.src == last.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("held") * F.col("share")).alias("held")).withColumn("power", F.lit(i))
            some.append(last)
        written = some[0]
        for s in some[1:]:
            written = written.union(s)
        written = written.checkpoint()
        powers.append(written)
        last = written.where(F.col("power") == min(first + ROUNDS_A_PLAN - 1, rounds))
    every = powers[0]
    for p in powers[1:]:
        every = every.union(p)
    sums = {r.power: r.total for r in every.groupBy("power").agg(F.sum("held").alias("total")).collect()}
    factors = [1.0 / max(n, 1)]
    for _ in range(rounds):
        carried = sum(f * sums.get(j + 1, 0.0) for j, f in enumerate(factors))
        factors = [((1 - damping) + damping * (1 - carried)) / max(n, 1), *[damping * f for f in factors]]
    factor = F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("power") + 1)
    return every.groupBy("node").agg(F.sum(F.col("held") * factor).alias("score"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Undirected components: ``node``, ``component`` (its smallest node). Needs a checkpoint folder."""
    ends = edges.select("src", "dst").where("src <> dst")
    both = ends.union(ends.select("dst", "src")).distinct().checkpoint()
    nodes = (both.select(F.col("src").alias("node")) if nodes is None else nodes.select("node")).distinct()
    low = both.groupBy("src").agg(F.min("dst").alias("low"))
    label = nodes.join(low, nodes.node == low.src, "left").select("node", F.least("node", F.coalesce("low", "node")).alias("component")).checkpoint()
    while True:
        heard = both.join(label, both.src == label.node).groupBy("dst").agg(F.min("component").alias("heard"))
        near = label.join(heard, label.node == heard.dst, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        root = near.select(F.col("node").alias("root"), F.col("component").alias("higher"))
        new = near.join(root, near.component == root.root).select("node", "old", F.least("component", "higher").alias("component")).checkpoint()
        label = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return label


def short_cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """All simple cycles of 2 to ``most`` nodes, each once, from its smallest node: ``members`` joined by ``>``, ``length``, ``import_time``.

    A cycle is at import time only if every edge is, the closing one included.
    Paths of length n cost edges * mean degree ** (n - 1) rows.
    """
    e = edges.select("src", "dst", "at_import_time")
    paths = e.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"), F.col("at_import_time").alias("all_time"))
    found = None
    back = e.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.col("at_import_time").alias("t"))
    for length in range(2, most + 1):
        closed = paths.join(back, (F.col("last") == F.col("b")) & (F.col("first") == F.col("a")))
        closed = closed.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("members"), F.lit(length).alias("length"), (F.col("all_time") & F.col("t")).alias("import_time"))
        found = closed if found is None else found.union(closed)
        if length < most:
            step = e.select(F.col("src").alias("b"), F.col("dst").alias("next"), F.col("at_import_time").alias("t"))
            paths = paths.join(step, F.col("last") == F.col("b")).where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
            paths = paths.select("first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"), (F.col("all_time") & F.col("t")).alias("all_time"))
    return found


def back_edge_cycles(adjacency: dict) -> list[tuple]:
    """Cycles that a depth-first search from nodes and neighbours in order closes by its back edges, turned to start at their smallest member; sorted."""
    found, state = set(), {}
    for start in sorted(adjacency):
        if start in state:
            continue
        trail, at = [start], [iter(sorted(adjacency[start]))]
        state[start] = 1
        while trail:
            step = next(at[-1], None)
            if step is None:
                state[trail.pop()] = 2
                at.pop()
            elif state.get(step) == 1:
                ring = trail[trail.index(step) :]
                low = ring.index(min(ring))
                found.add(tuple(ring[low:] + ring[:low]))
            elif step not in state and step in adjacency:
                state[step] = 1
                trail.append(step)
                at.append(iter(sorted(adjacency[step])))
    return sorted(found)


def _trimmed(edges: DataFrame, k: list[str]) -> DataFrame:
    """``edges`` without those of nodes that nothing leads to, or that lead nowhere, until none is left: no cycle passes there."""
    n = edges.count()
    while n:
        into, out = edges.select(*k, F.col("dst").alias("src")).distinct(), edges.select(*k, F.col("src").alias("dst")).distinct()
        edges = edges.join(exchanged(into), [*k, "src"], "left_semi").join(exchanged(out), [*k, "dst"], "left_semi").select(*k, "src", "dst").checkpoint()
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def strongly_connected(adjacency: dict) -> list[tuple]:
    """Nodes of strongly connected components of several nodes, each with the smallest of its component (Tarjan's search, without recursion)."""
    found, number, low, open_, waiting = [], {}, {}, set(), []
    for start in adjacency:
        if start in number:
            continue
        trail = [(start, iter(adjacency[start]))]
        number[start] = low[start] = len(number)
        open_.add(start)
        waiting.append(start)
        while trail:
            node, steps = trail[-1]
            step = next(steps, None)
            if step is None:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == number[node]:
                    at = len(waiting) - 1
                    while waiting[at] != node:
                        at -= 1
                    own, waiting[at:] = waiting[at:], []
                    open_.difference_update(own)
                    if len(own) > 1:
                        least = min(own)
                        found += [(x, least) for x in own]
            elif step not in number:
                if step in adjacency:
                    number[step] = low[step] = len(number)
                    open_.add(step)
                    waiting.append(step)
                    trail.append((step, iter(adjacency[step])))
            elif step in open_:
                low[node] = min(low[node], number[step])
    return found


#: Edges up to which one task searches a group whole.
MOST_IN_A_TASK = 100_000


def strong_components(edges: DataFrame, by: Sequence[str] = (), most: int = MOST_IN_A_TASK) -> DataFrame:
    """Nodes on cycles: ``by``, ``node``, ``component`` (the smallest node of its strongly connected component).

    A group of at most ``most`` edges is searched by one task. The larger ones,
    and a table without groups, go together through joins: nodes that no cycle
    can pass are trimmed. Then every node is coloured by the smallest node that
    leads to it; a colour's root and the nodes of the colour that lead back to
    it are one component. What is left is treated alike. Every step is joins
    and sums over all edges left, and written to the checkpoint folder; the
    number of steps follows from the longest shortest paths, not from the
    number of nodes, and each costs the driver memory for its plan.
    """
    k = list(by)
    left = edges.select(*k, "src", "dst").where("src <> dst").distinct().checkpoint()
    found = edges.select(*k, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    if k:
        left = left.dropna(subset=k)
        # At most one group for every ``most`` edges.
        large = left.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*k).checkpoint()
        small = left if large.isEmpty() else left.join(F.broadcast(large), k, "left_anti")

        def run(table: pd.DataFrame) -> pd.DataFrame:
            adjacency: dict = {x: [] for x in table["src"]}
            for s, d in zip(table["src"], table["dst"]):
                adjacency[s].append(d)
            rows = strongly_connected(adjacency)
            return pd.DataFrame([(*table[k].iloc[0], *r) for r in rows], columns=[*k, "node", "component"])

        found = small.groupBy(*k).applyInPandas(run, found.schema).checkpoint()
        if large.isEmpty():
            return found
        left = left.join(F.broadcast(large), k, "left_semi")
    while True:
        left = _trimmed(left, k)
        if left.isEmpty():
            return found
        colour = left.select(*k, F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")).checkpoint()
        while True:
            heard = left.join(exchanged(colour.withColumnRenamed("node", "src")), [*k, "src"]).groupBy(*k, F.col("dst").alias("node")).agg(F.min("colour").alias("heard"))
            step = colour.join(exchanged(heard), [*k, "node"], "left").select(*k, "node", F.col("colour").alias("old"), F.least("colour", "heard").alias("colour")).checkpoint()
            colour = step.drop("old")
            if step.where("colour < old").isEmpty():
                break
        inside = left.join(exchanged(colour.withColumnRenamed("node", "src")), [*k, "src"]).join(exchanged(colour.select(*k, F.col("node").alias("dst"), F.col("colour").alias("of"))), [*k, "dst"]).where("colour = of").select(*k, "src", "dst").checkpoint()
        back = edge = colour.where("node = colour").checkpoint()
        while True:
            more = inside.join(exchanged(edge.withColumnRenamed("node", "dst")), [*k, "dst"]).select(*k, F.col("src").alias("node"), "colour").distinct()
            edge = more.join(exchanged(back.select(*k, "node")), [*k, "node"], "left_anti").checkpoint()
            if edge.isEmpty():
                break
            back = back.union(edge).checkpoint()
        several = back.groupBy(*k, "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.union(back.join(exchanged(several), [*k, "colour"], "left_semi").select(*k, "node", F.col("colour").alias("component"))).checkpoint()
        for end in ("src", "dst"):
            left = left.join(exchanged(back.select(*k, F.col("node").alias(end))), [*k, end], "left_anti")
        left = left.select(*k, "src", "dst").checkpoint()


def cycles(edges: DataFrame, by: str = "repo_id") -> DataFrame:
    """Cycles of each group's graph: ``members``, ``length``, ``import_time``.

    Of every strongly connected component those that a depth-first search from
    its smallest node closes by its back edges. A task holds one component's
    inner edges, or those of one small group. The edges are computed once.
    """
    edges = edges.select(by, "src", "dst", "at_import_time").checkpoint()
    of = strong_components(edges, [by])
    src = of.select(by, F.col("node").alias("src"), "component")
    dst = of.select(by, F.col("node").alias("dst"), F.col("component").alias("other"))
    inner = edges.join(exchanged(src), [by, "src"]).join(exchanged(dst), [by, "dst"]).where("component = other").select(by, "component", "src", "dst", "at_import_time")

    def run(table: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict = {x: set() for x in table["src"]}
        early = set()
        for s, d, t in zip(table["src"], table["dst"], table["at_import_time"]):
            adjacency[s].add(d)
            if t:
                early.add((s, d))
        rings = back_edge_cycles(adjacency)
        whole = [all(e in early for e in zip(r, r[1:] + r[:1])) for r in rings]
        rows = [(table[by].iloc[0], [str(x) for x in r], len(r), w) for r, w in zip(rings, whole)]
        return pd.DataFrame(rows, columns=[by, "members", "length", "import_time"])

    kind = edges.schema[by].dataType.simpleString()
    return inner.groupBy(by, "component").applyInPandas(run, f"{by} {kind}, members array<string>, length int, import_time boolean")


def neighbours(edges: DataFrame, module_files: DataFrame) -> DataFrame:
    """Edges with exactly one end in each module: ``name``, ``src``, ``dst``."""
    m = module_files.select("name", "path")
    src = edges.join(m, edges.src == m.path).select("name", "src", "dst")
    dst = edges.join(m, edges.dst == m.path).select("name", "src", "dst")
    return src.exceptAll(dst).union(dst.exceptAll(src))


def dependencies(edges: DataFrame, path: str, most: int = 30) -> DataFrame:
    """What a file imports and what imports it, at most ``most`` each: ``direction``, ``other``."""
    out = edges.where(F.col("src") == path).select(F.lit("imports").alias("direction"), F.col("dst").alias("other"))
    into = edges.where(F.col("dst") == path).select(F.lit("imported_by").alias("direction"), F.col("src").alias("other"))
    return out.orderBy("other").limit(most).union(into.orderBy("other").limit(most))


def overview(cycles: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The 5 longest cycles and the 10 largest modules."""
    text = F.array_join("members", ">")
    return cycles.orderBy(F.desc("length"), text).limit(5), modules.orderBy(F.desc("n_files"), "name").limit(10)


def out_rank(edges: DataFrame) -> DataFrame:
    """Edges numbered by target within their source."""
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
