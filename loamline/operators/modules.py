"""Modules over a file graph: ownership, coupling, layering, clustering."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of clustering and structural review.
SPLIT_FROM, SPLIT_KEEPS = 4, 2
MERGE_FROM, MERGE_ROUNDS = 0.4, 200
# Fixed value: how a merged name counts branches it doesn't list.
MORE_BRANCHES = "{} 个子目录"
OVERSIZED, LONG_CYCLE = 40, 4
LAYER_EDGES, LAYER_SHARE = 4, 0.2


def owned_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the modules of both ends: ``src``, ``dst``, ``src_module``, ``dst_module``. Ends without a module drop out."""
    a = files.select(F.col("path").alias("src"), F.col("name").alias("src_module"))
    b = files.select(F.col("path").alias("dst"), F.col("name").alias("dst_module"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")


def module_edges(owned: DataFrame) -> DataFrame:
    """Distinct directed edges between different modules, with their number of file edges."""
    return owned.where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n_edges"))


def edge_totals(owned: DataFrame) -> DataFrame:
    """Internal and external edges of each module; an edge between two modules is external to both."""
    inside = F.col("src_module") == F.col("dst_module")
    ends = owned.select(F.explode(F.when(inside, F.array("src_module")).otherwise(F.array("src_module", "dst_module"))).alias("name"), inside.alias("inside"))
    return ends.groupBy("name").agg(F.sum(F.col("inside").cast("long")).alias("internal_edges"), F.sum((~F.col("inside")).cast("long")).alias("external_edges"))


def coupling(owned: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct linked file pairs over the product of sizes, for each pair of modules with a link."""
    n = files.groupBy("name").agg(F.countDistinct("path").alias("n"))
    pairs = owned.where("src_module <> dst_module").select(F.least("src_module", "dst_module").alias("a"), F.greatest("src_module", "dst_module").alias("b"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    linked = pairs.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))
    na, nb = n.select(F.col("name").alias("a"), F.col("n").alias("na")), n.select(F.col("name").alias("b"), F.col("n").alias("nb"))
    return linked.join(na, "a").join(nb, "b").select("a", "b", "pairs", (F.col("pairs") / (F.col("na") * F.col("nb"))).alias("density"))


def layering(owned: DataFrame, least: int = LAYER_EDGES, share: float = LAYER_SHARE) -> DataFrame:
    """Pairs of modules with a clear direction and a few edges against it: at least ``least`` edges, minority above 0 and under ``share``."""
    between = owned.where("src_module <> dst_module")
    ahead = F.col("src_module") < F.col("dst_module")
    pairs = between.groupBy(F.least("src_module", "dst_module").alias("a"), F.greatest("src_module", "dst_module").alias("b")).agg(F.count_if(ahead).alias("forward"), F.count_if(~ahead).alias("backward"))
    few, all_ = F.least("forward", "backward"), F.col("forward") + F.col("backward")
    out = pairs.withColumns({"minority": few, "share": few / all_, "against": F.when(F.col("forward") <= F.col("backward"), "forward").otherwise("backward")})
    return out.where((all_ >= least) & (few > 0) & (F.col("share") < share))


def minority_edges(owned: DataFrame, found: DataFrame) -> DataFrame:
    """The file edges that go against the direction of the pairs of ``layering``."""
    ahead = F.col("src_module") < F.col("dst_module")
    e = owned.where("src_module <> dst_module").withColumns({"a": F.least("src_module", "dst_module"), "b": F.greatest("src_module", "dst_module"), "way": F.when(ahead, "forward").otherwise("backward")})
    return e.join(found.select("a", "b", F.col("against").alias("way")), ["a", "b", "way"]).select("src", "dst", "src_module", "dst_module")


def structural_findings(modules: DataFrame, cycles: DataFrame, layered: DataFrame) -> DataFrame:
    """``category``, ``kind``, ``path``, ``message``, ``severity``: oversized modules, import cycles, layering."""
    big = modules.where(F.col("n_files") > OVERSIZED).select(F.lit("oversized_module").alias("kind"), F.col("name").alias("path"), F.concat(F.col("n_files").cast("string"), F.lit(" files in one module")).alias("message"), F.lit("low").alias("severity"))
    rings = cycles.where("import_time").select(F.lit("import_cycle"), F.element_at("members", 1), F.array_join("members", " -> "), F.when(F.col("length") >= LONG_CYCLE, "high").otherwise("medium"))
    turned = layered.select(F.lit("layering"), F.concat_ws(" / ", F.col("a").cast("string"), F.col("b").cast("string")), F.concat(F.col("minority").cast("string"), F.lit(" edges against the usual direction")), F.lit("medium"))
    return big.union(rings).union(turned).select(F.lit("structure").alias("category"), "*")


def _directory(path: str) -> str:
    return path.rpartition("/")[0] or "<root>"


def _linked(paths: set[str], near: dict[str, set[str]]) -> list[list[str]]:
    """Components within ``paths``, by smallest member."""
    left, out = set(paths), []
    for p in sorted(paths):
        if p in left:
            left.discard(p)
            group, todo = [p], [p]
            while todo:
                for q in near.get(todo.pop(), ()):
                    if q in left:
                        left.discard(q)
                        group.append(q)
                        todo.append(q)
            out.append(sorted(group))
    return out


def split_scattered(groups: dict[str, list[str]], near: dict[str, set[str]]) -> list[tuple[str, str, list[str]]]:
    """(name, origin, files) after splitting directories whose files fall into several linked parts.

    Only from SPLIT_FROM files and with parts of SPLIT_KEEPS; where fragments
    outnumber those parts the directory stays whole, else they join the largest.
    """
    out = []
    for name in sorted(groups):
        files = sorted(groups[name])
        parts = _linked(set(files), near) if len(files) >= SPLIT_FROM else [files]
        kept = sorted((p for p in parts if len(p) >= SPLIT_KEEPS), key=lambda p: -len(p))
        loose = sorted(f for p in parts if len(p) < SPLIT_KEEPS for f in p)
        if len(parts) < 2 or not kept or len(loose) > sum(map(len, kept)) or len(kept) == 1:
            out.append((name, "directory", files))
            continue
        kept[0] = sorted(kept[0] + loose)
        out += [(f"{name}#{i}", "split", p) for i, p in enumerate(kept, 1)]
    return out


def _joined_name(left: str, right: str, files: Iterable[str]) -> str:
    """Common directory with the branches below it, or both names."""
    dirs = sorted({_directory(f) for f in files})
    parts = [d.split("/") for d in dirs]
    common = []
    for level in zip(*parts):
        if len(set(level)) > 1:
            break
        common.append(level[0])
    if not common or common == ["<root>"]:
        return f"{left}+{right}"
    branches = sorted({p[len(common)] for p in parts if len(p) > len(common)})
    if not branches:
        return "/".join(common)
    return "/".join(common) + "/{" + (",".join(branches) if len(branches) <= 3 else MORE_BRANCHES.format(len(branches))) + "}"


def merge_coupled(modules: list[tuple[str, str, list[str]]], edges: set[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """Greedily merge the pair of highest coupling density from MERGE_FROM on; the first of equals, the merged module last.

    Files are in one module each, so pair counts add up under a merge and need no recount.
    """
    owner = {f: i for i, (_, _, files) in enumerate(modules) for f in files}
    live = {i: m for i, m in enumerate(modules)}
    pairs: dict[tuple[int, int], set[tuple[str, str]]] = {}
    for s, d in edges:
        a, b = owner.get(s), owner.get(d)
        if a is not None and b is not None and a != b:
            pairs.setdefault((min(a, b), max(a, b)), set()).add((min(s, d), max(s, d)))
    count = {k: len(v) for k, v in pairs.items()}
    nxt = len(modules)
    for _ in range(MERGE_ROUNDS):
        best, at = 0.0, None
        for (a, b), n in sorted(count.items()):
            density = n / (len(live[a][2]) * len(live[b][2]))
            if density >= MERGE_FROM and density > best:
                best, at = density, (a, b)
        if at is None:
            break
        a, b = at
        files = sorted(live[a][2] + live[b][2])
        live[nxt] = (_joined_name(live[a][0], live[b][0], files), "merged", files)
        fresh: dict[tuple[int, int], int] = {}
        for (x, y), n in count.items():
            if (x, y) == at:
                continue
            k = tuple(sorted(nxt if z in at else z for z in (x, y)))
            fresh[k] = fresh.get(k, 0) + n
        del live[a], live[b]
        count, nxt = fresh, nxt + 1
    return [live[i] for i in sorted(live)]


def _unique(modules: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, list[str]]]:
    names = [m[0] for m in modules]
    return [(f"{n} [{min(f).rpartition('/')[2]}]" if names.count(n) > 1 else n, o, f) for n, o, f in modules]


def cluster_files(paths: Sequence[str], edges: set[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """Directory groups, split, merged, named uniquely, sorted by name."""
    groups: dict[str, list[str]] = {}
    near: dict[str, set[str]] = {}
    for p in paths:
        groups.setdefault(_directory(p), []).append(p)
    for s, d in edges:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    return sorted(_unique(merge_coupled(split_scattered(groups, near), edges)))


def cluster(files: DataFrame, edges: DataFrame, by: str = "repo_id") -> DataFrame:
    """Modules of every repository: ``by``, ``name``, ``origin``, ``path``, one row per file.

    Greedy merging is sequential within a repository and independent between
    them; the cogroup of a repository holds its paths and edges, not its texts.
    """

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({by: [], "name": [], "origin": [], "path": []})
        found = cluster_files(sorted(own["path"]), set(zip(links["src"], links["dst"])))
        rows = [(own[by].iloc[0], n, o, f) for n, o, files_ in found for f in files_]
        return pd.DataFrame(rows, columns=[by, "name", "origin", "path"])

    kind = files.schema[by].dataType.simpleString()
    return files.select(by, "path").groupBy(by).cogroup(edges.select(by, "src", "dst").groupBy(by)).applyInPandas(run, f"{by} {kind}, name string, origin string, path string")


def pair_matrix(owned: DataFrame) -> DataFrame:
    """Numbers of distinct linked file pairs for all pairs of modules: what a merge starts from."""
    return coupling(owned, owned.select(F.col("src").alias("path"), F.col("src_module").alias("name")).union(owned.select("dst", "dst_module")).distinct()).select("a", "b", "pairs")


def module_table(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules with their numbers of files and of internal and external edges."""
    n = files.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
    e = edge_totals(owned_edges(edges, files))
    return n.join(e, "name", "left").select("name", "n_files", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), F.coalesce("external_edges", F.lit(0)).alias("external_edges"))
