"""Import resolution by joins.

Every import is expanded into candidate stems with a priority. Candidates meet
the files by an equi-join on the stem, and the first priority with a hit wins.
Matching a module against the end of a path becomes an equi-join as well, on
every suffix of a stem. The outcome of an import is resolved, external or
unresolved.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import paths
from loamline.functions.joins import exchanged
from loamline.operators.entrypoints import without_comments

def stem_index(files: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``stem``, ``path`` of each repository; of files with one stem the first suffix in order."""
    own = files.select(*by, "path", paths.stem(F.col("path")).alias("stem"), paths.stem_rank(F.col("path")).alias("rank")).where("stem is not null")
    return own.groupBy(*by, "stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def stem_suffixes(stems: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Every ending of every stem at a slash, with the shortest path (then the first) that has it."""
    parts = F.split("stem", "/")
    n = F.size(parts)
    ends = stems.select(*by, "path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))).alias("ending"))
    return ends.groupBy(*by, "ending").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("path"))


def _joined(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))


def resolve_python(imports: DataFrame, files: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Outcome of Python imports.

    ``imports``: ``by``, ``path``, ``line``, ``target`` (dots for relative),
    ``names``, ``scope``. Out: the same with ``outcome`` and ``dst`` (null
    unless resolved). Order of trial: the module's file; the package's file,
    and instead of it the files of the package that the import names, which can
    give several rows; for absolute targets a file whose path ends with the
    module or with its package file, the shortest path first. What follows
    depends on path, target and names alone, so each such triple is asked once.
    """
    k = list(by)
    key = [*k, "path", "target", "__names"]
    stems = stem_index(files, by)
    own = imports.withColumn("__names", F.coalesce("names", F.array().cast("array<string>")))
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    tail = F.regexp_replace(F.substring("target", dots + 1, F.length("target")), r"\.", "/")
    here = F.split(paths.parent(F.col("path")), "/")
    up = F.array_join(F.slice(here, F.lit(1), F.greatest(F.size(here) - (dots - 1), F.lit(0))), "/")
    asked = own.select(*key).distinct().withColumns({"relative": dots > 0, "base": F.when(dots > 0, _joined(up, tail)).otherwise(tail)})
    package = _joined(F.col("base"), F.lit("__init__"))
    candidates = F.concat(
        F.array(F.struct(F.lit("module").alias("as"), F.col("base").alias("stem")), F.struct(F.lit("package").alias("as"), package.alias("stem"))),
        F.transform(F.filter("__names", lambda x: x != "*"), lambda x: F.struct(F.lit("member").alias("as"), _joined(F.col("base"), x).alias("stem"))),
    )
    tried = asked.select(*key, F.explode(candidates).alias("c")).select(*key, "c.*")
    found = tried.join(exchanged(stems.withColumnRenamed("path", "dst")), [*k, "stem"])

    def hits(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("as") == kind, F.col("dst"))))

    found = found.groupBy(*key).agg(hits("module").alias("module"), hits("package").alias("package"), hits("member").alias("members"))
    inside = F.when(F.size("members") > 0, F.col("members")).otherwise(F.col("package"))
    direct = found.select(*key, F.when(F.size("module") > 0, F.col("module")).when(F.size("package") > 0, inside).alias("dsts")).where("dsts is not null")
    absolute = asked.where("not relative").join(exchanged(direct.select(*key)), key, "left_anti").select(*key, F.explode(F.array("base", package)).alias("ending"))
    by_end = absolute.join(exchanged(stem_suffixes(stems, by).withColumnRenamed("path", "dst")), [*k, "ending"])
    by_end = by_end.groupBy(*key).agg(F.array(F.min_by("dst", F.struct(F.length("dst"), F.col("dst")))).alias("dsts"))
    out = own.join(exchanged(direct.unionByName(by_end)), key, "left").withColumn("dst", F.explode_outer("dsts"))
    outcome = F.when(F.col("dst").isNotNull(), "resolved").when(F.col("target").startswith("."), "unresolved").otherwise("external")
    return out.select(*imports.columns, "dst").withColumn("outcome", outcome)


def alias_targets(imports: DataFrame, aliases: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Add ``aliased``: the paths that the alias of the longest matching head (the first of equals) rewrites the target to, in order; null for none.

    ``aliases``: ``by``, ``pattern`` (exact or with one ``*``), ``seq`` (order
    of patterns), ``replacement``, ``nth`` (order of a pattern's replacements),
    ``base_url`` (what replacements are relative to, may be null): a compiler
    configuration's few lines, after its own entries have replaced those it
    inherits. Each target of a repository is rewritten once.
    """
    k = list(by)
    asked = imports.select(*k, "target").where("not startswith(target, '.')").distinct()
    head, last = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    wild = F.col("pattern").contains("*")
    fits = F.when(wild, F.col("target").startswith(head) & F.col("target").endswith(last) & (F.length("target") >= F.length(head) + F.length(last))).otherwise(F.col("target") == F.col("pattern"))
    star = F.expr("substring(target, length(substring_index(pattern, '*', 1)) + 1, length(target) - length(pattern) + 1)")
    put = F.when(wild, F.replace(F.col("replacement"), F.lit("*"), star)).otherwise(F.col("replacement"))
    path = paths.normalise(_joined(F.coalesce("base_url", F.lit("")), put))
    hit = asked.join(aliases, k).where(fits).select(*k, "target", "seq", F.length(head).alias("fixed"), F.struct("nth", path.alias("path")).alias("to"))
    of_pattern = hit.groupBy(*k, "target", "fixed", "seq").agg(F.sort_array(F.collect_list("to")).alias("to"))
    best = of_pattern.groupBy(*k, "target").agg(F.max_by("to", F.struct("fixed", -F.col("seq"))).alias("to"))
    return imports.join(best.select(*k, "target", F.col("to.path").alias("aliased")), [*k, "target"], "left")


def inherited_aliases(configs: DataFrame, depth: int = 4) -> DataFrame:
    """Aliases of every configuration with those of the ones it extends, at most ``depth`` up.

    A pattern of its own replaces all targets of an inherited one; the base URL
    is the nearest. ``configs``: ``repo_id``, ``config``, ``extends``,
    ``base_url``, ``pattern``, ``replacement``, ``seq``, ``nth``; a
    configuration without aliases is a row with null ``pattern``. Out:
    ``repo_id``, ``config``, ``pattern``, ``replacement``, ``seq``, ``nth``,
    ``base_url``; a configuration with a base URL alone is such a row too.
    """
    chain = configs.select("repo_id", "config", F.col("config").alias("owner"), F.lit(0).alias("up")).distinct()
    parents = configs.where("extends is not null").select("repo_id", F.col("config").alias("owner"), "extends").distinct()
    every = chain
    for i in range(1, depth + 1):
        chain = chain.join(parents, ["repo_id", "owner"]).select("repo_id", "config", F.col("extends").alias("owner"), F.lit(i).alias("up"))
        every = every.union(chain)
    own = configs.select("repo_id", F.col("config").alias("owner"), "pattern", "replacement", "seq", "nth", F.when(F.col("base_url") != "", F.col("base_url")).alias("base_url"))
    found = every.join(own, ["repo_id", "owner"])
    base = found.where("base_url is not null").groupBy("repo_id", "config").agg(F.min_by("base_url", "up").alias("base_url"))
    near = F.min("up").over(Window.partitionBy("repo_id", "config", "pattern"))
    kept = found.withColumn("__near", near).where("up = __near").drop("base_url")
    # What is inherited comes before a configuration's own patterns.
    place = (F.lit(1000) * (depth - F.col("up")) + F.col("seq")).alias("seq")
    out = kept.join(base, ["repo_id", "config"], "left").where("pattern is not null or base_url is not null")
    return out.select("repo_id", "config", "pattern", "replacement", place, "nth", "base_url")


# Root files that may hold aliases, in order of trial.
CONFIGS = ["tsconfig.json", "tsconfig.base.json"]


def compiler_configs(files: DataFrame) -> DataFrame:
    """Rows of all files named like compiler configurations, for ``inherited_aliases``.

    ``files``: ``repo_id``, ``path``, ``text``. Comments and trailing commas
    are allowed; a file that can't be read gives no row. Only relative
    ``extends`` are followed, within the repository.
    """

    def rows(repo: str, path: str, text: str) -> list[tuple]:
        try:
            data = json.loads(without_comments(text))
        except (ValueError, RecursionError):
            return []
        options = data.get("compilerOptions") if isinstance(data, dict) else None
        options = options if isinstance(options, dict) else {}
        extends = data.get("extends") if isinstance(data, dict) else None
        start = (repo, path, extends if isinstance(extends, str) and extends.startswith(".") else None, str(options.get("baseUrl") or "") or None)
        own = options.get("paths")
        own = [(p, t) for p, t in own.items() if isinstance(t, list)] if isinstance(own, dict) else []
        return [(*start, p, str(t), seq, nth) for seq, (p, targets) in enumerate(own) for nth, t in enumerate(targets)] or [(*start, None, None, 0, 0)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [r for repo, path, text in zip(part["repo_id"], part["path"], part["text"]) for r in rows(repo, path, text or "")]
            yield pd.DataFrame(found, columns=["repo_id", "config", "extends", "base_url", "pattern", "replacement", "seq", "nth"])

    named = paths.file_name(F.col("path")).rlike(r"^tsconfig.*\.json$")
    schema = "repo_id string, config string, extends string, base_url string, pattern string, replacement string, seq int, nth int"
    found = files.where(named).select("repo_id", "path", "text").mapInPandas(run, schema)
    parent = paths.normalise(_joined(paths.parent(F.col("config")), F.col("extends")))
    with_suffix = F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json")))
    return found.withColumn("extends", F.when(parent != "", with_suffix))


def repository_aliases(files: DataFrame) -> DataFrame:
    """The aliases that count in each repository: those of the first of CONFIGS with any, or with a base URL."""
    every = inherited_aliases(compiler_configs(files)).where(F.col("config").isin(CONFIGS))
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIGS]), F.col("config"))
    first = F.min(rank).over(Window.partitionBy("repo_id"))
    return every.withColumns({"__rank": rank, "__first": first}).where("__rank = __first and pattern is not null").drop("config", "__rank", "__first")


def resolve_typescript(imports: DataFrame, files: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Outcome of TypeScript imports, as ``resolve_python``; ``aliased`` (see ``alias_targets``) may be there.

    A relative target has one candidate, an aliased one those of its alias in
    order. Each is tried as the exact path, as a stem, as a stem without a
    JavaScript suffix, and as a directory with an ``index``, before the next
    one is; the first hit wins. A miss is unresolved for relative and aliased
    targets, external for all others.
    """
    k = list(by)
    key = [*k, "path", "target"]
    own = imports if "aliased" in imports.columns else imports.withColumn("aliased", F.lit(None).cast("array<string>"))
    relative = F.col("target").startswith(".")
    bases = F.when(relative, F.array(paths.normalise(_joined(paths.parent(F.col("path")), F.col("target"))))).otherwise(F.col("aliased"))
    asked = own.select(*key, F.posexplode(bases).alias("nth", "base")).where("base <> ''").distinct()
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    steps = F.array(*[F.struct(F.lit(i).alias("step"), stem.alias("stem")) for i, stem in ((1, F.col("base")), (2, bare), (3, F.concat("base", F.lit("/index"))))])
    exact = asked.join(files.select(*k, F.col("path").alias("base")), [*k, "base"]).select(*key, "nth", F.lit(0).alias("step"), F.col("base").alias("dst"))
    stems = stem_index(files, by).withColumnRenamed("path", "dst")
    tried = asked.select(*key, "nth", F.explode(steps).alias("s")).select(*key, "nth", "s.*").join(stems, [*k, "stem"]).select(*key, "nth", "step", "dst")
    best = exact.union(tried).groupBy(*key).agg(F.min_by("dst", F.struct("nth", "step")).alias("dst"))
    outcome = F.when(F.col("dst").isNotNull(), "resolved").when(relative | F.col("aliased").isNotNull(), "unresolved").otherwise("external")
    return own.join(best, key, "left").withColumn("outcome", outcome)


def graph_tables(resolved: DataFrame, with_types: bool = True, by: Sequence[str] = ("repo_id",)) -> dict[str, DataFrame]:
    """``edges``, ``external`` and ``unresolved`` of resolved imports (``kind``, ``scope``)."""
    k = list(by)
    used = resolved if with_types else resolved.where("kind <> 'type_only'")
    links = used.where("outcome = 'resolved' and path <> dst").select(*k, F.col("path").alias("src"), "dst", (F.col("scope") == "module").alias("at_import_time"))
    edges = links.groupBy(*k, "src", "dst").agg(F.bool_or("at_import_time").alias("at_import_time"))
    external = used.where("outcome = 'external'").groupBy(*k, "target").agg(F.sort_array(F.collect_set("path")).alias("importers"))
    missing = used.where("outcome = 'unresolved'").select(*k, "target", "path", "line", F.lit("relative target not found").alias("reason"))
    return {"edges": edges, "external": external, "unresolved": missing}
