"""Entry points: manifests, naming conventions, graph roots."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import paths
from loamline.functions.joins import exchanged

# Names that mark entry points, and where manifests are looked for.
PYTHON_NAMES = ["__main__.py", "main.py", "app.py", "manage.py", "wsgi.py", "asgi.py"]
TS_STEMS = ["index", "main", "server", "app"]
MANIFEST_SKIPPED = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".tox"]
MANIFEST_DEPTH = 2
BUILD_DIRS = ["dist", "build", "lib", "out"]
STRENGTH = {"manifest": 0, "convention": 1, "graph_root": 2}
MOST_ROOTS = 10


def in_manifest_dirs(path: Column) -> Column:
    """Whether a manifest counts: at most two directories down, none of them skipped or hidden."""
    dirs = F.split(paths.parent(path), "/")
    return (F.size(dirs) <= MANIFEST_DEPTH) & ~paths.under_any(paths.parent(path), MANIFEST_SKIPPED) & ~F.exists(dirs, lambda d: d.startswith("."))


def typescript_candidates(target: Column) -> Column:
    """Source files that a manifest's target may stand for, in order of trial."""
    bare = F.regexp_replace(target, r"^[./]+", "")
    swapped = F.regexp_replace(bare, r"\.(js|mjs|cjs|jsx)$", "")
    js = bare.rlike(r"\.(js|mjs|cjs|jsx)$")
    with_ts = F.when(js, F.array(bare, F.concat(swapped, F.lit(".ts")), F.concat(swapped, F.lit(".tsx")))).otherwise(F.array(bare, F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit("/index.ts"))))
    built = r"^(" + "|".join(BUILD_DIRS) + ")/"
    moved = F.when(bare.rlike(built), F.concat(F.transform(with_ts, lambda x: F.regexp_replace(x, built, "src/")), F.transform(with_ts, lambda x: F.regexp_replace(x, built, "")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(with_ts, moved))


def _leaves(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    items = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [leaf for x in items for leaf in _leaves(x)]


STRING = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*', re.S)
STRING_OR_COMMA = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def without_comments(text: str) -> str:
    """JSON with line comments and then trailing commas taken out; strings stay as they are."""
    for pattern in (STRING, STRING_OR_COMMA):
        text = pattern.sub(lambda m: m.group(0) if m.group(0).startswith('"') else "", text)
    return text


def declared(name: str, text: str) -> list[tuple[str, str]]:
    """(kind, target) of everything that a manifest declares as an entry; nothing if it can't be read."""
    try:
        if name == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            both = {**project.get("scripts", {}), **project.get("gui-scripts", {})}
            return [("python", v.partition(":")[0].strip()) for v in both.values() if isinstance(v, str)]
        data = json.loads(without_comments(text))
        if not isinstance(data, dict):
            return []
        if name == "package.json":
            return [("typescript", x) for k in ("main", "module", "bin", "exports") for x in _leaves(data.get(k))]
        if name == "project.json":
            options = [t.get("options", {}) for t in data.get("targets", {}).values() if isinstance(t, dict)]
            return [("root", o[k]) for o in options if isinstance(o, dict) for k in ("main", "browser", "server") if isinstance(o.get(k), str)]
    except (ValueError, AttributeError, RecursionError):
        return []
    return []


def manifest_entries(files: DataFrame) -> DataFrame:
    """Entry files that manifests declare: ``repo_id``, ``path``, ``evidence``. ``files`` has ``repo_id``, ``path``, ``text``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.repo_id, r.path, kind, target) for r in part.itertuples() for kind, target in declared(r.path.rpartition("/")[2], r.text or "")]
            yield pd.DataFrame(rows, columns=["repo_id", "manifest", "kind", "target"])

    named = paths.file_name(F.col("path"))
    found = files.where(named.isin("pyproject.toml", "package.json", "project.json") & in_manifest_dirs(F.col("path"))).select("repo_id", "path", "text").mapInPandas(run, "repo_id string, manifest string, kind string, target string")
    folder = paths.parent(F.col("manifest"))
    module = F.regexp_replace("target", r"\.", "/")
    options = F.when(F.col("kind") == "python", F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")), F.concat(F.lit("src/"), module, F.lit(".py")), F.concat(F.lit("src/"), module, F.lit("/__init__.py"))))
    options = options.when(F.col("kind") == "root", F.array("target")).otherwise(typescript_candidates(F.col("target")))
    tried = found.select("repo_id", "manifest", "kind", "target", F.posexplode(options).alias("nth", "candidate"))
    inside = F.when((F.col("kind") == "root") | (folder == ""), F.col("candidate")).otherwise(F.concat(folder, F.lit("/"), F.col("candidate")))
    tried = tried.withColumn("path", paths.normalise(inside))
    met = tried.join(exchanged(files.select("repo_id", "path")), ["repo_id", "path"])
    first = F.row_number().over(Window.partitionBy("repo_id", "manifest", "kind", "target").orderBy("nth"))
    entries = met.withColumn("__n", first).where("__n = 1").select("repo_id", "path", F.concat_ws(" ", "manifest", "target").alias("evidence"))
    setup = files.where((paths.file_name(F.col("path")) == "setup.py") & in_manifest_dirs(F.col("path"))).select("repo_id", "path", F.lit("setup.py").alias("evidence"))
    return entries.union(setup)


def conventional_entries(files: DataFrame) -> DataFrame:
    """Files named like entry points; ``index`` only at the root or one directory down."""
    name = paths.file_name(F.col("path"))
    stem, end = F.regexp_extract(name, r"^([^.]+)\.(ts|tsx|mts|cts)$", 1), F.regexp_extract(name, r"^([^.]+)\.(ts|tsx|mts|cts)$", 2)
    depth = F.size(F.split("path", "/")) - 1
    typescript = (end != "") & stem.isin(TS_STEMS) & ((stem != "index") | (depth <= 1))
    return files.where(name.isin(PYTHON_NAMES) | typescript).select("repo_id", "path", F.concat(F.lit("named "), name).alias("evidence"))


def root_entries(edges: DataFrame, most: int = MOST_ROOTS) -> DataFrame:
    """Per repository the files that import others and that nothing imports, the ``most`` of most imports."""
    out = edges.groupBy("repo_id", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    top = out.join(exchanged(edges.select("repo_id", F.col("dst").alias("path"))), ["repo_id", "path"], "left_anti")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "path"))
    return top.withColumn("__n", place).where(F.col("__n") <= most).select("repo_id", "path", F.concat(F.lit("imported by none, imports "), F.col("n").cast("string")).alias("evidence"))


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """All entry points, the strongest evidence of each path: ``repo_id``, ``path``, ``kind``, ``strength``, ``evidence``."""
    parts = [("manifest", manifest_entries(files)), ("convention", conventional_entries(files)), ("graph_root", root_entries(edges))]
    every = None
    for kind, found in parts:
        own = found.withColumns({"kind": F.lit(kind), "strength": F.lit(STRENGTH[kind])})
        every = own if every is None else every.unionByName(own)
    best = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy("strength", "evidence"))
    return every.withColumn("__n", best).where("__n = 1").select("repo_id", "path", "kind", "strength", "evidence")
