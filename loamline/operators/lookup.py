"""Lookups over a repository's files: slices, listings, definitions, references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import paths, text

# Caps of what a lookup returns.
AGENT_LINES, AGENT_CHARS = 200, 500
UI_LINES, UI_CHARS = 2000, 2000
LISTED = {"agent": 80, "ui": 120}
MOST_FILES, MOST_HITS, MOST_DEFINITIONS = 40, 30, 12
HIDDEN = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox"]


def line_table(files: DataFrame, *keep: str) -> DataFrame:
    """A row per line: ``keep``, ``line`` from 1, ``content``."""
    return files.select(*keep, F.posexplode(text.lines(F.col("text"))).alias("n", "content")).select(*keep, (F.col("n") + 1).alias("line"), "content")


def read_slice(files: DataFrame, path: str, start: int = 1, end: int | None = None, ui: bool = False) -> DataFrame:
    """Lines ``start`` to ``end`` of a file, cut in number and length.

    A start beyond the end gives the last line. An agent's missing end is 199
    lines after the start.
    """
    most, chars = (UI_LINES, UI_CHARS) if ui else (AGENT_LINES, AGENT_CHARS)
    lines = text.lines(F.col("text"))
    total = F.size(lines)
    first = F.least(F.greatest(F.lit(start), F.lit(1)), F.greatest(total, F.lit(1)))
    last = F.least(total, F.lit(end) if end is not None else total if ui else F.lit(start + most - 1), first + most - 1)
    last = F.greatest(last, first)
    rows = files.where(F.col("path") == path).select(F.explode(F.transform(F.slice(lines, first, last - first + 1), lambda x, i: F.struct((first + i).alias("line"), F.substring(x, 1, chars).alias("content")))).alias("r"))
    return rows.select("r.*")


def list_directory(files: DataFrame, directory: str, most: int = LISTED["agent"]) -> DataFrame:
    """Direct children of a directory (empty: the root): directories first, then by name, with the directories' own file counts."""
    inside = F.lit(True) if directory == "" else F.col("path").startswith(directory + "/")
    rest = F.col("path") if directory == "" else F.expr(f"substring(path, {len(directory) + 2})")
    child = F.substring_index(rest, "/", 1)
    own = files.where(inside).select(child.alias("name"), rest.contains("/").alias("is_dir"), (F.size(F.split(rest, "/")) == 2).cast("long").alias("direct"))
    own = own.where(~F.col("name").startswith(".") & ~F.col("name").isin(HIDDEN))
    return own.groupBy("name", "is_dir").agg(F.sum("direct").alias("n_files")).orderBy(F.desc("is_dir"), "name").limit(most)


def direct_files(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n_files"))


def definitions(symbols: DataFrame, name: str, path_part: str | None = None, most: int = MOST_DEFINITIONS) -> DataFrame:
    """Symbols of that plain or qualified name by path and line, with the number of all of them."""
    own = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    if path_part:
        own = own.where(F.col("path").contains(path_part))
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return own.orderBy("path", "start_line").limit(most).crossJoin(total)  # one row


def references(symbols: DataFrame, edges: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Lines that name a symbol, in its definition files and then in files that import these; 40 files and 30 lines at most."""
    word = r"(?<![A-Za-z0-9_])" + re.escape(name) + r"(?![A-Za-z0-9_])"
    defined = symbols.where((F.col("name") == name) | (F.col("qualified_name") == name)).select("path").distinct()
    users = edges.join(defined, edges.dst == defined.path, "left_semi").select(F.col("src").alias("path")).distinct().join(defined, "path", "left_anti")
    where = defined.withColumn("far", F.lit(0)).union(users.withColumn("far", F.lit(1))).orderBy("far", "path").limit(MOST_FILES)
    lines = line_table(files.join(where, "path"), "path", "far").where(F.col("content").rlike(word))
    return lines.orderBy("far", "path", "line").limit(MOST_HITS).select("path", "line", F.substring(F.trim("content"), 1, 100).alias("content"))


def cited_paths(texts: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Paths that a text names in full, or by a file name that only one file has.

    Words that look like paths are cut out of the text and met with the paths by an equi-join.
    """
    words = F.regexp_extract_all("text", F.lit(r"[\w./\-]+"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[./]+|[.]+$", ""))
    said = texts.select(key, F.explode(F.array_distinct(bare)).alias("word"))
    full = said.join(files.select("path"), F.col("word") == F.col("path")).select(key, "path")
    single = files.groupBy(paths.file_name(F.col("path")).alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1")
    return full.union(said.join(single, "word").select(key, "path")).distinct()


def numbered(line: Column, content: Column) -> Column:
    return F.concat(F.lpad(line.cast("string"), 5, " "), F.lit("  "), content)


def workspace_status(on_disk: Column, known: Column) -> Column:
    """200 with files, 410 if they were cleared, 409 before there are any."""
    return F.when(on_disk, 200).when(known, 410).otherwise(409)


def safe_target(path: Column) -> Column:
    """Normalised path; empty for the root; null for absolute paths and those that leave the root."""
    bare = F.trim(path)
    absolute = bare.rlike(r"^([/\\]|[A-Za-z]:)")
    folded = paths.normalise(bare)
    return F.when(bare.isin("", "."), F.lit("")).when(~absolute & (folded != ""), folded)
