"""Paths as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, suffixes and file names that decide what is scanned.
SKIPPED_IN_PARSE = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".nx", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox"]
SKIPPED_IN_PROFILE = [".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".next", ".nuxt", "target", "vendor", ".tox", "site-packages"]
LANGUAGE_OF_SUFFIX = {
    ".py": "Python", ".pyi": "Python", ".ts": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript", ".tsx": "TypeScript",
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java",
    ".rb": "Ruby", ".md": "Markdown", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".css": "CSS", ".scss": "CSS",
    ".html": "HTML", ".sh": "Shell", ".sql": "SQL",
}
SECRET_NAMES = [".env", ".env.local", ".env.production", ".npmrc", ".netrc"]
SECRET_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore"]
PARSED_SUFFIXES = [".py", ".pyi", ".ts", ".mts", ".cts", ".tsx"]
STEM_SUFFIXES = [".ts", ".tsx", ".d.ts", ".mts", ".cts", ".py", ".pyi"]


def normalise(path: Column) -> Column:
    """Fold ``.`` and ``..`` and turn backslashes round; empty where ``..`` would leave the root."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def fold(acc: Column, part: Column) -> Column:
        up, depth = part == "..", F.size(acc["kept"])
        kept = (
            F.when(part.isin("", "."), acc["kept"])
            .when(up & (depth > 0), F.slice(acc["kept"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .when(up, acc["kept"])
            .otherwise(F.concat(acc["kept"], F.array(part)))
        )
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (depth == 0))).alias("out"))

    return F.aggregate(parts, start, fold, lambda acc: F.when(acc["out"], F.lit("")).otherwise(F.array_join(acc["kept"], "/")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_OF_SUFFIX.items())])
    return F.coalesce(F.try_element_at(known, F.lower(suffix(path))), F.lit("Other"))


def under_any(path: Column, names: list[str]) -> Column:
    """Whether any part of the path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def secret_shaped(path: Column) -> Column:
    return file_name(path).isin(SECRET_NAMES) | F.lower(suffix(path)).isin(SECRET_SUFFIXES)


def stem(path: Column) -> Column:
    """Path without the first of STEM_SUFFIXES that fits; null if none does."""
    out = F.when(F.lit(False), path)
    for s in STEM_SUFFIXES:
        out = out.when(path.endswith(s), F.substring(path, F.lit(1), F.length(path) - len(s)))
    return out


def stem_rank(path: Column) -> Column:
    """Place of the suffix that ``stem`` strips."""
    out = F.when(F.lit(False), 0)
    for i, s in enumerate(STEM_SUFFIXES):
        out = out.when(path.endswith(s), i)
    return out
