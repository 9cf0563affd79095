"""Chunks of source files for an index: definitions, class headers, module-level runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import paths
from loamline.operators import python_source, typescript_source

# Sizes of chunks.
MOST_LINES, OVERLAP, LEAST_LINES = 120, 8, 2

SCHEMA = "repo_id string, chunk_id string, path string, start_line int, end_line int, content string, symbol string, parent string, kind string, part_index int"


def split_lines(start: int, end: int, most: int = MOST_LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of ``most`` lines with overlap over a closed range."""
    out = []
    while True:
        stop = min(start + most - 1, end)
        out.append((start, stop))
        if stop >= end:
            return out
        start = stop + 1 - overlap


def split_statements(start: int, end: int, starts: list[int], most: int = MOST_LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Cut before statements once a part has ``most`` lines; with fewer than two parts, by lines."""
    out, begin = [], start
    for s in sorted(set(starts)):
        if begin < s and s - begin >= most and s <= end:
            out.append((begin, s - 1))
            begin = max(begin + 1, s - overlap)
    out.append((begin, end))
    if len(out) < 2 or any(b - a + 1 > 2 * most for a, b in out):
        return split_lines(start, end, most, overlap)
    return out


def chunk_file(path: str, text: str, most: int = MOST_LINES, overlap: int = OVERLAP) -> list[tuple]:
    """(chunk_id, path, start, end, content, symbol, parent, kind, part), by start and part.

    Definitions are taken from the outside in; one whose first line is covered
    already belongs to its outer chunk. Lines that no chunk covers form
    module-level runs, which may hold blank lines but don't end in one.
    """
    lines = text.splitlines()
    parsed = (python_source if path.endswith((".py", ".pyi")) else typescript_source).read(text)
    covered: set[int] = set()
    rows: list[tuple] = []

    def add(a: int, b: int, symbol: str, parent: str, kind: str, part: int = 0) -> None:
        name = f"{path}:{a}-{b}" + (f"#{part}" if part else "")
        rows.append((name, path, a, b, "\n".join(lines[a - 1 : b]), symbol, parent, kind, part))
        covered.update(range(a, b + 1))

    for a, b, name, parent, kind, starts, first_method in sorted(parsed.definitions, key=lambda d: (d[0], -d[1])):
        if a in covered:
            continue
        if kind == "class":
            stop = first_method - 1 if first_method else b
            if stop - a + 1 >= LEAST_LINES:
                if stop - a + 1 <= most:
                    add(a, stop, name, parent or "", "class_header")
                else:
                    for i, (x, y) in enumerate(split_lines(a, stop, most, overlap), 1):
                        add(x, y, name, parent or "", "class_header", i)
            else:
                covered.update(range(a, stop + 1))
        elif b - a + 1 <= most:
            add(a, b, name, parent or "", kind)
        else:
            for i, (x, y) in enumerate(split_statements(a, b, starts, most, overlap), 1):
                add(x, y, name, parent or "", "function_part", i)
    run: list[int] = []

    def close() -> None:
        while run and not lines[run[-1] - 1].strip():
            run.pop()
        if len(run) >= LEAST_LINES:
            parts = split_lines(run[0], run[-1], most, overlap)
            for i, (x, y) in enumerate(parts, 1):
                add(x, y, "", "", "module", i if y - x + 1 >= most else 0)
        run.clear()

    for n, line in enumerate(lines, 1):
        if n in covered:
            close()
        elif run or line.strip():
            run.append(n)
    close()
    return sorted(rows, key=lambda r: (r[2], r[8], r[0]))


def chunk(files: DataFrame) -> DataFrame:
    """Chunks of all parseable files that aren't shaped like secrets; that filter comes before any Python."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(repo, *c) for repo, path, text in zip(part["repo_id"], part["path"], part["text"]) for c in chunk_file(path, text or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    p = F.col("path")
    own = files.where(~paths.secret_shaped(p) & F.lower(paths.suffix(p)).isin(paths.PARSED_SUFFIXES))
    return own.select("repo_id", "path", "text").mapInPandas(run, SCHEMA)
