"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is not a secret, and the limits of the text tests.
PLACEHOLDERS = ["changeme", "change_me", "your_api_key", "your-api-key", "yourkeyhere", "placeholder", "example", "password", "secret", "token", "xxxxxxxx", "todo", "none", "null", "dummy", "test", "fake", "sample", "redacted"]
KNOWN_VALUES = ["authorization", "bearer", "basic", "content-type", "application/json", "x-api-key", "set-cookie", "www-authenticate", "proxy-authorization", "authentication", "credentials", "same-origin", "no-cache"]
REFERENCE_PREFIXES = ["$", "${", "%(", "{{", "os.environ", "process.env"]
LEAST_ENTROPY = 3.2
SNIPPET_CHARS = 6000
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def entropy(value: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 if empty."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def redact(value: Column) -> Column:
    """All stars up to 8 characters, else the first and last three with stars between."""
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 3), F.repeat(F.lit("*"), n - 6), F.substring(value, -3, 3)))


def is_placeholder(value: Column) -> Column:
    """Whether a value stands for a secret rather than being one."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[<>{}\[\]]+", ""), r"[<>{}\[\]]+$", ""))
    starts = F.lit(False)
    for p in REFERENCE_PREFIXES:
        starts = starts | bare.startswith(p)
    few = F.size(F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != ""))) <= 2
    return bare.isin(PLACEHOLDERS + KNOWN_VALUES) | starts | few


def mirrors_name(name: Column, value: Column) -> Column:
    """Whether a value repeats its variable's name: equal letters and digits, or one contains the other and the value has at least 6."""
    a, b = (F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")) for x in (name, value))
    longer = (F.length(b) >= 6) & (a.contains(b) | b.contains(a))
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | longer)


def degenerate(text: Column) -> Column:
    """Whether an output of at least 200 characters has run into repetition at its end."""
    tail = F.substring(text, -400, 400)
    n = F.length(tail)
    looped = F.lit(False)
    for width in (4, 6, 8, 12):
        unit = F.substring(tail, 1, width)
        times = (n - F.length(F.replace(tail, unit, F.lit("")))) / width
        looped = looped | ((F.trim(unit) != "") & (times >= 8) & (times * width >= 0.4 * n))
    distinct = F.size(F.array_distinct(F.filter(F.split(tail, ""), lambda c: c != "")))
    return (F.length(text) >= 200) & (looped | (distinct / F.greatest(n, F.lit(1)) < 0.08))


def lines(text: Column) -> Column:
    """Lines at every break that Python's splitlines knows; no empty line after a final break."""
    parts = F.split(text, LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(parts)


def n_lines_nl(text: Column) -> Column:
    """Lines as iterating a file gives them: at newlines only."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def embedding_text(path: Column, symbol: Column, content: Column) -> Column:
    return F.concat(path, F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" · "), symbol)).otherwise(""), F.lit("\n"), content)


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)


def without_thinking(text: Column) -> Column:
    """Remove thinking markers and blank lines."""
    marked = F.regexp_replace(text, "</?(think|｜DSML｜)>", "\n")
    return F.array_join(F.filter(F.split(marked, "\n"), lambda x: F.trim(x) != ""), "\n")


def severity(value: Column) -> Column:
    """Unknown severities group as medium."""
    low = F.lower(value)
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")
