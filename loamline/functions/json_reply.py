"""JSON values in the text of a model's reply."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FENCE = re.compile(r"```[^\n]*\n(.*?)(?:```|\Z)", re.S)
MARK = re.compile(r'["\\{}\[\]]')
NEXT = re.compile(r"[ \t\r\n]*(.?)", re.S)
PAIRS = {"{": "}", "[": "]"}
# What may follow a string in JSON.
AFTER_STRING = ",}]:"


def balanced(text: str) -> list[str]:
    """Outermost ``{...}`` and ``[...]`` spans in order; brackets inside strings don't count, and a wrong closing one begins anew."""
    found, expected, start, quoted, skip = [], [], 0, False, -1
    for m in MARK.finditer(text):
        i, c = m.start(), m[0]
        if i == skip:
            continue
        if quoted:
            if c == "\\":
                skip = i + 1
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in PAIRS:
            if not expected:
                start = i
            expected.append(PAIRS[c])
        elif expected and c == expected[-1]:
            expected.pop()
            if not expected:
                found.append(text[start : i + 1])
        elif c != "\\":
            expected.clear()
    return found


def with_inner_quotes_escaped(text: str) -> str:
    """Quotes inside strings with a backslash before them: those that nothing follows which may follow a string."""
    out, last, quoted, skip = [], 0, False, -1
    for m in MARK.finditer(text):
        i, c = m.start(), m[0]
        if i == skip or c not in '"\\':
            continue
        if c == "\\":
            skip = i + 1 if quoted else -1
        elif not quoted:
            quoted = True
        else:
            after = NEXT.match(text, i + 1)[1]
            if not after or after in AFTER_STRING:
                quoted = False
            else:
                out.append(text[last:i] + "\\")
                last = i
    return "".join(out) + text[last:]


def values(reply: str | None) -> list[str]:
    """Texts of the JSON values of a reply, repaired where that helps: those of fenced blocks, then balanced spans, then the whole; without repeats."""
    if not reply:
        return []
    out = []
    for text in dict.fromkeys(x.strip() for x in (*FENCE.findall(reply), *balanced(reply), reply)):
        for attempt in dict.fromkeys((text, with_inner_quotes_escaped(text))):
            try:
                json.loads(attempt)
            except (ValueError, RecursionError):
                continue
            out.append(attempt)
            break
    return out


@pandas_udf(T.ArrayType(T.StringType()))
def json_values(replies: pd.Series) -> pd.Series:
    """``values`` of each reply of a batch; null and empty ones have none."""
    return replies.map(values)


def first_json(reply: Column) -> Column:
    """The first value, as text; null for none."""
    return F.try_element_at(json_values(reply), F.lit(1))
