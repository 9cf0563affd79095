"""Small corpora with every awkward case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names collide with what operators compute.
CLASHING = {"score": 1.5, "size": 3, "target": 2.0, "fp": 7, "component_id": 9, "copies": 4, "words": 5, "held_out": True, "label": 1, "node": 2, "kept": False, "rank": 6, "n": 8, "bucket": 1, "of": 3, "chain": 2}


def sentence(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward(spark, extra: bool = True):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    plain = sentence(rng, 80)
    rows = [
        (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n\t ", "en", None, 4), (4, plain, "en", "s", 5), (5, plain, "en", "s", 5), (5, plain, "en", "s", 5),
        (None, plain, "en", "s", 1), (None, None, None, None, None), (6, long, "de", "t", 9), (7, "one", "de", "t", 3), (8, "Ünï cødé 日本語 😀 text", "de", "", None), (9, "a\x00b \x1c \x85 c", "en", "s", 7), (-3, plain + " extra", "en", "s", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
