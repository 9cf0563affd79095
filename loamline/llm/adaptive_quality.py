"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each language and source has a sketch per measure: counts of values by
logarithmic buckets, which give every quantile within a known relative error,
add up when merged and don't depend on the order of rows. Thresholds are
Tukey's outer fences about the middle half of the distinct texts, those of the
language where they are wider; groups of few texts take the sketch of their
language, and that of all texts where the language is rare too. Documents are
then joined with their group's thresholds and filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.storage import kept, materialise, scratch
from loamline.llm.words import WordHashes, gram_hashes, slices, text_bytes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
NOT_COUNTED = b"\x20\x09\x0a\x0b\x0c\x0d" + CONTINUED
#: Bytes that begin a letter, all characters beyond ASCII taken as letters.
LETTERS = UPPER + UPPER.lower() + bytes(range(0xC0, 0x100))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What thresholds are set for: all but the last are defects, with an upper fence only.
MEASURES = ["other_share", "upper_share", "local_repeats", "repeats", "word_length"]
TWO_SIDED = {"word_length"}
LOCAL = 50
#: Tukey's factor for values that are far out.
FAR_OUT = 3.0
ERROR = 0.005
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Bucket of zero, below all others.
ZERO = -(2**31)


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of MEASURES; zeros for a text without words.

    ``other_share``: characters of words that aren't letters; ``upper_share``:
    A-Z among letters; ``local_repeats``: words that occurred already within
    the same 50 words; ``repeats``: 1 - log(distinct words + 1) / log(words + 1);
    ``word_length``: characters per word.
    """
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, NOT_COUNTED))
    counts = [n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0]
    if not n:
        return counts, [0.0] * len(MEASURES)
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    if n >= 3 and v < n:
        _, where, times = np.unique((w[:-2] * v + w[1:-1]) * v + w[2:], return_inverse=True, return_counts=True)
        twice = times[where] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= twice
        counts[4] = int(covered.sum())
    if n < 2 * LOCAL:
        local = 1 - v / n if n < LOCAL else 1 - len(np.unique(w[:LOCAL])) / LOCAL
    else:
        rows = np.sort(w[: n // LOCAL * LOCAL].reshape(-1, LOCAL), axis=1)
        local = float((rows[:, 1:] == rows[:, :-1]).mean()) * (LOCAL - 1) / LOCAL
    letters = len(text) - len(text.translate(None, LETTERS))
    upper = len(text) - len(text.translate(None, UPPER))
    return counts, [max(0.0, 1 - letters / max(1, chars)), upper / max(1, letters), local, 1 - float(np.log(v + 1) / np.log(n + 1)), chars / n]


def near_key(words: list[bytes], hashes: WordHashes) -> int:
    """The smallest hash of the text's runs of three words (of all its words, if fewer), as a signed integer: the same for most near copies of a text."""
    grams = gram_hashes(hashes.of(words), min(3, len(words)))
    return int(grams.min().view(np.int64)) if len(grams) else 0


def measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``row`` (the ``carried`` columns), ``g_lang``, ``g_source``, ``near_key``, counts and measures for each row's whole text."""
    group = [F.coalesce(F.col(c), F.lit("\x00")).alias(f"g_{c}") for c in ("lang", "source")]
    own = docs.select(F.struct(F.lit(0).alias("nothing"), *[docs[c] for c in carried]).alias("row"), *group, "text")
    kept = ["row", "g_lang", "g_source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            texts = text_bytes(batch)
            rows = [measure(t) for t in texts]
            counts = np.array([c for c, _ in rows], np.int64).reshape(-1, len(COUNTS))
            values = np.array([m for _, m in rows], np.float64).reshape(-1, len(MEASURES))
            keys = np.array([near_key(t.split(), known) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(keys), *[pa.array(x) for x in counts.T], *[pa.array(x) for x in values.T]], names=[*kept, "near_key", *COUNTS, *MEASURES])

    schema = T.StructType([*[own.schema[c] for c in kept], T.StructField("near_key", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(m, T.DoubleType()) for m in MEASURES]])
    return own.mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """The bucket of a value: bounds grow by GAMMA; what is below a millionth is zero."""
    return F.when(value > 1e-6, F.ceil(F.log(value) / float(np.log(GAMMA)))).otherwise(ZERO).cast("int")


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``docs``, ``low``, ``mid``, ``high`` (quartiles) by ``by`` and ``measure``: the value of the bucket that holds the quantile's rank."""
    keys = [*by, "measure"]
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.exp(F.col("bucket") * float(np.log(GAMMA))) / (GAMMA + 1))
    return ranked.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("upto") >= F.ceil(q * F.col("docs")), value)).alias(c) for c, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))])


def thresholds(rows: DataFrame, least_docs: int = 200) -> DataFrame:
    """By ``g_lang``, ``g_source`` and in columns by measure: ``mid_*``, ``above_*`` (highest value allowed) and ``below_*`` (lowest), and ``mid_n_words``.

    The middle is that of the group, or of its language if the group has fewer
    than ``least_docs`` distinct texts, or of all, and so is the fence: a
    source is measured by itself, whether it is stricter or looser than its
    language. Equal quartiles give no fence, and then the next wider table's
    counts; without any nothing is judged. Copies and near copies (rows of one
    ``near_key`` in a group) count once, by the smallest of their values, so
    they don't make a group narrow and reject the rest of its texts.
    """
    judged = ["n_words", *MEASURES]
    distinct = rows.where("n_words > 0").groupBy("g_lang", "g_source", "near_key").agg(F.min(F.struct(*judged)).alias("of")).select("g_lang", "g_source", "of.*")
    cells = distinct.select("g_lang", "g_source", F.posexplode(F.array(*[bucket(F.col(m).cast("double")) for m in judged])).alias("measure", "bucket"))
    sketch = materialise(cells.groupBy("g_lang", "g_source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")), "quality-sketches")
    merged = lambda *by: sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    out = sketch.select("g_lang", "g_source", "measure").distinct()
    for level, by, of in (("g", ["g_lang", "g_source"], sketch), ("l", ["g_lang"], merged("g_lang")), ("a", [], merged())):
        q = _quantiles(of, by)
        spread = F.when(F.col("high") > F.col("low"), FAR_OUT * (F.col("high") - F.col("low")))
        enough = F.lit(True) if level == "a" else F.col("docs") >= least_docs
        found = [F.when(enough, c).alias(f"{level}_{n}") for n, c in (("mid", F.col("mid")), ("above", F.col("high") + spread), ("below", F.col("low") - spread))]
        out = out.join(q.select(*by, "measure", *found), [*by, "measure"], "left")
    picked = out.select("g_lang", "g_source", "measure", *[F.coalesce(*[f"{level}_{c}" for level in "gla"]).alias(c) for c in ("mid", "above", "below")])
    at = lambda i, c: F.max(F.when(F.col("measure") == i, F.col(c)))
    wide = [at(0, "mid").alias("mid_n_words")]
    for i, m in enumerate(MEASURES, 1):
        wide += [at(i, "mid").alias(f"mid_{m}"), at(i, "above").alias(f"above_{m}"), at(i, "below").alias(f"below_{m}")]
    return picked.groupBy("g_lang", "g_source").agg(*wide)


def judged(rows: DataFrame, plan: DataFrame, base_rule: bool) -> DataFrame:
    """Rows of ``measured`` with ``base_failed`` and ``kept``, by the thresholds of their group."""
    out_of_bounds = F.lit(False)
    for m in MEASURES:
        drawn = (F.col("n_words") * F.col(m) + F.col("mid_n_words") * F.col(f"mid_{m}")) / (F.col("n_words") + F.col("mid_n_words"))
        over = drawn > F.col(f"above_{m}")
        out_of_bounds = out_of_bounds | F.coalesce(over | (drawn < F.col(f"below_{m}")) if m in TWO_SIDED else over, F.lit(False))
    fine = ~((F.col("n_words") > 0) & out_of_bounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(plan, ["g_lang", "g_source"], "left").withColumn("base_failed", failed)
    return out.withColumn("kept", fine & ~F.col("base_failed") if base_rule else fine)


def with_verdicts(docs: DataFrame, least_docs: int = 200, base_rule: bool = True) -> DataFrame:
    """Counts and verdict of every document.

    In: ``doc_id``, ``text``, ``lang``, ``source``; other columns are ignored,
    whatever their names. Out, one row per input row: these without the text,
    COUNTS, MEASURES, ``base_failed`` (under 50 words, or over half of them in
    repeated 3-word windows) and ``kept``: every measure is within the
    thresholds of its group, and the base rule, unless switched off, holds.

    A measure is drawn to its group's median with the weight of a text of
    median length, since short texts show little. Copies of a text count once
    in a group's sketch. Null texts count as empty, null languages and sources
    are groups of their own, repeated rows get equal verdicts, an empty table
    gives none. Documents without words give the sketches nothing and no
    measure of theirs is out of bounds. Reruns agree: sketches are counts.
    """
    rows = materialise(measured(docs, ["doc_id", "lang", "source"]), "quality-measured")
    with scratch():
        plan = kept(materialise(thresholds(rows, least_docs), "quality-thresholds"))
    return judged(rows, plan, base_rule).select("row.doc_id", "row.lang", "row.source", *COUNTS, *MEASURES, "base_failed", "kept")


def without_rejected(docs: DataFrame, least_docs: int = 200, base_rule: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``with_verdicts`` keeps, with all their columns.

    Each row is judged by itself, so ids may be null or repeated. Texts are
    measured twice and never exchanged by a key.
    """
    with scratch():
        plan = kept(materialise(thresholds(measured(docs, []), least_docs), "quality-thresholds"))
    left = judged(measured(docs, docs.columns), plan, base_rule).where("kept")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
