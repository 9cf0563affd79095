"""Audit of how document filters interact, as relational steps over exploded words.

Words are exploded, counted by (document, word) and then by document for
totals and distinct words. Copies and labels are outer-joined to these, each
document becomes a mask of the filters that it fails, and one aggregate per
source counts documents by mask in 32 conditional columns (again for good and
for toxic ones). What any order of the filters keeps, removes and overlaps in
follows from these counts alone, so all 120 orders cost no further pass over
the documents.

Words never leave the task that reads their text: a row's text is whole in one
Arrow batch, so both word aggregates end there and are exchanged as two
numbers.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.storage import materialise
from loamline.llm.words import slices, text_bytes

#: One letter for each filter; bit i of a mask is set where the filter of letter i fails.
LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]


def word_totals(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words and distinct words of each text, by two relational aggregates over exploded words.

    Arrow's ASCII white space is \\x20 and \\x09-\\x0D. It gives an empty
    string before leading and after trailing space, which is no word.
    """
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = pa.table({"row": pc.list_parent_indices(split), "word": coded.indices})
    by_word = words.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        by_word = by_word.filter(pc.not_equal(by_word["word"], empty))
    by_row = by_word.group_by("row", use_threads=False).aggregate([("count_all", "sum"), ("word", "count")])
    at = pc.index_in(pa.array(range(len(texts)), by_row["row"].type), by_row["row"].combine_chunks())
    return tuple(pc.fill_null(by_row[name].combine_chunks().take(at), 0) for name in ("count_all_sum", "word_count"))


def flags(docs: DataFrame, min_words: int = 200, min_distinct_percent: int = 50, upper_percent: int = 2, symbols: str = "#$%&*|") -> DataFrame:
    """What a document shows by itself: ``doc_id``, ``part``, ``digest`` (SHA-256 of the text), ``mask`` (filters A to D).

    A: fewer than ``min_words`` words. B: fewer distinct words than
    ``min_distinct_percent`` of all. C: more than ``upper_percent`` of its
    characters are A-Z. D: one of ``symbols``. One row per row.
    """
    listed = "[" + "".join(f"\\{c}" for c in symbols) + "]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            n_words, n_distinct = word_totals(texts)
            fails = [
                pc.less(n_words, min_words),
                pc.less(pc.multiply(n_distinct, 100), pc.multiply(n_words, min_distinct_percent)),
                pc.greater(pc.multiply(pc.count_substring_regex(texts, "[A-Z]").cast(pa.int64()), 100), pc.multiply(pc.utf8_length(texts).cast(pa.int64()), upper_percent)),
                pc.match_substring_regex(texts, listed),
            ]
            mask = pa.array([0] * len(texts), pa.int32())
            for i, fail in enumerate(fails):
                mask = pc.add(mask, pc.multiply(fail.cast(pa.int32()), 1 << i))
            digests = pa.array([hashlib.sha256(t).digest() for t in text_bytes(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), digests, mask.cast(pa.int32())], names=["doc_id", "part", "digest", "mask"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())]
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(run, T.StructType(fields))


def failures(docs: DataFrame, **limits) -> DataFrame:
    """The mask of failed filters of every document: ``doc_id``, ``part``, ``mask``, ``n`` (rows alike).

    Filter E: a smaller id has the same text. The join is on id and text, so a
    text that many documents share is no hot key: a row fails where it isn't
    the pair of that text and its smallest id.
    """
    own = materialise(flags(docs, **limits), "audit-flags").groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    own = materialise(own, "audit-alike")
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    met = own.join(first, ["doc_id", "digest"], "left")
    return met.groupBy("doc_id", "part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"))


def conditional_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: ``n0`` to ``n31``, ``good0`` to ``good31``, ``toxic0`` to ``toxic31``, documents by mask."""
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    by_label = failed.join(label, "doc_id", "left").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    return by_label.groupBy("part").agg(*[F.sum(F.when((F.col("mask") == m) & on, F.col("n")).otherwise(0)).alias(f"{kind}{m}") for kind, on in kinds.items() for m in range(MASKS)])


def by_order(counts: DataFrame) -> DataFrame:
    """Every order and step of each part, from its conditional counts alone."""
    at = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o in ORDERS for s in range(1, len(LETTERS) + 1)]))
    arrays = [F.array(*[F.col(f"{kind}{m}") for m in range(MASKS)]).alias(kind) for kind in ("n", "good", "toxic")]
    own = F.coalesce(*[F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == letter, 1 << i) for i, letter in enumerate(LETTERS)])
    earlier = sum((F.when(F.locate(letter, F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0) for i, letter in enumerate(LETTERS)), F.lit(0))
    rows = counts.select("part", *arrays, at.alias("at")).select("part", "n", "good", "toxic", "at.*").withColumns({"own": own, "earlier": earlier})

    def total(kind: str, counted) -> Column:
        """Sum of the counts of the masks for which ``counted(mask)`` holds."""
        return F.aggregate(F.transform(kind, lambda c, m: F.when(counted(m), c).otherwise(0)), F.lit(0).cast("long"), lambda a, c: a + c)

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    # A document that fails k filters is removed by each of them in a k-th of all orders.
    shares = F.array(*[F.lit(math.factorial(len(LETTERS)) // max(1, m.bit_count())).cast("long") for m in range(MASKS)])
    weighted = F.zip_with("n", shares, lambda c, share: c * share)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.element_at("n", F.col("own") + 1).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        total(weighted, fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """One row per part (source, null as ''), order of the five filters and step.

    In: ``docs`` with ``doc_id``, ``text``, ``source``; ``labels`` with
    ``doc_id``, ``quality``, ``toxic``; other columns are ignored; ``limits``
    as in ``failures``. Out: ``part``, ``filter_order``, ``step`` and as longs
    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``,
    ``toxic_lost``, ``shapley``. Rows count each by themselves: repeated ids
    and repeated rows are documents of their own (rows of one id never are
    copies of one another), a null id has no label and is no copy, a null text
    is an empty one, and several labels of an id count where any says so. An
    empty table gives no rows.
    """
    return by_order(conditional_counts(failures(docs, **limits), labels))
