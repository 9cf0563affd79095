"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / w from a hash of its id, scaled
by its quality weight w, and a source's documents are taken in key order until
its word budget is used. A budget above the source's size takes every document
once for each complete epoch and samples only the fractional rest.

The prefix sums never gather a source in one task: keys fall into ``buckets``
ranges, sums of ranges are added up per source (at most ``buckets`` rows), and
only rows of one range are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.storage import materialise
from loamline.llm.words import WORD

SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: less for texts full of symbols; 1 for null or empty texts."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 4 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 from the id (a null id: from the text) and the seed; the same in every run."""
    of_text = F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), of_text)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Word budget of each source.

    In: ``src``, ``nosrc`` (the source is null), ``source_size``. Out: the same
    with ``target``. Sources by code point, null last, take ``weights`` in
    turn; ``share`` of all words is dealt by weight; what a source would get
    beyond ``cap`` times its size is dealt again to the others, which ends
    where min(cap * size, level * weight) sums to the budget. One row per
    source goes through one sort.
    """
    turn = F.row_number().over(Window.orderBy("nosrc", "src"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "nosrc", "src")
    everything = Window.partitionBy()
    out = sources.withColumns({"w": w, "most": cap * F.col("source_size")}).withColumn("ratio", F.col("most") / F.col("w"))
    out = out.withColumns({
        "capped": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "free": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "budget": share * F.sum("source_size").over(everything),
    })
    level = F.max((F.col("budget") - F.col("capped")) / F.col("free")).over(everything)
    return out.withColumn("target", F.least("most", level * F.col("w"))).select("src", "nosrc", "source_size", "target")


def _keyed(seed: int, buckets: int) -> list[Column]:
    """What a document's place in the mix follows from: source without null, size, key and the key's range."""
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality_weight(F.col("text"))
    return [
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("nosrc"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        key.alias("key"),
        F.floor(buckets * (1 - F.exp(-key))).cast("int").alias("bucket"),
    ]


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, buckets: int = 4096, keys: bool = False) -> DataFrame:
    """How often the mix takes each document.

    In: ``doc_id``, ``text``, ``source``; other columns are ignored. Out, one
    row per input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target``, ``copies``, ``taken`` (size * copies). A source's fractional
    epoch ends at the document whose middle lies at the budget, so the words
    taken differ from the target by at most half of one document. ``cap`` also
    bounds the copies of a document. Null or empty texts have size 0 and are
    never taken; a null source is a source of its own; rows with equal ids get
    equal keys and are ordered by size, equal rows in any order; a row without
    an id gets its key from its text, so that such rows spread over all ranges.
    """
    sized = docs.select("doc_id", "source", *_keyed(seed, buckets))
    sized = materialise(sized, "mix-sized")
    sums = materialise(sized.groupBy("src", "nosrc", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    budget = targets(sums.groupBy("src", "nosrc").agg(F.sum("words").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("src", "nosrc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.select("src", "nosrc", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")).join(budget, ["src", "nosrc"])
    within = Window.partitionBy("src", "nosrc", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, ["src", "nosrc", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("before") + F.col("inside") + F.col("size") / 2
    copies = F.when(F.col("size") > 0, epochs + F.when(middle < rest, 1).otherwise(0)).otherwise(0).cast("long")
    more = ["src", "nosrc", "bucket", "key"] if keys else []
    return placed.withColumn("copies", copies).select(*more, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """The mix itself: all columns of ``docs``, each document as often as ``mix`` takes it.

    The decisions are carried over by one row per source, its complete epochs
    and the last key of the fractional one, so texts aren't exchanged. Rows
    that are equal in id, size and key share the decision. Null and empty texts
    are never taken, null sources are a source, long texts count whole, and an
    empty table gives an empty one.
    """
    place = F.struct("bucket", "key", "doc_id", "size")
    chosen = mix(docs, weights, share, cap, seed, buckets, keys=True)
    whole = F.floor(F.col("target") / F.col("source_size")).cast("long")
    cuts = chosen.where("size > 0").withColumn("whole", whole).groupBy("src", "nosrc").agg(F.first("whole").alias("whole"), F.max(F.when(F.col("copies") > F.col("whole"), place)).alias("cut"))
    cuts = materialise(cuts.select(F.col("src").alias("__src"), F.col("nosrc").alias("__nosrc"), "whole", "cut"), "mix-cuts")
    names = docs.columns
    own = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *[c.alias(n) for c, n in zip(_keyed(seed, buckets), ("__s", "__n", "__size", "__key", "__bucket"))])
    met = own.join(cuts, (F.col("__s") == F.col("__src")) & (F.col("__n") == F.col("__nosrc")))
    here = F.struct(F.col("__bucket").alias("bucket"), F.col("__key").alias("key"), F.col("row.doc_id").alias("doc_id"), F.col("__size").alias("size"))
    times = F.col("whole") + F.when(F.col("cut").isNotNull() & (here <= F.col("cut")), 1).otherwise(0)
    taken = met.where((F.col("__size") > 0) & (times > 0)).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__time"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names])
