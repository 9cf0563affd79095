"""Ranking, normalisation, budgets and runs: operators that any table can use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Least and greatest of columns in each group. A window over all rows would put them in one task; an aggregate doesn't."""
    found = df.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    return df.join(found, list(by)) if by else df.crossJoin(found)  # a single row


def min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``norm_<c>`` between 0 and 1 for every column; all 0 where the span isn't positive."""
    out = _bounds(df, columns, by)
    for c in columns:
        span = F.col(f"max_{c}") - F.col(f"min_{c}")
        out = out.withColumn(f"norm_{c}", F.when(span > 0, (F.col(c) - F.col(f"min_{c}")) / span).otherwise(F.lit(0.0)))
    return out.drop(*[f"{n}_{c}" for c in columns for n in ("min", "max")])


def blended(df: DataFrame, weights: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Add ``score``, the weighted sum of the normalised columns."""
    out = min_max(df, list(weights), by)
    return out.withColumn("score", sum((w * F.col(f"norm_{c}") for c, w in weights.items()), F.lit(0.0)))


def file_rank(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score 0.6 centrality + 0.4 churn, both normalised; centrality alone where no file of the group has churn (columns ``centrality``, ``churn``)."""
    own = files.withColumn("churn", F.coalesce("churn", F.lit(0)))
    out = min_max(own, ["centrality", "churn"], by)
    most = own.groupBy(*by).agg(F.max("churn").alias("most_churn"))
    out = out.join(most, list(by)) if by else out.crossJoin(most)
    return out.withColumn("score", F.when(F.col("most_churn") > 0, 0.6 * F.col("norm_centrality") + 0.4 * F.col("norm_churn")).otherwise(F.col("norm_centrality"))).drop("most_churn")


def module_rank(modules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score 0.65 summed centrality + 0.35 number of files (columns ``centrality``, ``n_files``)."""
    return blended(modules, {"centrality": 0.65, "n_files": 0.35}, by)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows in a total order: a heap per task, then one of ``n`` rows each."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, n: int, by: Sequence[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank; Spark cuts groups to ``n`` rows before the exchange."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def rule_plan(scored: DataFrame, limit: int, deep: int = 3, name: str = "name") -> DataFrame:
    """Top modules with priority from 1; the first ``deep`` are analysed deeply."""
    best = top(scored, limit, F.desc("score"), name)
    place = F.row_number().over(Window.orderBy(F.desc("score"), name))  # of at most ``limit`` rows
    return best.withColumn("priority", place).withColumn("depth", F.when(F.col("priority") <= deep, "deep").otherwise("shallow"))


def semantic_plan(scored: DataFrame, decisions: DataFrame, limit: int, name: str = "name") -> DataFrame:
    """Of the first 2 * limit modules those that no decision rejects, the first ``limit``; no others are filled in."""
    best = top(scored, 2 * limit, F.desc("score"), name)
    rejected = decisions.where("not keep").select(name).distinct()
    left = best.join(rejected, name, "left_anti")
    return rule_plan(left, limit, name=name)


def unknown_names(scored: DataFrame, decisions: DataFrame, name: str = "name") -> DataFrame:
    """Names in decisions that no module has: reported, and otherwise without effect."""
    return decisions.select(name).distinct().join(scored.select(name), name, "left_anti")


def index_sample(files: DataFrame, scores: DataFrame, n: int, key: str = "path", seq: str = "seq") -> DataFrame:
    """The ``n`` files of highest score (missing: 0, ties by key), in their original order."""
    best = top(files.join(scores, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0))), n, F.desc("score"), key)
    return best.orderBy(seq)


def prefix_budget(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], size: str, budget: int, most: int) -> DataFrame:
    """First ``most`` rows of each group as long as their sizes fit the budget; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    out = out.withColumn("used", F.sum(size).over(Window.partitionBy(*by).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("rn") == 1) | (F.col("used") <= budget))


def lru_evictions(copies: DataFrame, quota: int, least_share: float = 0.1, ranges: int = 256) -> DataFrame:
    """Which copies to delete, oldest first, until the total fits the quota.

    ``repo``, ``size``, ``last_used``, ``running``. Running ones are exempt but
    count. Nothing goes if all that may go is less than ``least_share`` of the
    quota. Prefix sums go by ranges of the time of last use: sums of ranges
    (``ranges`` rows) are added up, and only rows of a range are sorted together.
    """
    bounds = copies.agg(F.min("last_used").cast("double").alias("low"), F.max("last_used").cast("double").alias("high"), F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~F.col("running"), F.col("size"))), F.lit(0)).alias("free"))
    place = F.least(F.lit(ranges - 1), F.floor(ranges * (F.col("last_used").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300))))
    idle = copies.where(~F.col("running")).crossJoin(bounds).withColumn("__range", F.coalesce(place, F.lit(0)))  # one row
    sums = idle.groupBy("__range").agg(F.sum("size").alias("__sum"))
    before = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("size").over(Window.partitionBy("__range").orderBy("last_used", "repo").rowsBetween(Window.unboundedPreceding, -1))
    idle = idle.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(before, "__range").withColumn("gone", F.col("__before") + F.col("__inside"))
    return idle.where((F.col("total") - F.col("gone") > quota) & (F.col("free") >= least_share * quota)).select("repo", "size", "last_used", (F.col("total") - F.col("gone")).alias("used_before"))


def best_evidence(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the order."""
    return top_per(df, 1, [key], *order, name="__place").drop("__place")


def unique_names(df: DataFrame, name: str, tail: Column) -> DataFrame:
    """Add ``unique_name``: the name, with ``tail`` where it repeats."""
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, name).withColumn("unique_name", F.when(F.col("__n") > 1, F.concat_ws(":", F.col(name), tail)).otherwise(F.col(name))).drop("__n")


def islands(df: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Runs of consecutive positions: ``by``, ``start``, ``end``, ``n``."""
    step = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    return df.select(*by, position).distinct().withColumn("__run", step).groupBy(*by, "__run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count(F.lit(1)).alias("n")).drop("__run")


def running_max(df: DataFrame, by: Sequence[str], seq: str, value: str, name: str = "shown") -> DataFrame:
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def module_progress(df: DataFrame, by: Sequence[str], seq: str, completed: Column, planned: Column, low: int = 35, high: int = 75) -> DataFrame:
    """Percent from ``low`` to ``high`` by completed over planned modules, cut to whole numbers."""
    done = F.sum(completed.cast("long")).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("completed", done)
    share = F.col("completed") / F.greatest(planned, F.col("completed"), F.lit(1))
    return out.withColumn("percent", F.floor(low + (high - low) * share).cast("long"))


def last_n(df: DataFrame, by: Sequence[str], seq: str, n: int = 200) -> DataFrame:
    return top_per(df, n, by, F.desc(seq), name="__place").drop("__place")


def line_windows(n_lines: Column, size: int = 120, overlap: int = 8) -> Column:
    """Array of (start, end) of line windows with overlap; one for up to ``size`` lines, none for no lines."""
    step = size - overlap
    starts = F.when(n_lines <= size, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), n_lines - overlap, F.lit(step).cast("long")))
    ends = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, n_lines).alias("end")))
    return F.when(n_lines > 0, ends).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def merge_history(disk: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """Union of both by key, memory before disk."""
    both = memory.withColumn("__from", F.lit(0)).unionByName(disk.withColumn("__from", F.lit(1)))
    return best_evidence(both, key, "__from").drop("__from")


def ordered_distinct(df: DataFrame, key: str, seq: str) -> DataFrame:
    """First occurrence of each key, in order."""
    return best_evidence(df, key, seq).orderBy(seq)


def covered_before(reads: DataFrame, by: Sequence[str], least: float = 0.6, seq: str = "seq", start: str = "start", end: str = "end") -> DataFrame:
    """``reads`` with ``covered``: whether an earlier one (smaller ``seq``) of the same group covers at least this share of it.

    A group's reads go through one pass in order, which keeps the earlier ones
    sorted by their start with the furthest end so far, so a read looks at
    those alone that begin before its end and reach far enough. Reads of an
    agent on a file are few; groups stream, and none is collected for another.
    """
    import bisect

    from pyspark.sql import types as T

    names = [*by, seq, start, end]
    schema = T.StructType([*reads.schema.fields, T.StructField("covered", T.BooleanType())])

    def run(parts):
        key, kept = None, []
        for part in parts:
            out = []
            for row in part[names].itertuples(index=False, name=None):
                own, (a, b) = row[: len(by)], row[-2:]
                if own != key:
                    key, kept = own, []
                need = least * (b - a + 1)
                # What begins after b + 1 - need shares too little with it.
                upto = bisect.bisect_right(kept, (b + 1 - need + 1e-9, float("inf")))
                out.append(any(min(y, b) - max(x, a) + 1 >= need for x, y in kept[:upto]))
                # A read inside one that is kept never covers more than that one.
                at = bisect.bisect_right(kept, (a, float("inf")))
                if not any(y >= b for _, y in kept[:at]):
                    kept = [(x, y) for x, y in kept if not (x >= a and y <= b)]
                    bisect.insort(kept, (a, b))
            yield part.assign(covered=out)

    return reads.repartition(*by).sortWithinPartitions(*by, seq).mapInPandas(run, schema)


def overlapped_reads(reads: DataFrame, by: Sequence[str], least: float = 0.6) -> DataFrame:
    """Reads (``seq``, ``start``, ``end``) of which an earlier one of the same group covers at least this share."""
    return covered_before(reads, by, least).where("covered").drop("covered")
