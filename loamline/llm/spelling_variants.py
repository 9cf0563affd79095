"""Spelling variants by pairless wildcard groups.

Two words are near if one inserted, deleted or replaced code point parts them.
Words that differ at one position share a (position, prefix, suffix) group; a
word that lacks one code point of another one is that one's deletion. A group
keeps its size and its two most frequent words, which is all that its members
need: each has size - 1 near words in it, the most frequent of which is the
first, or the second for the first itself. So no pair is ever made, and a group
can't grow beyond the letters of the alphabet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.storage import discard, materialise

#: Letters of a run; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the replaced code point in a group's key; no letter, so a key tells position, prefix and suffix.
WILD = "*"
WILDCARD, DELETION, ITSELF = 0, 1, 2


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, slip: int = 31) -> DataFrame:
    """Distinct words and how often they occur: ``word``, ``n``.

    In: ``doc_id``, ``text``; other columns are ignored. A word is a maximal
    run of letters, lower-cased in A-Z. Every run whose crc32 of
    ``<doc_id>:<run>`` is divisible by ``slip`` loses the code point at that
    crc32 modulo its length, a slip of the pen that is the same in every run of
    the job; with ``slip`` 0 none does. A null id counts as an empty one, a
    null text has no words. Runs too short to matter are never made rows, and
    words are counted before they are exchanged.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    words = words.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if slip:
        drawn = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        lost = (F.col("drawn") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), lost), F.substring("word", lost + 2, F.length("word")))
        words = words.withColumn("drawn", drawn).select(F.when(F.col("drawn") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def members(vocab: DataFrame) -> DataFrame:
    """The groups of every word: ``key``, ``role``, ``word``, ``n``.

    A word is in one wildcard group for each of its positions and in one
    deletion group for each different word that it becomes by losing a code
    point; there it meets that word itself, if there is such a word.
    """
    at = F.sequence(F.lit(1), F.length("word"))

    def without(put: str):
        return lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.lit(put), F.substring(F.col("word"), i + 1, F.length("word")))

    keys: list[tuple[int, Column]] = [(WILDCARD, F.transform(at, without(WILD))), (DELETION, F.array_distinct(F.transform(at, without("")))), (ITSELF, F.array("word"))]
    def tagged(role: int):
        return lambda key: F.struct(key.alias("key"), F.lit(role).alias("role"))

    keyed = F.concat(*[F.transform(k, tagged(role)) for role, k in keys])
    return vocab.select("word", "n", F.explode(keyed).alias("of")).select("of.key", "of.role", "word", "n")


def near(vocab: DataFrame) -> DataFrame:
    """How many near words each word has and the most frequent one: ``word``, ``n``, ``n_near``, ``best`` (``n``, ``word``; null if none).

    One exchange by the groups' keys, one by words. Ties of frequency go to
    the smaller word by code points.
    """
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("role") == ITSELF, F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.struct(F.col("n"), F.col("word"))
    rows = members(vocab).withColumns({
        "size": F.count(F.when(F.col("role") != ITSELF, 1)).over(group),
        "own": F.max(F.when(F.col("role") == ITSELF, F.col("n"))).over(group),
        "first": F.first(pair).over(ranked),
        "second": F.nth_value(pair, 2).over(ranked),
    })
    is_first = F.col("first.word") == F.col("word")
    others = F.when(F.col("role") == WILDCARD, F.col("size") - 1).when(F.col("role") == DELETION, F.col("own").isNotNull().cast("long")).otherwise(F.col("size"))
    best = F.when(F.col("role") == WILDCARD, F.when(is_first, F.col("second")).otherwise(F.col("first"))).when(F.col("role") == DELETION, F.struct(F.col("own").alias("n"), F.col("key").alias("word"))).otherwise(F.col("first"))
    rows = rows.select("word", "n", "role", others.alias("others"), best.alias("best")).where(f"others > 0 OR role = {ITSELF}")
    top = F.min(F.when(F.col("others") > 0, F.struct((-F.col("best.n")).alias("less"), F.col("best.word").alias("word"))))
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("others").alias("n_near"), top.alias("top")).select("word", "n", "n_near", F.struct((-F.col("top.less")).alias("n"), F.col("top.word").alias("word")).alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word``, ``root``: where the forms lead to.

    In: a stored table ``word``, ``form`` of the words that have one. ``most``
    is the largest count of a word. A form occurs ten times as often as its
    word, so a chain has at most log10(most) steps, and doubling what each row
    knows needs the logarithm of that many joins.
    """
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.ceil(math.log10(max(2, most))))))):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        past, known = known, materialise(known.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots", few=True)
        discard(past)
    return known


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, slip: int = 31, ratio: int = 10) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the most frequent near word if it is ``ratio`` (at least 10)
    times as frequent, else null; ``root`` is the end of the chain of forms, or
    the word itself. Repeated rows count each, ids may repeat, ties go to the
    smaller word, words of any length are taken whole, and an empty table gives
    no rows.
    """
    if ratio < 10:
        raise ValueError("chains are bounded for a ratio of at least 10")
    vocab = materialise(vocabulary(docs, min_length, min_count, slip), "spelling-words")
    formed = F.col("best.n") >= ratio * F.col("n")
    found = near(vocab).select("word", "n", "n_near", F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n"))
    found = materialise(found, "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 0
    forms = materialise(found.where("form IS NOT NULL").select("word", "form"), "spelling-links", few=True)
    return found.join(roots(forms, most), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
