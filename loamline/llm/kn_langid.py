"""Language identification by interpolated Kneser-Ney character models.

A model per language over the characters of words (runs of letters, lower
case, with start and end marks), kept in sorted arrays of hashes. A text gets
the language of the lowest cross-entropy per character. Texts whose
cross-entropy is far above what texts of that language show that its model
hasn't learned are marked as rejected.

The models are sent to the workers whole up to a number of grams. Beyond it
they stay in shards by the third character of a gram, which hold all that the
orders from 2 to 4 need, and the texts' distinct grams are joined with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.llm.storage import materialise
from loamline.llm.words import MAX_CACHED, mix, remainder, slices

RUNS = re.compile(r"[^\W\d_]+").findall
START, END = "\x01", "\x02"
ORDER, UNIT = 4, 16
DISCOUNT = 0.75


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower case; numerals that aren't decimal digits are no letters."""
    if not text:
        return []
    found = RUNS(text.lower())
    if "".join(found).isalpha():
        return found
    return "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams (four 16-bit code units packed in 64 bits) of the marked words, and how many each word has."""
    flat = np.frombuffer("".join([START * (ORDER - 1) + w + END for w in words]).encode("utf-16-le"), "<u2").astype(np.uint64)
    packed = flat.copy()
    for i in range(1, ORDER):
        packed[i:] |= flat[:-i] << np.uint64(UNIT * i)
    count = np.array([len(w) + 1 for w in words], np.int64)
    if any(ord(c) > 0xFFFF for w in words for c in w):
        count = np.array([len(w.encode("utf-16-le")) // 2 + 1 for w in words], np.int64)
    return packed[flat != ord(START)], count


@dataclass
class Table:
    """Sorted hashes with their values; absent hashes have value 0."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        h = mix(keys)
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(keys), np.float32)
        h = mix(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], 0)


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` characters of packed grams."""
    return keys & np.uint64((1 << (UNIT * n)) - 1) if n < 4 else keys


class Language:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left contexts below.

    ``lowest`` has the characters and their numbers of left contexts where
    ``keys`` are those of a shard.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lowest: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels: list[tuple[Table, Table, Table]] = []  # from order 1: count of gram, total and types of context
        for n in range(ORDER, 0, -1):
            if n == 1 and lowest is not None:
                keys, counts = lowest
            context = keys >> np.uint64(UNIT)
            _, first, where = np.unique(context, return_index=True, return_inverse=True)
            total, types = np.bincount(where, counts), np.bincount(where)
            self.levels.insert(0, (Table.of(keys, counts), Table.of(context[first], total), Table.of(context[first], types)))
            if n > 1:
                keys, counts = np.unique(_low(keys, n - 1), return_counts=True)

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each gram's last character given the ones before."""
        p = np.full(len(keys), 1 / 2**UNIT)
        for n, (count, total, types) in enumerate(self.levels, 1):
            own = _low(keys, n)
            context = own >> np.uint64(UNIT)
            t = total.get(context)
            seen = t > 0
            p[seen] = ((np.maximum(count.get(own) - DISCOUNT, 0) + DISCOUNT * types.get(context) * p) / np.maximum(t, 1))[seen]
        return np.log10(p)


class Scorer(dict):
    """Word -> row of the matrix of its log probabilities, one column per language."""

    def __init__(self, models: list[Language]):
        super().__init__()
        self.models = models
        self.rows = np.zeros((1 << 16, len(models)))
        self.units = np.zeros(1 << 16, np.int64)

    def prepare(self, texts: list[list[str]]) -> None:
        """Make sure of the words of some texts at once: learning words one text at a time costs far more."""
        every = set().union(*texts)
        new = [w for w in every if w not in self]
        if len(self) + len(new) > MAX_CACHED:
            self.clear()
            new = list(every)
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])

    def learn(self, words: list[str]) -> None:
        at, need = len(self), len(self) + len(words)
        if need > len(self.units):
            self.rows = np.concatenate([self.rows, np.zeros((need, self.rows.shape[1]))])
            self.units = np.concatenate([self.units, np.zeros(need, np.int64)])
        keys, count = grams(words)
        distinct, where = np.unique(keys, return_inverse=True)
        start = np.cumsum(count) - count
        for i, model in enumerate(self.models):
            self.rows[at:need, i] = np.add.reduceat(model.logp(distinct)[where], start)
        self.units[at:need] = count
        self.update(zip(words, range(at, need)))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Log probabilities by language and number of characters, end marks included, of prepared words."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0), int(self.units[at].sum())


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``tuning``, ``gram``, ``n`` over the whole texts of rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, bool], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, tuning), seen in words.items():
                if seen:
                    keys, count = grams(list(seen))
                    distinct, where = np.unique(keys, return_inverse=True)
                    n = np.bincount(where, np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), count)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([tuning] * len(n)), pa.array(distinct.view(np.int64)), pa.array(n)], names=["lang", "tuning", "gram", "n"])
            words.clear()

        for batch in slices(batches):
            for lang, tuning, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "tuning", "text"))):
                words.setdefault((lang, tuning), Counter()).update(letters(text))
            if sum(map(len, words.values())) > MAX_CACHED:
                yield from rows()
        yield from rows()

    counted = docs.where("lang is not null and text is not null").select("lang", "tuning", "text").mapInArrow(run, "lang string, tuning boolean, gram long, n long")
    return counted.groupBy("lang", "tuning", "gram").agg(F.sum("n").alias("n"))


def by_language(langs: pa.Array, keys: np.ndarray, n: np.ndarray, lowest: dict | None = None) -> dict[str, Language]:
    """A model per language, from its grams (distinct) and their counts."""
    langs = langs.dictionary_encode()
    own, models = langs.indices.to_numpy(), {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        k, c = keys[own == i], n[own == i]
        by = np.argsort(k)
        models[lang] = Language(k[by], c[by].astype(np.float64), lowest and lowest[lang])
    return models


def cross_entropies(docs: DataFrame, counts: DataFrame, carried: list[str], most_types: int, shard_types: int = 500_000) -> tuple[DataFrame, list[str]]:
    """The ``carried`` columns, ``n_scored`` (characters, end marks included) and ``logp`` (log10 by language) of every row, and the languages in order.

    Up to ``most_types`` grams go to the workers as they are; the other way
    gives the same numbers but for rounding.
    """
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("n_scored", T.LongType()), T.StructField("logp", T.ArrayType(T.DoubleType()))])
    if counts.count() > most_types:
        return _sharded(docs, counts, names, carried, shard_types), names
    table = counts.toArrow()
    models = by_language(table.column("lang").combine_chunks(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast([models[x] for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            texts = [letters(t) if names else [] for t in batch.column("text").to_pylist()]
            scorer.prepare(texts)
            out = [scorer(words) if words else (np.zeros(len(names)), 0) for words in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array([n for _, n in out], pa.int64()), pa.array([p for p, _ in out], pa.list_(pa.float64()))], names=schema.fieldNames())

    return docs.select(*carried, "text").mapInArrow(run, schema), names


def _sharded(docs: DataFrame, counts: DataFrame, names: list[str], carried: list[str], shard_types: int) -> DataFrame:
    """What ``cross_entropies`` gives, from models in shards: no process holds a whole one."""
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(c, k) for c, k in (("n_scored", T.LongType()), ("grams", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())))])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units, keys, times = [], [], []
            for text in batch.column("text").to_pylist():
                own, count = grams(letters(text))
                k, n = np.unique(own, return_counts=True)
                units.append(int(count.sum()))
                keys.append(k.view(np.int64))
                times.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(units, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=schema.fieldNames())

    rows = materialise(docs.select(*carried, "text").mapInArrow(taken, schema).withColumn("row", F.monotonically_increasing_id()), "langid-grams-of-rows")
    each = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
    # A character's numbers of left contexts: at most 65 536 rows a language.
    pairs = counts.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 2 * UNIT) - 1)).alias("pair")).distinct()
    singles = pairs.groupBy("lang", F.col("pair").bitwiseAND(F.lit((1 << UNIT) - 1)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "c").collect()
    lowest = {x: (np.array([r.c for r in singles if r.lang == x], np.uint64), np.array([float(r.n) for r in singles if r.lang == x])) for x in names}
    shared = docs.sparkSession.sparkContext.broadcast(lowest)
    shards = max(1, -(-counts.count() // shard_types))
    shard = F.pmod(F.xxhash64(F.shiftright("gram", UNIT).bitwiseAND(F.lit((1 << UNIT) - 1))), F.lit(shards)).alias("shard")
    learned = counts.select(shard, F.lit(0).alias("side"), "lang", "gram", "n")
    asked = each.select("gram").distinct().select(shard, F.lit(1).alias("side"), F.lit(None).cast("string").alias("lang"), "gram", F.lit(0).cast("long").alias("n"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, models = None, [], None
        nothing = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("side").to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cut], [*cut, len(key)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[a] >> 1 != own:
                    own, parts, models = key[a] >> 1, [], None
                if not key[a] & 1:
                    parts.append(part.select(["lang", "gram", "n"]))
                    continue
                if models is None:
                    table = pa.Table.from_batches(parts) if parts else None
                    found = by_language(table.column("lang").combine_chunks(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy(), shared.value) if parts else {}
                    models, parts = [found.get(x) or Language(*nothing, shared.value[x]) for x in names], []
                keys = part.column("gram").to_numpy().view(np.uint64)
                logp = np.stack([m.logp(keys) for m in models], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("gram"), pa.array(list(logp), pa.list_(pa.float64()))], names=["gram", "logp"])

    by_gram = learned.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(scored, "gram long, logp array<double>")
    sums = each.join(by_gram, "gram").groupBy("row").agg(*[F.sum(F.col("times") * F.col("logp")[i]).alias(f"p{i}") for i in range(len(names))])
    sums = sums.select(F.col("row").alias("of"), F.array(*[F.col(f"p{i}") for i in range(len(names))]).alias("logp"))
    return rows.join(sums, rows.row == sums.of, "left").select(*carried, "n_scored", "logp")


def _judged(scored: DataFrame, names: list[str], carried: list[str]) -> DataFrame:
    """``lang_pred``, ``score``, ``cross_entropy`` and ``n_scored`` beside the ``carried`` columns."""
    schema = T.StructType([scored.schema[c] for c in carried] + list(T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, n_scored long")))
    fields = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for logp, units in zip(batch.column("logp").to_pylist(), batch.column("n_scored").to_pylist()):
                if not units or not names:
                    out.append(("und", 0.0, None, 0))
                    continue
                logp = np.array(logp)
                best = int(logp.argmax())
                share = 1 / np.exp(np.log(10) * np.maximum(-700 / np.log(10), (logp - logp[best]) / units * min(units, 64))).sum()
                out.append((names[best], float(share), float(-logp[best] / units), units))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64())))], names=fields)

    return scored.select(*carried, "logp", "n_scored").mapInArrow(run, schema)


def identify(docs: DataFrame, parts: int = 5, held_out: int = 0, deviations: float = 4.0, most_types: int = 3_000_000) -> DataFrame:
    """Learn from ``lang`` and predict it.

    In: ``doc_id``, ``text``, ``lang``; other columns are ignored, whatever
    their names. Rows whose crc32 of the id mod ``parts`` is ``held_out``, or
    whose language is null, teach nothing. Out, one row per input row:
    ``doc_id``, ``held_out`` (null id: false), ``lang_pred``, ``score`` (0 to 1,
    the share of the best language), ``cross_entropy`` (bits of ten per
    character) and ``rejected``: above the usual one for that language by
    ``deviations`` times what is usual for a text of its length. What is usual
    comes from an eighth of the training rows and models that haven't learned
    these; the models that predict have learned all training rows.

    ``und`` with score 0 for a text that is null or without letters, and where
    no language was learned. Ties go to the language first in code point order.
    Repeated rows count each time; long texts are read whole; an empty table
    gives an empty one.
    """
    aside = F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False))
    tuning = F.coalesce(remainder("doc_id", 2 * parts) == held_out + 1, F.lit(False))  # not held out, since 2 * parts is a multiple of parts
    rows = docs.select("doc_id", "text", "lang", aside.alias("held_out"), tuning.alias("tuning"))
    counts = materialise(count_grams(rows.where("not held_out")), "langid-grams")
    every = materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-all")
    scored, names = cross_entropies(rows, every, ["doc_id", "held_out"], most_types)
    out = materialise(_judged(scored, names, ["doc_id", "held_out"]), "langid-scored")
    tried = _judged(*cross_entropies(rows.where("tuning"), counts.where("not tuning").select("lang", "gram", "n"), ["tuning"], most_types), ["tuning"])
    # A text's cross-entropy varies about the usual one with 1 / sqrt(length).
    h, n = F.col("cross_entropy"), F.col("n_scored")
    usual = tried.where(n > 0).groupBy(F.col("lang_pred").alias("of")).agg(F.count(F.lit(1)).alias("texts"), (F.sum(h * n) / F.sum(n)).alias("mean"), F.sum(n * h * h).alias("squares"), F.sum(n).alias("all_n"))
    limits = usual.select("of", "mean", F.sqrt(F.greatest((F.col("squares") - F.col("mean") ** 2 * F.col("all_n")) / F.col("texts"), F.lit(0.0))).alias("spread"))
    out = out.join(F.broadcast(limits), out.lang_pred == limits.of, "left")  # a row per learned language
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(h > F.col("mean") + deviations * F.col("spread") / F.sqrt(n), F.lit(False)).alias("rejected"))
