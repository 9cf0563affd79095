"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the distinct words of a text is trained in numpy from
confirmed toxic examples and unlabelled text. The risk of an unlabelled text
being called toxic is corrected by the class prior, and the corrected part is
kept from turning negative: where it does, the step goes the other way.

Words are counted over all texts that may teach, and the telling ones become
features. Every unlabelled text takes part: trainers stream blocks of them,
fit each block against the confirmed examples, and the fits are averaged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.storage import discard, materialise
from loamline.llm.words import MAX_CACHED, remainder, slices

LETTERS = re.compile(r"[^\W\d_]+").findall
#: Unlabelled texts of a block.
BLOCK = 10_000


def features(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(LETTERS(text.lower())) if text else set()


@dataclass
class Model:
    bias: float
    words: np.ndarray  # hashes of the features, sorted
    weights: np.ndarray

    def of(self, numbers: np.ndarray) -> float:
        return float(_sigmoid(np.array([self.bias + self.weights[numbers].sum()]))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the ``n`` features and the bias, from the feature numbers of the positive and of the unlabelled texts, by the logistic loss and Adam.

    Risk: prior * E_p[loss(f, +1)] + max(0, E_u[loss(f, -1)] - prior * E_p[loss(f, -1)]).
    """
    every, p, u = positive + unlabelled, len(positive), len(unlabelled)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    col = np.concatenate([*every, np.empty(0, np.int64)]).astype(np.int64)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    # Common words tell little and are in every text; their steps are shortened by their frequency.
    scale = np.append(1 / np.sqrt(1 + 20 * np.bincount(col, minlength=n) / len(every)), 0.3)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        f = b + np.bincount(row, w[col], len(every))
        s = _sigmoid(f)
        fit = np.concatenate([-prior / p * (1 - s[:p]), np.zeros(u)])
        other = np.concatenate([-prior / p * s[:p], s[p:] / u])
        loss = np.logaddexp(0, f)
        negative = loss[p:].mean() - prior * loss[:p].mean()
        g = fit + other if negative >= 0 else -other
        grad = np.append(np.bincount(col, g[row], n) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * scale * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return np.append(w, b)


def _flagged(docs: DataFrame, labels: DataFrame, most_positive: int, parts: int, held_out: int) -> tuple[DataFrame, float]:
    """``doc_id``, ``text``, ``teaches``, ``positive`` of every row, and the class prior.

    At most ``most_positive`` ids labelled as toxic, drawn by a hash, are
    positive: the bound on the labelled rows that the model is fitted on. The
    prior is the toxic share of all labelled ids that may teach.
    """
    usable = F.coalesce(remainder("doc_id", parts) != held_out, F.lit(False))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    prior = min(0.9, max(0.001, counts.t / counts.n)) if counts.n else 0.001
    positive = known.where("toxic = 1").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most_positive).select(F.col("doc_id").alias("__of"))
    rows = docs.select("doc_id", "text", usable.alias("teaches")).join(F.broadcast(positive), docs.doc_id == F.col("__of"), "left")  # bounded by the limit
    return rows.select("doc_id", "text", "teaches", F.col("__of").isNotNull().alias("positive")), prior


def count_words(rows: DataFrame) -> DataFrame:
    """``word`` (hash), ``n`` and ``n_positive``: texts that have it among those that teach, and among the positive ones; word 0 stands for any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def out() -> pa.RecordBatch:
            words = list(seen[False].keys() | seen[True].keys())
            hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in words], np.uint64).view(np.int64)
            n = [np.array([seen[positive][w] for w in words], np.int64) for positive in (False, True)]
            for counter in seen.values():
                counter.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n[0] + n[1]), pa.array(n[1])], names=["word", "n", "n_positive"])

        for batch in slices(batches):
            for text, positive in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist()):
                seen[positive].update(features(text) | {""})
            if sum(map(len, seen.values())) > MAX_CACHED:
                yield out()
        yield out()

    counted = rows.where("teaches").select("text", "positive").mapInArrow(run, "word long, n long, n_positive long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"))


def telling_words(counts: DataFrame, least_docs: int = 5, least_z: float = 4.0, most_words: int = 50_000) -> np.ndarray:
    """Sorted hashes of the words in at least ``least_docs`` texts whose shares among positive and all texts differ by ``least_z`` standard errors.

    With some 10^5 words, chance alone passes a handful. A model has at most
    ``most_words`` features, those that differ most; without positive texts it
    has none.
    """
    all_texts = counts.where("word = 0").select(F.col("n").alias("u"), F.col("n_positive").alias("p")).first()
    if all_texts is None or not all_texts.p:
        return np.empty(0, np.uint64)
    u, p = float(all_texts.u), float(all_texts.p)
    pooled = (F.col("n") + F.col("n_positive")) / (u + p)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / p + 1 / u))
    z = F.abs(F.col("n_positive") / p - F.col("n") / u) / error
    found = counts.where((F.col("word") != 0) & (F.col("n") >= least_docs) & (z >= least_z)).orderBy(F.desc(z), "word").limit(most_words).select("word").toArrow()
    return np.sort(found.column("word").to_numpy().view(np.uint64))


def described(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """``doc_id``, ``teaches``, ``positive`` and ``numbers``, the features of each row's whole text, ascending, as int32."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {int(h): i for i, h in enumerate(shared.value)}

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= MAX_CACHED:
                    self.clear()
                n = self[word] = number.get(xxhash.xxh64_intdigest(word), -1)
                return n

        of = Numbers().__getitem__
        for batch in slices(batches):
            out = [np.array(sorted({*map(of, features(t))} - {-1}), "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "teaches", "positive")), pa.array(out, pa.binary())], names=["doc_id", "teaches", "positive", "numbers"])

    return rows.mapInArrow(run, f"doc_id {kind}, teaches boolean, positive boolean, numbers binary")


def fit(rows: DataFrame, words: np.ndarray, prior: float, most_positive: int = 4000, block: int = BLOCK, most_trainers: int = 256) -> Model:
    """The mean, by texts, of the fits of all blocks of unlabelled texts, each against the positive ones.

    ``rows`` come from ``described``. Unlabelled are all rows that teach,
    positive ones included. Where a trainer's texts are no more than a block
    they are one. At most ``most_trainers`` send the sums of their fits.
    """
    order = F.xxhash64("doc_id", "numbers")
    positive = [np.frombuffer(r.numbers, "<i4") for r in rows.where("positive").orderBy(order, "doc_id").limit(most_positive).select("numbers").collect()]
    n = rows.where("teaches").count()
    if not positive or not n:
        return Model(-4.0, words, np.zeros(len(words)))
    shared = rows.sparkSession.sparkContext.broadcast(positive)
    trainers = max(1, min(most_trainers, n // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, held = np.zeros(len(words) + 1), 0, []
        for batch in batches:
            held += [np.frombuffer(x, "<i4") for x in batch.column("numbers").to_pylist()]
            while len(held) >= 3 * block // 2:  # what is left is at least half a block
                total += block * train(shared.value, held[:block], len(words), prior)
                seen, held = seen + block, held[block:]
        if held:
            total += len(held) * train(shared.value, held, len(words), prior)
            seen += len(held)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    dealt = rows.where("teaches").select(order.alias("slot"), "numbers").repartition(trainers, "slot").sortWithinPartitions("slot", "numbers").select("numbers")
    total, seen = np.zeros(len(words) + 1), 0
    trained = materialise(dealt.mapInArrow(run, "n long, total binary"), "pu-trained")
    for row in trained.orderBy("n", "total").toLocalIterator():
        total, seen = total + np.frombuffer(row.total), seen + row.n
    discard(trained)
    return Model(float(total[-1] / seen), words, total[:-1] / seen)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_positive: int = 4000, parts: int = 4, held_out: int = 2) -> DataFrame:
    """Learn from ``labels`` and score every document.

    In: ``doc_id``, ``text`` and ``doc_id``, ``toxic``; other columns are
    ignored, whatever their names. Labels of ids whose crc32 mod ``parts`` is
    ``held_out`` are never used, nor are those rows' texts. Out, one row per
    input row: ``doc_id``, ``held_out`` (null id: false), ``score``,
    ``predicted``. Labels that contradict one another count as toxic; null
    labels are none; a document may be without a label. Null and empty texts
    get the score of no words at all; long texts are read whole; repeated rows
    teach each time and get equal scores. Without a toxic label the scores are
    constant. An empty table gives an empty one.
    """
    rows, prior = _flagged(docs, labels, most_positive, parts, held_out)
    counts = materialise(count_words(rows), "pu-counts")
    words = telling_words(counts)
    rows = materialise(described(rows, words), "pu-rows")
    discard(counts)
    model = fit(rows, words, prior, most_positive)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [shared.value.of(np.frombuffer(x, "<i4")) for x in batch.column("numbers").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = rows.select("doc_id", "numbers").mapInArrow(run, f"doc_id {kind}, score double")
    aside = F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
