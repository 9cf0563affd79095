import math
import random
import zlib

import numpy as np
import xxhash

from loamline.llm import pu_toxicity as P
from tests.llm.helpers import DOCS, awkward, empty, sentence

LABELS = "doc_id long, quality int, toxic int"
BAD = ["idiotic", "scummy", "vileness"]


def corpus(n=900):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, 120, "abcde").split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(120)] = rng.choice(BAD).capitalize() + "!"
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_texts(spark):
    docs, labels = corpus()
    toxic = {i for i, *_ in docs if i % 8 == 0}
    out = P.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    right = sum((r.predicted == 1) == (r.doc_id in toxic) for r in held)
    assert right / len(held) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in out)


def scores(spark, docs, labels):
    return {r.doc_id: r.score for r in P.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    assert scores(spark, docs, labels) == scores(spark, docs, flipped)


def test_risk_stays_non_negative_on_separable_texts():
    one, none = np.array([0]), np.empty(0, np.int64)
    w = P.train([one] * 60, [none] * 300 + [one] * 30, 1, 0.1)
    assert w[0] + w[1] > 0 > w[1]


def plain_train(positive, unlabelled, n, prior, rounds):
    """The definition, text by text and feature by feature."""
    logistic = lambda f: 1 / (1 + math.exp(-f))
    w, b, m, v = [0.0] * n, math.log(prior / (1 - prior)), [0.0] * (n + 1), [0.0] * (n + 1)
    every = positive + unlabelled
    share = [sum(i in x for x in every) / len(every) for i in range(n)]
    for t in range(1, rounds + 1):
        f = lambda x: b + sum(w[i] for i in x)  # noqa: B023, E731
        risk = sum(math.log1p(math.exp(f(x))) for x in unlabelled) / len(unlabelled) - prior * sum(math.log1p(math.exp(f(x))) for x in positive) / len(positive)
        g = [0.0] * (n + 1)
        for x in positive:
            s = logistic(f(x))
            d = -prior * (1 - s) / len(positive) - prior * s / len(positive) if risk >= 0 else prior * s / len(positive)
            for i in [*x, n]:
                g[i] += d
        for x in unlabelled:
            d = logistic(f(x)) / len(unlabelled) * (1 if risk >= 0 else -1)
            for i in [*x, n]:
                g[i] += d
        for i in range(n + 1):
            own = g[i] + (1e-4 * w[i] if i < n else 0)
            m[i], v[i] = 0.9 * m[i] + 0.1 * own, 0.999 * v[i] + 0.001 * own * own
            step = 0.05 * (1 / math.sqrt(1 + 20 * share[i]) if i < n else 0.3) * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-6)
            if i < n:
                w[i] -= step
            else:
                b -= step
    return [*w, b]


def test_training_equals_a_plain_loop():
    rng = random.Random(7)
    positive = [sorted({0, *rng.sample(range(6), 2)}) for _ in range(9)]
    unlabelled = [sorted(rng.sample(range(6), rng.randint(0, 3))) for _ in range(40)] + positive[:4]
    as_arrays = lambda texts: [np.array(x, np.int64) for x in texts]
    for rounds in (1, 30, 200):  # the corrected risk turns negative on the way
        assert np.allclose(P.train(as_arrays(positive), as_arrays(unlabelled), 6, 0.2, rounds), plain_train(positive, unlabelled, 6, 0.2, rounds), atol=1e-8)


def test_counts_and_features_equal_brute_force(spark):
    docs, labels = corpus(400)
    rows, prior = P._flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), 4000, 4, 2)
    teach = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2}
    toxic = {i for i, _, t in labels if t and i in teach}
    assert abs(prior - len(toxic) / sum(i in teach for i, *_ in labels)) < 1e-9
    texts = {i: P.features(t) for i, t, *_ in docs if i in teach}
    want = {w: (sum(w in x for x in texts.values()), sum(w in texts[i] for i in toxic)) for w in set().union(*texts.values())}
    counts = P.count_words(rows)
    got = {r.word % 2**64: (r.n, r.n_positive) for r in counts.collect()}
    assert got == {xxhash.xxh64_intdigest(w): n for w, n in want.items()} | {0: (len(texts), len(toxic))}
    u, p = len(texts), len(toxic)
    chosen = set()
    for w, (n, k) in want.items():
        pooled = (n + k) / (u + p)
        if n >= 5 and abs(k / p - n / u) >= 4 * math.sqrt(max(pooled * (1 - pooled), 1e-12) * (1 / p + 1 / u)):
            chosen.add(xxhash.xxh64_intdigest(w))
    assert set(P.telling_words(counts).tolist()) == chosen and {xxhash.xxh64_intdigest(w) for w in BAD} <= chosen


def test_all_unlabelled_texts_take_part(spark):
    docs, labels = corpus(600)
    rows, prior = P._flagged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), 4000, 4, 2)
    words = P.telling_words(P.count_words(rows))
    own = P.described(rows, words)
    texts = [np.frombuffer(r.numbers, "<i4") for r in own.where("teaches").collect()]
    positive = [np.frombuffer(r.numbers, "<i4") for r in own.where("positive").collect()]
    one = P.train(positive, texts, len(words), prior)
    got = P.fit(own, words, prior, block=10_000)
    assert np.allclose(np.append(got.weights, got.bias), one)
    seen = []
    for block, trainers in ((100, 256), (100, 1)):  # several trainers, and one of several blocks
        got = P.fit(own, words, prior, block=block, most_trainers=trainers)
        seen.append(got.bias)
        assert np.abs(got.weights - one[:-1]).max() < 2
    assert P.fit(own.where("not positive"), words, prior).bias == -4.0


def test_awkward_rows(spark):
    labels = [(4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (6, 0, 0), (999, 1, 1)]
    out = P.toxicity(awkward(spark), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == awkward(spark).count() and not any(r.held_out for r in out if r.doc_id is None)
    assert P.toxicity(empty(spark), spark.createDataFrame(labels, LABELS)).collect() == []
    assert len(P.toxicity(awkward(spark), spark.createDataFrame([], LABELS)).collect()) == awkward(spark).count()
