import random
import zlib
from collections import Counter

import numpy as np

from loamline.llm import gru_lm as G
from tests.llm.helpers import DOCS, awkward, empty


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows):
    """Brute-force counts and unigram scores of (id, text)."""
    c = Counter(t for i, x in rows if i is None or zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(np.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for _, x in rows]


def corpus(n=400):
    rng = random.Random(2)
    left, right = [f"le{i}" for i in range(40)], [f"ri{i}" for i in range(40)]
    return [(i, " ".join(rng.choice(left if i % 2 else right) for _ in range(rng.randint(5, 80))), "en", "s", 0) for i in range(n)]


def test_counts_base_and_gain(spark):
    rows = corpus()
    out = {r.doc_id: r for r in G.score(spark.createDataFrame(rows, DOCS).repartition(3), streams=2).collect()}
    for (i, *_), (n, known, total, score) in zip(rows, base([r[:2] for r in rows])):
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - score) < 1e-6 * abs(score)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_units_sum_to_one():
    net = G.Gru.initial(np.arange(G.UNITS, dtype=float), 3)
    h = np.random.default_rng(1).normal(0, 0.5, (3, G.HIDDEN)).astype(np.float32)
    for row in h:
        p = net.log10(np.repeat(row[None], G.UNITS, 0), np.arange(G.UNITS))
        assert abs((10.0**p).sum() - 1) < 1e-3


def test_words_of_a_unit_sum_to_one(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}x{i % 7}".encode()), 1 + i % 5) for i in range(3000)], "word binary, n long")
    lex = G.lexicon(counts)
    total = np.zeros(G.UNITS)
    for w, i in lex.hot.items():
        total[lex.hot_unit[i]] += 10 ** lex.hot_within[i]
    unseen = np.where(lex.unit_size != 0, G.ADD / 10**lex.unit_size, 0)
    used = total > 0
    assert np.allclose((total + unseen)[used], 1, atol=1e-9)


def plain_step(net, x, h):
    """A step of the network by its definition, one row at a time."""
    k = G.HIDDEN
    if x == G.UNITS:
        h = np.zeros_like(h)
    a, g = net.X[x], h @ net.U
    z, r = (1 / (1 + np.exp(-(a[i : i + k] + g[i : i + k]))) for i in (0, k))
    n = np.tanh(a[2 * k :] + r * g[2 * k :])
    return (1 - z) * h + z * n


def plain_log10(net, h, unit):
    c, m = divmod(int(unit), G.MEMBERS)
    x, y = np.exp(h @ net.Wc + net.bc), np.exp(h @ net.Wu[c] + net.bu[c])
    return np.log10(x[c] / x.sum()) + np.log10(y[m] / y.sum())


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = G.Gru(G.Gru.initial(rng.random(G.UNITS) * 9, 5).flat.astype(np.float64))
    x, y = rng.integers(0, G.UNITS, (4, 3)), rng.integers(0, G.UNITS, (4, 3))
    y[3, 1], x[2, 0] = -1, G.UNITS  # no target here, a new text there
    h = rng.normal(0, 0.3, (3, G.HIDDEN))

    def loss():
        out = []
        for j in range(3):
            s = h[j]
            for t in range(4):
                s = plain_step(net, x[t, j], s)
                if y[t, j] >= 0:
                    out.append(-plain_log10(net, s, y[t, j]) * np.log(10))
        return np.mean(out)

    grad, last = net.gradient(x, y, h)
    assert np.allclose(last[1], plain_step(net, x[3, 1], plain_step(net, x[2, 1], plain_step(net, x[1, 1], plain_step(net, x[0, 1], h[1])))))
    for name in G.Gru.SHAPES:
        p, g = getattr(net, name), getattr(grad, name)
        for at in (np.unravel_index(np.abs(g).argmax(), g.shape), np.unravel_index(g.argmin(), g.shape)):
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])) + 1e-6


def test_scores_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    net = G.Gru.initial(rng.random(G.UNITS) * 9, 6)
    net.U *= 3
    texts = [rng.integers(0, G.UNITS, n) for n in (1, 200, 64, 65, 3, 1000, 32, 33, 31)]
    for streams in (1, 2, 4, 100):
        for t, s in zip(texts, G.score_units(net, texts, streams)):
            h, want = np.zeros(G.HIDDEN), 0.0
            for before, now in zip([G.UNITS, *t[:-1]], t):
                h = plain_step(net, before, h)
                want += plain_log10(net, h, now)
            assert abs(s - want) < 1e-3 * abs(want)
    assert len(G.score_units(net, [])) == 0


def test_windows_hold_every_token_once():
    rng = np.random.default_rng(5)
    texts = {k: np.append(G.UNITS, rng.integers(0, G.UNITS, n)) for k, n in enumerate((1, 40, 32, 31, 33, 500, 2, 1, 1, 64, 7, 90))}
    for streams in (1, 3, 50):
        got, ends = {k: [] for k in texts}, {}
        for x, y, key, came in G.windows(iter(texts.items()), streams):
            assert x.shape == y.shape == key.shape and x.shape[1] <= streams
            for j in range(x.shape[1]):
                before = ends.get(came[j]) if came[j] >= 0 else None
                for t in range(len(x)):
                    if y[t, j] >= 0:
                        k = int(key[t, j])
                        assert x[t, j] == (got[k][-1] if got[k] else G.UNITS) and (not got[k] or before == k)
                        got[k].append(y[t, j])
                        before = k
            ends = {j: int(key[-1, j]) for j in range(x.shape[1])}
        assert all(got[k] == texts[k][1:].tolist() for k in texts)


def test_one_step_moves_weights_by_the_definition():
    rng = np.random.default_rng(6)
    net = G.Gru.initial(rng.random(G.UNITS) * 9, 7)
    start, text = net.flat.copy(), np.append(G.UNITS, rng.integers(0, G.UNITS, 20)).astype(np.int16)
    x, y = text[:-1].reshape(-1, 1), text[1:].reshape(-1, 1)
    grad, _ = G.Gru(start.copy()).gradient(x, y, np.zeros((1, G.HIDDEN), np.float32))
    assert G.learn(net, iter([text]), 0.01, 4) == 20
    g = np.clip(grad.flat, -0.1, 0.1).astype(np.float64)
    step = 0.01 / 20 * np.sqrt(0.001) / 0.1 * (0.1 * g) / (np.sqrt(0.001 * g * g) + 1e-7)
    assert np.allclose(net.flat, start - step, atol=2e-6)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    out = G.score(awkward(spark)).collect()
    assert len(out) == len(rows)
    want = sorted((n, k, t, round(s, 6)) for n, k, t, s in base(rows))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(np.isfinite(r.score) for r in out)
    assert G.score(empty(spark)).collect() == []


def test_all_tokens_of_a_text_are_learned(spark):
    rows = [(i, " ".join(["early"] * 64 + ["middle"] * 900 + ["late"] * 64), "en", "s", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    lex = G.lexicon(G.count_words(docs))
    texts = G._units(docs, spark.sparkContext.broadcast(lex))
    for r in texts.collect():
        assert len(np.frombuffer(r.units, "<i2")) == 1 + r.tokens == 2 + 128 + 900
    before = G.Gru.initial(lex.mass)
    after = G._train(texts, before, 1, 0.01, 4)
    for word in (b"early", b"middle", b"late"):
        run = [np.full(500, int(lex.numbers([word])[0][0]))]
        assert G.score_units(after, run)[0] > G.score_units(before, run)[0]


def test_scoring_reads_units_and_no_text(spark):
    rows = [(1, "a b a", "en", "s", 0), (2, None, "en", "s", 0), (3, "Rare words a", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    lex = G.lexicon(G.count_words(docs.where("doc_id < 3")))
    net = G.Gru.initial(lex.mass)
    texts = G._units(docs.select("doc_id", "text"), spark.sparkContext.broadcast(lex))
    assert "text" not in texts.columns
    before = {r.doc_id: r for r in texts.collect()}
    after = {r.doc_id: r.net for r in G._scored(texts, spark.sparkContext.broadcast(net.flat)).collect()}
    assert {k: (r.tokens, r.hot, len(r.rare)) for k, r in before.items()} == {1: (4, 4, 0), 2: (1, 1, 0), 3: (4, 2, 2)}
    for k, r in before.items():
        units = np.frombuffer(r.units, "<i2")
        assert units[0] == G.UNITS and np.array_equal(units[1:], lex.numbers(tokens(rows[k - 1][1]))[0])
        assert np.isclose(after[k], r.net + G.score_units(net, [units[1:]])[0])


def test_long_texts_come_in_small_slices():
    import pyarrow as pa

    from loamline.llm.words import slices

    texts = ["a" * n for n in (10, 90, 5, 200, 1, 1, 1)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [part.column("text").to_pylist() for part in slices(iter([batch]), rows=3, size=100)]
    assert got == [texts[:2], texts[2:3], texts[3:4], texts[4:7], texts[7:]]
    assert [p.num_rows for p in slices(iter([batch.slice(0, 0)]))] == [0]


def test_sums_and_products_of_narrow_tables():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 1000):
        a, b = rng.normal(size=(n, 5)), rng.normal(size=(n, 7))
        assert np.allclose(G.crossed(a, b), a.T @ b) and np.allclose(G.row_sums(a), a.sum(axis=1))
