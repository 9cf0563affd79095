import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loamline.llm import kn_langid as K
from tests.llm.helpers import DOCS, awkward, empty

LANGS = {"xx": "abcdef", "yy": "defghi", "zz": "ghijabé"}


def corpus(n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        text = " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 40)))
        rows.append((i, text.title() if i % 2 else text, lang, "s", 0))
    return rows


def brute(words, order=4, d=K.DISCOUNT):
    """Interpolated Kneser-Ney by dictionaries: log10 probability of a word."""
    counts = [defaultdict(float) for _ in range(order + 1)]
    for w, n in words.items():
        s = K.START * (order - 1) + w + K.END
        for i in range(order - 1, len(s)):
            counts[order][s[i - order + 1 : i + 1]] += n
    for k in range(order - 1, 0, -1):
        for g in {x for x in counts[k + 1]}:
            counts[k][g[1:]] += 1

    def p(g):
        if not g:
            return 1 / 2**16
        own, low = counts[len(g)], p(g[1:])
        same = [v for x, v in own.items() if x[:-1] == g[:-1]]
        return (max(own.get(g, 0) - d, 0) + d * len(same) * low) / sum(same) if same else low

    def word(w):
        s = K.START * (order - 1) + w + K.END
        return sum(np.log10(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s)))

    return word


def test_same_as_dictionaries():
    words = {"abc": 5, "abd": 2, "b": 7, "cab": 1, "ßä": 3}
    keys, count = K.grams(list(words))
    distinct, where = np.unique(keys, return_inverse=True)
    model = K.Language(distinct, np.bincount(where, np.repeat(list(words.values()), count)))
    scorer, by_hand = K.Scorer([model]), brute(words)
    for w in ("abc", "ab", "zz", "cabd", "ß", "日本", "😀x"):
        if all(ord(c) < 65536 for c in w):
            scorer.prepare([[w]])
            got, units = scorer([w])
            assert abs(got[0] - by_hand(w)) < 1e-4 and units == len(w) + 1
        else:
            scorer.prepare([[w]])
            assert np.isfinite(scorer([w])[0]).all()


def test_probabilities_sum_to_one():
    keys, count = K.grams(["abcab", "bca", "cc"])
    distinct, where = np.unique(keys, return_inverse=True)
    model = K.Language(distinct, np.bincount(where).astype(float))
    context = distinct[3] & ~np.uint64(0xFFFF)
    every = context | np.arange(1 << 16, dtype=np.uint64)
    assert abs((10.0 ** model.logp(every)).sum() - 1) < 1e-4


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    rows.append((1000, " ".join(["qqqq", "wwww", "ppppp"] * 20), None, "s", 0))
    out = {r.doc_id: r for r in K.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = [(i, lang) for i, _, lang, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and lang]
    assert all(out[i].held_out for i, _ in held)
    assert sum(out[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert out[1000].rejected and sum(out[i].rejected for i, *_ in rows[:-1]) <= 3


def test_small_memory_changes_nothing(spark, monkeypatch):
    words = ["".join(p) for p in zip("abcabcab", "bcdbcdbc", "xyzxyzxy")]
    keys, count = K.grams(words)
    distinct, where = np.unique(keys, return_inverse=True)
    model = K.Language(distinct, np.bincount(where).astype(float))
    scorers = [K.Scorer([model]), K.Scorer([model])]
    scorers[0].prepare([words])
    want = [scorers[0]([w]) for w in words]
    monkeypatch.setattr(K, "MAX_CACHED", 2)
    for w, (logp, units) in zip(words, want):
        scorers[1].prepare([[w], ["other"]])
        got = scorers[1]([w])
        assert np.allclose(logp, got[0]) and units == got[1] and len(scorers[1]) <= 2


def test_models_in_shards_give_the_same(spark):
    rows = corpus(150) + [(900, None, "xx", "s", 0), (901, "½ 12", "xx", "s", 0), (902, "日本語 text 😀", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    whole, shards = ({r.doc_id: r for r in K.identify(docs, most_types=n).collect()} for n in (10**6, 100))
    assert len(whole) == len(shards) == len(rows)
    for i, r in whole.items():
        x = shards[i]
        assert (r.held_out, r.lang_pred, r.rejected) == (x.held_out, x.lang_pred, x.rejected) and abs(r.score - x.score) < 1e-6
        assert (r.cross_entropy is None) == (x.cross_entropy is None) and abs((r.cross_entropy or 0) - (x.cross_entropy or 0)) < 1e-6
    docs = docs.withColumn("tuning", F.lit(False))
    counts = K.materialise(K.count_grams(docs).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "t")
    a, names = K.cross_entropies(docs, counts, ["doc_id"], 10**6)
    b = K._sharded(docs, counts, names, ["doc_id"], 50)
    got = {r.doc_id: r for r in b.collect()}
    for r in a.collect():
        assert r.n_scored == got[r.doc_id].n_scored and (not r.n_scored or np.allclose(r.logp, got[r.doc_id].logp, rtol=1e-5))


def test_letters():
    assert K.letters("Ab3c ½②x _é-ÜB١ 日本") == ["ab", "c", "x", "é", "üb", "日本"]
    assert K.letters("½ ② 12 _ ٣") == K.letters("") == K.letters(None) == []


def test_a_language_of_one_text_is_learned(spark):
    one = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 1)  # its text is used to calibrate, too
    rows = corpus(90) + [(one, "wqwq qwqw wwqq " * 20, "qq", "s", 0), (5000, "qwqw wqwq", None, "s", 0)]
    out = {r.doc_id: r for r in K.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[one].lang_pred == out[5000].lang_pred == "qq"


def test_awkward_rows(spark):
    out = K.identify(awkward(spark)).collect()
    assert len(out) == awkward(spark).count()
    by = {r.doc_id: r for r in out}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[6].lang_pred in ("de", "en") and 0 <= by[6].score <= 1
    assert K.identify(empty(spark)).collect() == []
    odd = K.identify(spark.createDataFrame([(1, "½ ②", "en", "s", 0), (2, "word", "en", "s", 0)], DOCS)).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in odd}[1] == ("und", 0.0)
    none = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in K.identify(none).collect()} == {"und"}
