import os
import random
import re
import zlib
from collections import Counter

import pytest

from loamline.llm import spelling_variants as M
from tests.llm.helpers import DOCS, awkward, empty

DATA = "/root/testdata/sf0.001"


def words_of(rows, min_length=7, min_count=2, slip=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if slip and h % slip == 0:
                i = h % len(low)
                low = low[:i] + low[i + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """All pairs of words."""
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and is_near(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_against_all_pairs(spark):
    rng = random.Random(13)
    base = ["international", "élèvement", "aaaaaaaa", "abababab", "Straßenbahn", "ÀÉÎÕÜßàé"]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:]])

    rows = []
    for i in range(150):
        text = []
        for _ in range(120):
            w = rng.choice(base)
            for _ in range(rng.choice([0] * 40 + [1, 1, 2, 3])):
                w = slip(w)
            text.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(text), "en", "s", 0))
    want = brute(words_of([r[:2] for r in rows]))
    assert sum(v[0] is not None for v in want.values()) > 50
    assert found(M.variants(spark.createDataFrame(rows, DOCS).repartition(5))) == want


def test_chains_lead_to_the_last_form(spark):
    n = {"aaaaaaaz": 2, "aaaaaaaa": 30, "aaaaaaab": 300, "aaaaaabb": 3001, "aaaaabbb": 30010}
    text = " ".join(w for w, k in n.items() for _ in range(k))
    got = found(M.variants(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS), slip=0))
    assert got == brute(n)
    assert got["aaaaaaaa"][:2] == ("aaaaaaab", "aaaaabbb")
    assert got["aaaaaaaz"][:2] == ("aaaaaaab", "aaaaabbb")


def test_ties_and_repeated_letters(spark):
    n = {"bookkeeper": 2, "bokkeeper": 40, "bookeeper": 40, "cookkeeper": 40}
    text = " ".join(w for w, k in n.items() for _ in range(k))
    got = found(M.variants(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS), slip=0))
    assert got == brute(n)
    assert got["bookkeeper"] == ("bokkeeper", "bokkeeper", 2, 3, 40)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = words_of([(r.doc_id, r.text) for r in docs.collect()])
    keep = {w: k for w, k in n.items() if len(w) < 9}
    got = found(M.variants(docs))
    assert {w: v[2] for w, v in got.items()} == n
    want = brute({w: k for w, k in n.items() if len(w) < 10})
    assert {w: got[w][3] for w in keep} == {w: want[w][3] for w in keep}


def test_awkward_rows(spark):
    df = awkward(spark)
    assert found(M.variants(df, min_length=5)) == brute(words_of([(r.doc_id, r.text) for r in df.collect()], min_length=5))
    assert M.variants(empty(spark)).collect() == []
    assert M.variants(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)).collect() == []
    with pytest.raises(ValueError):
        M.variants(df, ratio=2)
