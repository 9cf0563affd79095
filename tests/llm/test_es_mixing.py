import random
from collections import defaultdict

import pytest

from loamline.llm import es_mixing as M
from tests.llm.helpers import DOCS, awkward, empty, sentence


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare what is above the cap by weight until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {**fixed, **{s: level * w[s] for s in free}}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]
        free -= over
    return fixed


def corpus(n=800, sources=7):
    rng = random.Random(3)
    return [(i, sentence(rng, rng.randint(1, 60)), "en", None if i % 50 == 0 else f"s{min(i % 11, sources)}", 0) for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_targets_and_taken(spark, buckets):
    rows = corpus()
    out = M.mix(spark.createDataFrame(rows, DOCS).repartition(5), buckets=buckets).collect()
    assert len(out) == len(rows)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    for s, t in want.items():  # complete epochs come first
        assert min(r.copies for r in out if r.source == s) >= int(t / sizes[s] + 1e-9) - 0


def test_buckets_and_reruns_agree(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    runs = [sorted((r.doc_id, r.taken) for r in M.mix(docs.repartition(p), buckets=b).collect()) for p, b in ((1, 1), (6, 64), (3, 4096))]
    assert runs[0] == runs[1] == runs[2]


def test_repeated_rows_are_the_mix(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    want = {r.doc_id: r.copies for r in M.mix(docs).collect() if r.copies}
    got = defaultdict(int)
    for r in M.repeated(docs).collect():
        got[r.doc_id] += 1
    assert got == want
    assert M.repeated(docs).schema == docs.schema


def test_symbols_lower_the_chance(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(w + "#%" if i % 2 else w for w in sentence(rng, 20).split()), "en", "a" if i < 2000 else "b", 0) for i in range(4000)]
    out = M.mix(spark.createDataFrame(rows, DOCS), weights=(1, 50), share=0.8).collect()
    clean, full = (sum(r.copies for r in out if r.source == "a" and r.doc_id % 2 == x) for x in (0, 1))
    assert clean > 2 * full


def test_rows_without_ids_spread(spark):
    rng = random.Random(6)
    rows = [(None, sentence(rng, 10), "en", "s", 0) for _ in range(3000)] + [(i, sentence(rng, 10), "en", "t", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    buckets = docs.where("doc_id IS NULL").select(M._keyed(7, 64)[-1].alias("b")).groupBy("b").count().collect()
    assert len(buckets) == 64 and max(r["count"] for r in buckets) < 150
    half = M.mix(docs, weights=(1, 100), share=0.6).where("doc_id IS NULL").collect()
    assert {r.copies for r in half} == {0, 1} or len({r.copies for r in half}) == 1


def test_awkward_rows(spark):
    out = M.mix(awkward(spark)).collect()
    assert len(out) == awkward(spark).count()
    assert all(r.size == 0 and r.taken == 0 for r in out if r.doc_id in (1, 2, 3))
    assert M.mix(empty(spark)).collect() == [] and M.repeated(empty(spark)).collect() == []
    assert M.repeated(awkward(spark)).columns == awkward(spark).columns
    only = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", None, 0)], DOCS)
    assert [(r.target, r.taken) for r in M.mix(only).collect()] == [(0.0, 0)] * 2
