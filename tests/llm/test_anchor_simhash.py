import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from loamline.llm import anchor_simhash as A
from loamline.llm.components import connected_components, forest
from tests.llm.helpers import DOCS, awkward, empty, sentence


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, linked):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bits", [1, 2])
def test_any_two_near_fingerprints_meet_at_a_home(bits):
    rng = np.random.default_rng(1)
    fp = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    other = fp.copy().view(np.uint64)
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(1, bits + 1), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    other = other.view(np.int64)
    row, anchor, home = A.replicas(fp, bits)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    assert len(homes) == len(fp) and home.sum() == len(fp)
    row2, anchor2, _ = A.replicas(other, bits)
    spread = defaultdict(set)
    for r, a in zip(row2.tolist(), anchor2.tolist()):
        spread[r].add(a)
    assert all(homes[i] in spread[i] for i in range(len(fp)))
    assert max(map(len, spread.values())) <= 69


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    a, b = forest(u, v)
    full, thin = (brute_components(list(range(60)), lambda x, y, e=e: (x, y) in e or (y, x) in e) for e in (set(zip(u.tolist(), v.tolist())), set(zip(a.tolist(), b.tolist()))))
    assert full == thin


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200)] + [(7, 3)] * 5
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_of_few_links_as_of_many(spark):
    rng = random.Random(9)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    links = spark.createDataFrame(links, "u long, v long").repartition(3)
    few, many = (sorted(map(tuple, connected_components(links, at_once=x).collect())) for x in (1000, 0))
    assert few == many
    assert connected_components(links.limit(0), at_once=0).collect() == []


def test_components_of_few_links_take_few_plans(spark):
    """The rounds' plans, and the threads of their exchanges, were what filled the driver's memory."""
    tracker = spark.sparkContext.statusTracker()
    group = "components-of-few-links"
    spark.sparkContext.setJobGroup(group, group)
    try:
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(100)], "u long, v long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 6


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(150)]
    texts += [t.replace("a", "b", 1) for t in texts[:60]] + [texts[0].upper()] * 30 + ["", None, "one two"]
    rows = [(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in A.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), 3, 2).collect()}
    fps = [plain_fingerprint(t, 3) for t in texts]
    assert [out[r[0]].fp % 2**64 for r in rows] == fps
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [out[r[0]].component_id for r in rows] == [rows[i][0] for i in want]


def test_a_large_group_of_near_copies(spark):
    base = np.int64(0x1234567890ABCDEF)
    fps = sorted({int(base ^ np.int64(1 << a) ^ np.int64(1 << b)) for a in range(60) for b in range(60)})
    links = A.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    assert len(links) < 40 * len(fps)  # far from the square
    u, v = (np.array([r[i] for r in links]) for i in (0, 1))
    a, _ = forest(u, v)
    assert len(a) == len(fps) - 1


def test_crowded_anchors_give_the_same_links():
    rng = np.random.default_rng(9)
    centres = rng.integers(-(2**62), 2**62, 3)
    for max_bits in (1, 2, 3):
        fp = np.unique(np.array([c ^ np.bitwise_or.reduce(np.int64(1) << rng.choice(63, 3, replace=False)[: 1 + _ % 3]) for c in centres for _ in range(150)]))
        anchor = np.sort(rng.integers(0, 2, len(fp)))
        home = rng.random(len(fp)) < 0.7
        sets = []
        for crowd in (10**9, 20):
            u, v = A.compare(anchor, fp, home, max_bits, crowd)
            e = set(zip(u.tolist(), v.tolist()))
            sets.append(brute_components(fp.tolist(), lambda x, y, e=e: (x, y) in e or (y, x) in e))
        assert sets[0] == sets[1] and (max_bits == 1 or len(set(sets[0])) < len(fp))
    assert all(len(x) == 0 for x in A.compare(fp[:0], fp[:0], home[:0], 2))


def test_awkward_rows(spark):
    rows, out = awkward(spark).collect(), A.near_duplicates(awkward(spark), 3, 2).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == 1 == by[3].component_id
    assert by[4].component_id == by[5].component_id
    assert sorted(r.component_id for r in out if r.doc_id is None) == sorted([1, by[4].component_id])
    assert A.near_duplicates(empty(spark), 3, 2).collect() == []


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        words = sentence(rng, rng.randint(30, 120)).split()
        texts.append(" ".join(words))
        for edits in (0, 1, 2, 4, 8):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += ["", None, "two words", "Two  Words", "x"]
    rows = [(i + 10, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in A.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}

    def grams(t):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [grams(t) for t in texts]
    want = brute_components(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    assert [got[r[0]] for r in rows] == [rows[i][0] for i in want]


def test_similar_awkward_rows(spark):
    out = A.similar_documents(awkward(spark)).collect()
    by = {r.doc_id: r.component_id for r in out}
    assert len(out) == awkward(spark).count()
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[-3] == -3 and by[6] == 6
    assert A.similar_documents(empty(spark)).collect() == []


def test_groups_around_any_original_and_inside_boilerplate(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    original = [word() for _ in range(304)]
    ids = rng.sample(range(1000), 201)
    middle = sorted(ids)[100]
    texts = {middle: original}
    for i in ids:
        if i != middle:  # 24 of 300 shingles differ: Jaccard 0.85 to the original, below 0.8 to each other
            w = list(original)
            for at in rng.sample(range(12), 5):
                w[at * 25 + 5] = word()
            texts[i] = w
    # Shared passages with a pair of near copies in each fourth of the texts.
    passage = [word() for _ in range(150)]
    twins = {}
    for i in range(2000, 2120, 2):
        own = [word() for _ in range(150)]
        texts[i] = passage + own
        if i % 8 == 0:
            edited = list(own)
            edited[70] = word()
            twins[i + 1], texts[i + 1] = i, passage + edited
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in texts.items()]
    got = {r.doc_id: r.component_id for r in A.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    grams = {i: frozenset(zip(*(w[j:] for j in range(5)))) for i, w in texts.items()}
    order = list(texts)
    want = brute_components([grams[i] for i in order], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    low = {}
    for i, c in zip(order, want):
        low[c] = min(i, low.get(c, i))
    assert {got[i] for i in ids} == {min(ids)}
    assert all(got[i] == low[c] for i, c in zip(order, want)) and all(got[b] == a for b, a in twins.items())


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(14)
    one, two, three = (sentence(rng, 80, "abcdefghijklmnop") for _ in range(3))
    rows = [
        (5, one, "en", "s", 0), (3, one + " x", "en", "s", 1), (9, one, "en", "s", 2),  # a class; 3 stays
        (5, two, "en", "s", 3),  # another text of a dropped id
        (7, three, "en", "a", 4), (7, three, "en", "b", 5), (7, three, "en", "b", 5),  # equal in id and text: one stays
        (None, two, "en", "s", 6), (None, sentence(rng, 50, "qrst"), "en", "s", 7), (None, sentence(rng, 50, "uvwx"), "en", "s", 8),  # 6 is a copy of 3
        (20, "", "en", "s", 9), (21, None, "en", "s", 10),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    out = A.one_of_each(docs)
    left = sorted(r.n_chars for r in out.collect())
    assert out.columns == docs.columns
    assert left in ([1, 3, 4, 7, 8, 9], [1, 3, 5, 7, 8, 9])
    assert [r.n_chars for r in A.one_of_each(spark.createDataFrame([(None, one, "en", "s", 0), (None, one, "en", "s", 1)], DOCS)).collect()] in ([0], [1])
    assert A.one_of_each(empty(spark)).collect() == [] and A.one_of_each(awkward(spark)).columns == awkward(spark).columns


def test_one_of_each_equals_the_classes(spark):
    rng = random.Random(15)
    rows = []
    for i in range(60):
        words = sentence(rng, rng.randint(5, 90)).split()
        for _ in range(rng.randint(1, 3)):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id for r in A.one_of_each(docs).collect()} == {r.component_id for r in A.similar_documents(docs).collect()}


def test_marks_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(11)
    ruled_out = 0
    for n in (1, 5, 100, 400, 3000):
        for share in (0.0, 0.5, 0.79, 0.8, 0.95, 1.0):
            common = rng.integers(0, 2**32, int(n * share), dtype=np.uint32)
            x, y = (np.unique(np.concatenate([common, rng.integers(0, 2**32, n - len(common), dtype=np.uint32)])) for _ in range(2))
            a, b = (np.frombuffer(A.marks(z), np.uint8)[None] for z in (x, y))
            bound = A.most_common(a, b, np.array([len(x)]), np.array([len(y)]))[0]
            assert len(np.intersect1d(x, y)) <= bound
            ruled_out += n in (100, 400) and share < 0.6 and bound < 0.8 / 1.8 * (len(x) + len(y))
    assert ruled_out == 4


def test_shingles_of_one_text_are_not_exploded(spark, monkeypatch):
    """However full the counters are, only shingles that two prefixes have become rows."""
    rng = random.Random(8)
    monkeypatch.setattr(A, "COUNTERS", 4)
    rows, whole = [], A.materialise
    passage = sentence(rng, 150, "abcdefghijklmnop")
    for i in range(60):
        rows.append((i, passage + " " + sentence(rng, 150, "abcdefghijklmnop"), "en", "s", 0))
    made = {}

    def counted(df, name, **more):
        out = whole(df, name, **more)
        if name == "similar-postings":
            made[name] = (out.count(), out.groupBy("shingle").count().where("count > 1").count())
        return out

    monkeypatch.setattr(A, "materialise", counted)
    got = A.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r.component_id for r in got}) == 60
    n, shared = made["similar-postings"]
    assert 0 < shared and n <= 60 * shared
