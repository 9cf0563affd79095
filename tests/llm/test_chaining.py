import random

import numpy as np

from loamline.llm import chaining as C
from tests.llm.helpers import DOCS, awkward, empty, sentence


def brute_chain_score(pos, rpos, gap):
    best = []
    for j in range(len(pos)):
        prev = [best[i] - ((pos[j] - pos[i]) + (rpos[j] - rpos[i])) / (2 * gap) for i in range(j) if pos[i] < pos[j] and rpos[i] < rpos[j]]
        best.append(1 + max([0, *prev]))
    return max(best)


def test_fenwick_chain_is_the_best_chain():
    rng = random.Random(1)
    for _ in range(200):
        m = sorted({(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(rng.randint(1, 25))})
        pos, rpos = np.array([x for x, _ in m]), np.array([y for _, y in m])
        p, r = C.chains(pos, rpos, 10)[0]
        assert all(np.diff(p) > 0) and all(np.diff(r) > 0)
        got = len(p) - sum((np.diff(p) + np.diff(r)) / 20) if len(p) > 1 else 1
        assert abs(got - brute_chain_score(pos, rpos, 10)) < 1e-9
        used = [(a, b) for x, y in C.chains(pos, rpos, 10) for a, b in zip(x, y)]
        assert sorted(used) == m


def test_seeds_depend_on_the_run_alone(spark):
    rng = random.Random(3)
    shared = sentence(rng, 60, "abcdefghijklmnop")
    texts = [shared, sentence(rng, 17, "qrstuv") + " " + shared.upper() + " " + sentence(rng, 9, "qrstuv")]
    found = {}
    for r in C.seeds(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect():
        found.setdefault(r.doc_id, set()).add((r.seed, r.at - 2 * 17 * r.doc_id))
    assert len(found[0]) > 5 and found[0] <= found[1]


def test_neighbours_over_many_tasks(spark):
    rng = random.Random(12)
    rows = sorted({(rng.choice([1, 1, 1, 1, 2, 3, rng.randint(4, 400)]), rng.randint(1, 300), rng.randint(0, 1) << 32 | rng.randint(0, 5)) for _ in range(5000)})
    expected = set()
    for seed in {s for s, _, _ in rows}:
        heads = {}
        own = [(d, a) for s, d, a in rows if s == seed]
        for d, a in own:
            heads.setdefault((d, a >> 32), (d, a))
        order = sorted(heads)
        for d, a in own:
            i = order.index((d, a >> 32))
            if i:
                expected |= {(d, a, *heads[order[i - 1]]), (d, a, *heads[order[0]])}
    table = spark.createDataFrame(rows + rows[:700], "seed long, doc_id long, at long")  # some rows twice
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, coalesce in ((4, "true"), (32, "false"), (300, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            assert {tuple(r) for r in C.matches(C.materialise(table, "t")).collect()} == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", kept)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def corpus():
    rng = random.Random(9)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnop")
    shared, fuzzy = unique(70), unique(90).split()
    edited = list(fuzzy)
    for i in (20, 45, 70):
        edited[i] = "changed"
    del edited[33]
    short = unique(30)
    whole = unique(200)
    return [
        (1, unique(50) + " " + shared + " " + unique(40)), (2, unique(33) + " " + shared.upper() + " " + unique(20)), (3, " ".join(fuzzy) + " " + unique(60)),
        (4, unique(25) + " " + " ".join(edited)), (5, unique(60) + " " + short), (6, short + " " + unique(60)), (7, whole), (8, whole), (9, unique(300)), (10, shared),
    ]


def test_planted_passages(spark):
    docs = corpus()
    out = C.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
    found = {(r.doc_id, r.ref_doc_id): r for r in out}
    assert set(found) == {(2, 1), (4, 3), (8, 7), (10, 1), (10, 2)}
    assert (found[2, 1].start_word, found[2, 1].end_word, found[2, 1].similarity) == (33, 103, 1.0)
    assert (found[8, 7].start_word, found[8, 7].end_word) == (0, 200)
    assert (found[4, 3].start_word, found[4, 3].end_word) == (25, 114) and found[4, 3].similarity > 0.9


def test_hot_passage_gives_linear_matches(spark):
    rng = random.Random(2)
    hot = sentence(rng, 80)
    docs = [(i, sentence(rng, 30) + " " + hot, "en", "s", 0) for i in range(300)]
    out = C.passages(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in out} >= {(i, 0) for i in range(1, 300)} | {(i, i - 1) for i in range(1, 300)}
    assert len(out) < 1.2 * (299 + 298)  # a few documents share a word beside the passage, too


def spans(out, key=lambda r: r.doc_id):
    covered = {}
    for r in out:
        covered.setdefault(key(r), set()).update(range(r.start_word, r.end_word))
    return covered


def brute_runs(docs, least=50):
    """Words of each document that lie in a run of ``least`` words that an earlier one has as well."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        words = text.split()
        runs = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        out[key] = {j for i, r in enumerate(runs) if r in seen for j in range(i, i + least)}
        seen |= set(runs)
    return {k: v for k, v in out.items() if v}


def test_exact_passages_equal_brute_force(spark):
    rng = random.Random(21)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnopqrstuvwxyz")
    pool = [unique(rng.randint(40, 120)) for _ in range(25)]
    docs = [(i, " ".join(rng.choice([unique(rng.randint(5, 60)), rng.choice(pool)]) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    out = C.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
    expected, texts = brute_runs(docs), dict(docs)
    covered = spans(out)
    # A word beside a passage may equal that of a third document by chance.
    assert all(len(v - covered.get(k, set())) <= 2 for k, v in expected.items())
    for r in out:
        assert r.ref_doc_id < r.doc_id and r.similarity >= 0.8
        a, b = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.ref_doc_id].split()[r.ref_start_word : r.ref_end_word]
        assert min(len(a), len(b)) >= 50 and r.n_matched <= C._common(np.array(list(map(hash, a))), np.array(list(map(hash, b))))
        assert abs(r.n_matched / max(len(a), len(b)) - r.similarity) < 1e-9


def test_repeated_ids_are_told_apart(spark):
    rng = random.Random(31)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnop")
    rows, other = [], {}
    for i in range(12):
        shared = unique(80)
        other[100 + i] = unique(120)
        rows += [(i, unique(30) + " " + shared), (100 + i, shared + " " + unique(40)), (100 + i, other[100 + i])]
    rows += [(200, unique(90))] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    found = C.passages(docs)
    assert {(r.doc_id, r.ref_doc_id) for r in found.collect()} == {(100 + i, i) for i in range(12)} and found.count() == 12
    left = [(r.doc_id, r.text) for r in C.without_passages(docs, found).collect()]
    assert len(left) == len(rows) and all((i, t) in left for i, t in other.items())
    assert sorted(len(t.split()) for i, t in left if 100 <= i < 200) == [40] * 12 + [120] * 12
    assert [i for i, _ in left].count(200) == 3


def test_texts_of_one_id_are_compared(spark):
    rng = random.Random(32)
    shared = sentence(rng, 70, "abcdefghijklmnop")
    docs = spark.createDataFrame([(1, shared + " " + sentence(rng, 30, "qrst"), "en", "s", 0), (1, sentence(rng, 20, "uvwx") + " " + shared, "en", "s", 0)], DOCS)
    assert sorted(len(r.text.split()) for r in C.without_passages(docs, C.passages(docs)).collect()) in ([20, 100], [30, 90])


def test_halves_that_occur_earlier_elsewhere(spark):
    rng = random.Random(41)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnop")
    one, two = unique(30), unique(30)
    docs = [(1, unique(40) + " " + one + " " + unique(40)), (2, two + " " + unique(50)), (3, unique(20) + " " + one + " " + two), (4, one + " " + two + " " + unique(25))]
    out = C.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
    assert [(r.doc_id, r.ref_doc_id, r.start_word, r.end_word) for r in out] == [(4, 3, 0, 60)]


def test_runs_whose_every_seed_meets_other_documents(spark):
    rng = random.Random(61)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnop")
    docs, expected = [], set()
    for i in range(0, 200, 10):
        run = unique(60).split()
        pieces = [" ".join(run[:45]), " ".join(run[15:])]  # too short for a passage, but with all seeds
        docs += [(i, unique(60).join(pieces)), (i + 1, unique(20) + " " + " ".join(run)), (i + 2, " ".join(run) + " " + unique(20))]
        docs += [(i + j, unique(60).join(pieces[::-1])) for j in (3, 4)]
        docs.append((i + 5, unique(30) + " " + " ".join(run[3:58]) + " " + unique(30)))
        expected |= {(i + 2, 0, 60), (i + 5, 30, 85)}
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    covered = spans(C.passages(table).collect())
    assert all(set(range(a, b)) <= covered.get(i, set()) for i, a, b in expected)


def test_no_equal_run_is_missed(spark):
    rng = random.Random(62)
    pool = sentence(rng, 160, "abcdefghijklmnop").split()
    docs = []
    for i in range(200):  # cuts of one text in any order, most shorter than a passage
        cuts = [(a := rng.randint(0, 110), a + rng.randint(10, 58)) for _ in range(rng.randint(1, 6))]
        docs.append((i, " ".join(w for a, b in cuts for w in pool[a:b])))
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    for least in (21, 50):
        covered = spans(C.passages(table, min_words=least).collect())
        assert all(v <= covered.get(k, set()) for k, v in brute_runs(docs, least).items())


def test_recall_of_edited_passages(spark):
    rng = random.Random(51)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnopqrst")
    for step, least in ((10, 0.97), (8, 0.9)):
        docs = []
        for i in range(150):
            words = unique(100).split()
            edited = [("x" + w if j % step == step - 1 else w) for j, w in enumerate(words)]
            docs += [(i, unique(40) + " " + " ".join(words)), (1000 + i, " ".join(edited) + " " + unique(40))]
        out = C.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
        assert all(r.doc_id - 1000 == r.ref_doc_id for r in out)
        assert sum(len(v & set(range(100))) >= 80 for v in spans(out).values()) >= least * 150


def test_cut_keeps_first_copy_and_clean_texts(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in corpus()], DOCS)
    out = {r.doc_id: r for r in C.without_passages(docs, C.passages(docs)).collect()}
    texts = dict(corpus())
    assert set(out) == set(texts) - {8, 10}
    for i in (1, 3, 5, 6, 7, 9):
        assert out[i].text == texts[i] and out[i].n_chars == len(texts[i])
    assert len(out[2].text.split()) == 53 and out[2].n_chars == len(out[2].text)
    assert len(out[4].text.split()) == 25


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = C.passages(docs).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in out} == {(4, -3), (5, -3), (5, 4)}
    left = C.without_passages(docs, C.passages(docs))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [-3, 1, 2, 3, 6, 7, 8, 9]
    assert sum(r.doc_id is None for r in left.collect()) == 2
    assert C.passages(empty(spark)).collect() == [] and C.without_passages(empty(spark), C.passages(empty(spark))).collect() == []


def test_repeats_inside_texts_match_place_by_place(spark):
    rng = random.Random(8)
    block, extra = sentence(rng, 20, "abcdefghijklmnop"), sentence(rng, 70, "abcdefghijklmnop")
    docs = [(1, " ".join([block] * 6)), (2, " ".join([block] * 6)), (3, extra), (4, extra + " x " + extra)]
    out = C.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)).collect()
    covered = {}
    for r in out:
        covered.setdefault((r.doc_id, r.ref_doc_id), set()).update(range(r.start_word, r.end_word))
    assert covered == {(2, 1): set(range(120)), (4, 3): set(range(70)) | set(range(71, 141))}


def test_numbered_seeds():
    h = np.array([5, 7, 5, 5], np.uint64)
    key, pos = C.numbered(h, np.arange(4))
    again, _ = C.numbered(h, np.arange(4))
    assert len(set(key[:4].tolist())) == 4 and pos.tolist() == [0, 1, 2, 3, 2, 3]
    assert key[4] == key[0] == key[5] and (key == again).all()
