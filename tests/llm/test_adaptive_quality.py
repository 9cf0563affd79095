import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import adaptive_quality as Q
from tests.llm.helpers import DOCS, awkward, empty, sentence


def brute(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab# \n\té日\x1c\xa0|", max_size=80))
def test_counts(text):
    counts, measures = Q.measure(text.encode())
    assert counts == brute(text) and len(measures) == len(Q.MEASURES) and all(m >= 0 for m in measures)


def grouped(n=400):
    """Six sources: all texts of the second are full of symbols, and a few of the first."""
    rng = random.Random(1)
    rows = []
    for i in range(6 * n):
        words = sentence(rng, rng.randint(60, 200)).split()
        marked = n <= i < 2 * n or i < n and i % 40 == 0
        rows.append((i, " ".join(w + "," if rng.random() < 0.1 else w + "#" * (marked and rng.random() < 0.9) for w in words), "en", "abcdef"[i // n], 0))
    return rows


def test_verdicts_follow_the_group(spark):
    out = {r.doc_id: r for r in Q.with_verdicts(spark.createDataFrame(grouped(), DOCS)).collect()}
    dropped = [i for i, r in out.items() if not r.kept]
    assert set(range(0, 400, 40)) <= set(dropped) and len(dropped) <= 10 + 12


def quartiles(values):
    """Exact values of the ranks that the sketch answers for."""
    values = sorted(values)
    return [values[-(-int(q * 100) * len(values) // 100) - 1] for q in (0.25, 0.5, 0.75)]


def test_sketches_are_within_their_error(spark):
    docs = spark.createDataFrame(grouped() + [(5000 + i, t, "de", "x", 0) for i, t, *_ in grouped()[:30]], DOCS)
    rows = Q.materialise(Q.measured(docs, ["doc_id"]), "t")
    plan = {(r.g_lang, r.g_source): r for r in Q.thresholds(rows).collect()}
    own = rows.collect()
    for m in ("n_words", *Q.MEASURES):
        everywhere = quartiles([r[m] for r in own])
        lang = quartiles([r[m] for r in own if r.g_lang == "en"])
        for s in "abcdef":
            q, t = quartiles([r[m] for r in own if r.g_source == s]), plan["en", s]
            assert abs(t[f"mid_{m}"] - q[1]) <= 1.01 * Q.ERROR * q[1] + 1e-6
            if m != "n_words":
                for side, at, sign in (("above", 2, 1), ("below", 0, -1)):
                    of = q if q[0] < q[2] else lang
                    if of[0] == of[2]:
                        assert t[f"{side}_{m}"] is None  # no upper case here
                        continue
                    exact = of[at] + sign * 3 * (of[2] - of[0])
                    assert abs(t[f"{side}_{m}"] - exact) <= 1.01 * Q.ERROR * 7 * max(q[2], lang[2]) + 1e-6
        assert abs(plan["de", "x"][f"mid_{m}"] - everywhere[1]) <= 1.01 * Q.ERROR * everywhere[1] + 1e-6  # too few texts in group and language
    for m in set(Q.MEASURES) - {"upper_share"}:
        assert len({t[f"mid_{m}"] for t in plan.values()}) > 1


def test_verdicts_equal_brute_force_and_reruns(spark):
    docs = spark.createDataFrame(grouped(), DOCS)
    rows = Q.materialise(Q.measured(docs, ["doc_id"]), "t")
    plan = {(r.g_lang, r.g_source): r for r in Q.thresholds(rows).collect()}
    expected = set()
    for r in rows.collect():
        t = plan[r.g_lang, r.g_source]
        fine = r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words
        for m in Q.MEASURES:
            drawn = (r.n_words * r[m] + t.mid_n_words * t[f"mid_{m}"]) / (r.n_words + t.mid_n_words)
            high, low = t[f"above_{m}"], t[f"below_{m}"]
            fine = fine and (high is None or drawn <= high) and (m not in Q.TWO_SIDED or low is None or drawn >= low)
        if fine:
            expected.add(r.row.doc_id)
    for shuffled in (docs, docs.repartition(7)):
        assert {r.doc_id for r in Q.with_verdicts(shuffled).collect() if r.kept} == expected


def test_copies_set_no_threshold(spark):
    rows = grouped()
    copies = [(10_000 + i, rows[1][1], "en", "a", 0) for i in range(3000)]
    near = [(20_000 + i, rows[1][1] + f" w{i}", "en", "a", 0) for i in range(1500)]
    kept = lambda table: {r.doc_id for r in Q.with_verdicts(spark.createDataFrame(table, DOCS)).collect() if r.kept and r.doc_id < 10_000}
    alone = kept(rows)
    assert kept(rows + copies) == alone
    assert len(alone - kept(rows + near)) <= 10


def test_a_strict_source_has_its_own_limit(spark):
    """What passes in its language is far out in a source of plain texts; in a looser source it stays."""
    rng = random.Random(8)
    rows = []
    for i in range(2400):
        share = (0.01 + rng.random() * 0.02) if i % 4 == 0 else rng.random() * 0.3
        if i == 0:
            share = 0.2
        words = sentence(rng, 150).split()
        rows.append((i, " ".join(w + "," * 2 if rng.random() < share else w for w in words), "en", "strict" if i % 4 == 0 else f"s{i % 4}", 0))
    odd = (5000, " ".join(w + ",," if j % 4 == 0 else w for j, w in enumerate(sentence(rng, 150).split())), "en")
    docs = spark.createDataFrame([*rows, (*odd, "strict", 0), (5001, odd[1] + " z", "en", "s1", 0)], DOCS)
    plan = {r.g_source: r for r in Q.thresholds(Q.measured(docs, [])).collect()}
    assert plan["strict"].above_other_share < plan["s1"].above_other_share / 2
    kept = {r.doc_id for r in Q.with_verdicts(docs).collect() if r.kept}
    assert 5000 not in kept and 0 not in kept and 5001 in kept
    assert len([i for i in range(0, 2400, 4) if i in kept]) > 590


def test_near_key(spark):
    rng = random.Random(4)
    text = sentence(rng, 150).encode().split()
    known = Q.WordHashes()
    one = Q.near_key(text, known)
    same = sum(Q.near_key(text[:i] + [b"zzz"] + text[i + 1 :], known) == one for i in range(150))
    assert same >= 140 and Q.near_key(sentence(rng, 150).encode().split(), known) != one
    assert Q.near_key([], known) == 0 and Q.near_key([b"a"], known) != Q.near_key([b"b"], known)


def test_rows_are_judged_by_themselves(spark):
    rows = grouped()
    rows = [(i % 7, *r[1:]) for i, r in enumerate(rows)] + [(None, rows[0][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = Q.with_verdicts(docs, base_rule=False).where("kept")
    out = Q.without_rejected(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(map(str, out.select("doc_id", "lang", "source").collect())) == sorted(map(str, kept.select("doc_id", "lang", "source").collect()))
    assert rows[0][1] not in {r.text for r in out.collect()}


def test_base_rule(spark):
    rng = random.Random(2)
    text = sentence(rng, 60, "abcdefghijkl")
    rows = [(1, sentence(rng, 49), "en", "s", 0), (2, text, "en", "s", 0), (3, " ".join(["x y z"] * 40), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in Q.with_verdicts(docs).collect()}
    assert (out[1].base_failed, out[2].base_failed, out[3].base_failed) == (True, False, True)
    assert (out[1].kept, out[2].kept, out[3].kept) == (False, True, False)
    assert {r.doc_id for r in Q.with_verdicts(docs, base_rule=False).collect() if r.kept} >= {1, 2}


def test_awkward_rows(spark):
    out = Q.with_verdicts(awkward(spark)).collect()
    assert len(out) == awkward(spark).count()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted(tuple(brute(r.text)) for r in awkward(spark).collect())
    assert all(not r.kept for r in out if r.base_failed)
    assert Q.with_verdicts(empty(spark)).collect() == [] and Q.without_rejected(empty(spark)).collect() == []
    left = Q.without_rejected(awkward(spark))
    assert left.columns == awkward(spark).columns and {r.doc_id for r in left.collect()} >= {1, 2, 3, 4, 5, 8}
