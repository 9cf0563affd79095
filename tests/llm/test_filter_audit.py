import itertools
import re
from collections import Counter

from loamline.llm import filter_audit as M
from tests.llm.helpers import DOCS, awkward, empty, sentence

LABELS = "doc_id long, quality int, toxic int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, labels):
    """Apply the filters of each order one after the other."""
    smallest = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            smallest[t] = min(smallest.get(t, r["doc_id"]), r["doc_id"])
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for r in rows:
        t, w = r["text"] or "", words(r["text"])
        bad = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": any(c in t for c in "#$%&*|"),
            "E": r["doc_id"] is not None and r["doc_id"] > smallest[t],
        }
        fails.append((r["source"] or "", r["doc_id"], {x for x in bad if bad[x]}))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                cut = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                all_fail = [f for _, f in mine if x in f]
                shapley[x] += len(cut)
                out[part, "".join(order), step] = [len(left), len(cut), len(all_fail) - len(cut), sum(f == {x} for f in all_fail), sum(d in good for d, _ in cut), sum(d in toxic for d, _ in cut)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    got = M.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert found == brute([r.asDict() for r in docs.collect()], labels)
    return got


def test_against_brute_force(spark):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(300):
        alphabet = rng.choice(["abcdefgh", "ab", "abcDEfgh", "ab#cdefg"])
        text = sentence(rng, rng.choice([5, 199, 200, 260]), alphabet)
        rows.append((i, rows[rng.randrange(i)][1] if i and rng.random() < 0.3 else text, "en", f"s{i % 3}", 0))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)]
    got = check(spark, spark.createDataFrame(rows, DOCS).repartition(5), labels)
    assert len(got) == 3 * 120 * 5
    assert sum(r.shapley for r in got if r.step == 1 and r.part == "s0") % 120 == 0


def test_awkward_rows_and_clashing_columns(spark):
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 1)]
    check(spark, awkward(spark).selectExpr("*", "doc_id AS mask", "source AS part"), labels)


def test_copies_in_other_parts_and_ties(spark):
    rows = [(3, "x", "en", "b", 0), (1, "x", "en", "a", 0), (3, "x", "en", None, 0), (None, "x", "en", "", 0), (1, "x", "en", "a", 0)]
    got = check(spark, spark.createDataFrame(rows, DOCS), [])
    alone = {r.part: r.removed for r in got if r.filter_order == "EABCD" and r.step == 1}
    assert alone == {"a": 0, "b": 1, "": 1}


def test_empty_tables(spark):
    assert M.audit(empty(spark), spark.createDataFrame([], LABELS)).collect() == []


def test_counts_are_conditional_columns(spark):
    counts = M.conditional_counts(M.failures(spark.createDataFrame([(1, "A# a", "en", "s", 0)], DOCS)), spark.createDataFrame([(1, 1, 0)], LABELS))
    row = counts.collect()[0].asDict()
    assert [k for k, v in row.items() if v and k != "part"] == ["n13", "good13"]
    assert len(row) == 1 + 3 * 32


def test_word_totals(spark):
    import pyarrow as pa

    texts = ["", " a  b a\n", "\x1c \x85  ", "a\x0bb\x0cb"]
    total, distinct = M.word_totals(pa.array(texts))
    assert total.to_pylist() == [len(words(t)) for t in texts]
    assert distinct.to_pylist() == [len(set(words(t))) for t in texts]
