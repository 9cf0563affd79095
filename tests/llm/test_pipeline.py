import hashlib
import random
import struct
from collections import Counter

import pytest
import tiktoken

import corpus_pipeline as C
from loamline.llm import adaptive_quality, byte_bpe, es_mixing
from loamline.llm.queries import multilingual_tokenizer
from tests.llm.helpers import DOCS, awkward, empty, sentence
from tests.llm.test_chaining import brute_runs


def planted():
    rng = random.Random(7)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnopqrst")
    rows = [(i, unique(rng.randint(60, 200)), "en", f"s{i % 3}", 0) for i in range(60)]
    passage = unique(80)
    rows += [(100 + i, unique(60) + " " + passage + " " + unique(60), "en", "s1", 0) for i in range(4)]
    rows += [(200, rows[0][1], "en", "s2", 0), (201, rows[1][1].replace("a", "b", 1), "en", "s2", 0)]
    rows += [(300, " ".join(w + "***" for w in unique(100).split()), "en", "s0", 0), (301, "AAA BBB CCC " * 60, "en", "s0", 0)]
    return rows, passage


def staged(spark, docs):
    out = {}
    for name, stage in C.STAGES:
        columns = docs.columns
        docs = C.materialise(stage(spark, docs, "unused"), name)
        assert name == "tokens" or docs.columns == columns
        out[name] = docs
    return out


def test_every_decision_takes_effect(spark):
    rows, passage = planted()
    out = staged(spark, spark.createDataFrame(rows, DOCS))
    ids = {k: {r.doc_id for r in v.collect()} for k, v in out.items()}
    every = {r[0] for r in rows}
    assert ids["quality_rules"] == every - {300, 301}
    assert ids["near_duplicates"] == every - {300, 301, 200, 201}
    texts = {r.doc_id: r.text for r in out["repeated_passages"].collect()}
    assert [passage in texts[100 + i] for i in range(4)] == [True, False, False, False]
    original = {r[0]: r[1] for r in rows}
    assert all(texts[i] == original[i] for i in texts if i < 100)
    times = {}
    for r in out["mixing"].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert max(times.values()) <= 2
    assert out["tokens"].count() == out["mixing"].count()


def test_run_is_the_stages(spark, tmp_path):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, C.run(spark, str(tmp_path)).collect())) == sorted(map(key, staged(spark, docs)["tokens"].collect()))


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables(spark, make):
    out = staged(spark, make(spark))
    if make is empty:
        assert all(d.count() == 0 for d in out.values())
    else:
        assert {1, 2, 3} <= {r.doc_id for r in out["quality_rules"].collect()}
        assert {r.doc_id for r in out["near_duplicates"].collect()} >= {1, 6, 8, -3}


def brute_near_duplicates(rows):
    """Rows that stay: the smallest id of each class by the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = []
    for _, text, *_ in rows:
        w = text.lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {}
    for x, r in zip(label, rows):
        low[x] = min(low.get(x, r[0]), r[0])
    return [r for x, r in zip(label, rows) if r[0] == low[x]]


def brute_cut(rows):
    """Texts without the words that lie in a run of 50 words of an earlier text."""
    gone = brute_runs([(r[0], r[1]) for r in rows])
    out = []
    for i, text, *rest in rows:
        kept = " ".join(w for j, w in enumerate(text.split()) if j not in gone.get(i, ()))
        if kept:
            out.append((i, kept, *rest))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(17)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnopqrstuvwxyz")
    shared = [unique(rng.randint(55, 90)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [unique(rng.randint(20, 80)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        rows.append((i, " ".join(parts), "en", f"s{i % 4}", 0))
    for i in range(120, 150):  # near copies
        words = rng.choice(rows[:120])[1].split()
        words[rng.randrange(len(words))] = unique(1)
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    rows += [(200, " ".join(w + "***" for w in unique(100).split()), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    verdicts = {r.doc_id: r.kept for r in adaptive_quality.with_verdicts(docs, base_rule=False).collect()}
    assert not verdicts[200]
    left = brute_cut(brute_near_duplicates([r for r in rows if verdicts[r[0]]]))
    assert len(left) < 140
    copies = {r.doc_id: r.copies for r in es_mixing.mix(spark.createDataFrame(left, DOCS)).collect()}
    path, pattern = multilingual_tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(path))}, special_tokens={})
    want = Counter()
    for i, text, *_ in left:
        ids = own.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += copies[i]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect())
    same = sum((got & +want).values())
    # A passage's end may take in a word beside it that both texts happen to share, and blanks at a cut stay.
    assert sum(got.values()) == sum((+want).values()) and {k[0]: n for k, n in got.items()} == {k[0]: n for k, n in (+want).items()}
    assert same >= 0.7 * sum(got.values())


def test_repeated_and_null_ids(spark):
    rng = random.Random(19)
    unique = lambda n: sentence(rng, n, "abcdefghijklmnopqrst")
    copy, passage, other = unique(90), unique(80), unique(100)
    rows = [(1, copy, "en", "s0", 0), (2, copy, "en", "s0", 0), (2, other, "en", "s1", 0), (3, unique(50) + " " + passage, "en", "s1", 0), (4, passage + " " + unique(60), "en", "s1", 0), (4, unique(120), "en", "s0", 0), (None, unique(70), "en", "s0", 0), (None, copy, "en", "s0", 0)]
    out = staged(spark, spark.createDataFrame(rows, DOCS))
    near = [(r.doc_id, r.text) for r in out["near_duplicates"].collect()]
    assert Counter(t for _, t in near) == Counter([copy, other, rows[3][1], rows[4][1], rows[5][1], rows[6][1]]) and (1, copy) in near
    cut = {t for i, t in ((r.doc_id, r.text) for r in out["repeated_passages"].collect()) if i == 4}
    assert rows[5][1] in cut and sorted(len(t.split()) for t in cut) == [60, 120]


def test_columns_named_as_in_the_stages(spark):
    """Extra columns may have the names of whatever the stages compute."""
    names = ["__spans", "__key", "__of", "__hash", "__id", "spans", "of", "text_key", "row", "row_id", "row_hash", "row_key", "id", "text_hash", "stays", "low", "label", "near_key", "g_lang", "mask"]
    rows, passage = planted()
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, DOCS)
    more = docs.selectExpr("*", *[f"doc_id * {i + 2} AS `{n}`" for i, n in enumerate(names)])
    near, near_more = (C.materialise(C.near_duplicates(spark, d, ""), "near") for d in (docs, more))
    cut, cut_more = (C.repeated_passages(spark, d, "") for d in (near, near_more))
    for plain, wide in ((near, near_more), (cut, cut_more)):
        assert wide.columns == more.columns
        got = wide.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect())
        assert all(r[n] == r.doc_id * (i + 2) for r in got for i, n in enumerate(names))
    assert sum(passage in r.text for r in cut.collect()) == 1
