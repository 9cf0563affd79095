import random

import pytest

from loamline.operators import graph, modules


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, t) for a, b, t in pairs], "src string, dst string, at_import_time boolean")


def test_build_edges_joins_evidence_and_drops_loops(spark):
    e = graph.build_edges(edges(spark, [("a", "b", False), ("a", "b", True), ("a", "a", True), ("b", "c", False)])).collect()
    assert {(r.src, r.dst, r.at_import_time) for r in e} == {("a", "b", True), ("b", "c", False)}


def test_pagerank_by_hand(spark):
    e = edges(spark, [("a", "b", True), ("b", "c", True), ("a", "c", True)])
    score = {x: 1 / 3 for x in "abc"}
    for _ in range(30):
        lost = score["c"]
        got = {"a": 0, "b": score["a"] / 2, "c": score["a"] / 2 + score["b"]}
        score = {x: 0.15 / 3 + 0.85 * (got[x] + lost / 3) for x in score}
    one = {r.node: r.score for r in graph.pagerank(e).collect()}
    for x in "abc":
        assert one[x] == pytest.approx(score[x], abs=1e-12)
    assert sum(one.values()) == pytest.approx(1)


def test_random_ranks_sum_to_one(spark):
    rng = random.Random(1)
    e = edges(spark, [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", True) for _ in range(60)])
    assert sum(r.score for r in graph.pagerank(e).collect()) == pytest.approx(1)


def test_components(spark):
    e = edges(spark, [("a", "b", True), ("c", "b", True), ("x", "y", True), ("z", "z", True)])
    got = {r.node: r.component for r in graph.components(e, spark.createDataFrame([(x,) for x in "abcxyz"], "node string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_cycles_at_import_and_call_time(spark):
    rows = [("r", "a", "b", True), ("r", "b", "a", True), ("r", "c", "d", True), ("r", "d", "c", False), ("q", "a", "b", True)]
    e = spark.createDataFrame(rows, "repo_id string, src string, dst string, at_import_time boolean")
    got = {(tuple(r.members), r.import_time) for r in graph.cycles(e).collect()}
    assert got == {(("a", "b"), True), (("c", "d"), False)}
    tail = e.union(spark.createDataFrame([("r", "b", "c", True), ("r", "z", "a", True), ("r", "d", "y", True)], e.schema))
    assert {(tuple(r.members), r.import_time) for r in graph.cycles(tail).collect()} == got


def test_strong_components_against_reachability(spark):
    rng = random.Random(5)
    rows = []
    for repo in range(12):
        n = 14
        rows += [(repo, a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([8, 14, 20, 30])))]
    rows += [(99, i, i + 1) for i in range(12)] + [(98, i, (i + 1) % 9) for i in range(9)]  # a chain and a ring
    want = set()
    for repo in {r for r, _, _ in rows}:
        out = {}
        for r, a, b in rows:
            if r == repo:
                out.setdefault(a, set()).add(b)
        reach = {}
        for start in {x for r, a, b in rows if r == repo for x in (a, b)}:
            seen, todo = set(), [start]
            while todo:
                for y in out.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            reach[start] = seen
        for x, to in reach.items():
            own = {y for y in to if x in reach[y]} - {x}
            if own:
                want.add((repo, x, min(own | {x})))
    e = spark.createDataFrame(rows, "repo_id long, src long, dst long")
    assert {tuple(r) for r in graph.strong_components(e, ["repo_id"]).collect()} == want and len({(r, c) for r, _, c in want}) > 5
    one = graph.strong_components(e.where("repo_id = 98"))
    assert one.columns == ["node", "component"] and {tuple(r) for r in one.collect()} == {(i, 0) for i in range(9)}
    assert graph.strong_components(e.limit(0), ["repo_id"]).collect() == []


def test_strong_components_of_small_and_large_groups(spark):
    rng = random.Random(7)
    rows = [(repo, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for repo in "abcdefgh" for _ in range(rng.choice([6, 12, 18]))]
    rows += [("ring", f"n{i}", f"n{(i + 1) % 20}") for i in range(20)] + [("chain", f"n{i}", f"n{i + 1}") for i in range(20)] + [(None, "x", "y"), (None, "y", "x")]
    e = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    got = [{tuple(r) for r in graph.strong_components(e, ["repo_id"], most).collect()} for most in (0, 10, 1000)]
    assert got[0] == got[1] == got[2] and {x[1] for x in got[0] if x[0] == "ring"} == {f"n{i}" for i in range(20)}


def test_strong_components_of_small_groups_take_few_jobs(spark):
    rows = [(repo, a, a + 1) for repo in range(5) for a in range(12)] + [(repo, a + 1, a) for repo in range(5) for a in range(0, 12, 3)]
    e = spark.createDataFrame(rows, "repo_id int, src int, dst int")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("strong", "small groups")
    try:
        assert graph.strong_components(e, ["repo_id"]).count() == 5 * 8
        assert len(tracker.getJobIdsForGroup("strong")) <= 15
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_back_edges_are_closed_cycles():
    rng = random.Random(2)
    for _ in range(30):
        adj = {f"n{i}": {f"n{rng.randrange(12)}" for _ in range(2)} for i in range(12)}
        for ring in graph.back_edge_cycles(adj):
            assert ring[0] == min(ring) and all(b in adj[a] for a, b in zip(ring, ring[1:] + ring[:1]))
    assert graph.back_edge_cycles({"a": {"b"}, "b": {"c"}, "c": {"a", "b"}}) == [("a", "b", "c"), ("b", "c")]


def test_roots_and_zero_indegree(spark):
    e = edges(spark, [("a", "b", True), ("a", "c", True), ("d", "b", True), ("b", "c", True)])
    assert [(r.node, r.out_degree) for r in graph.graph_roots(e).collect()] == [("a", 2), ("d", 1)]
    n = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert {r.node for r in graph.zero_indegree(n, e, spark.createDataFrame([("a",)], "node string")).collect()} == {"d"}


def test_split_keeps_small_and_folds_fragments():
    near = {"d/a": {"d/b"}, "d/b": {"d/a"}, "d/c": {"d/e"}, "d/e": {"d/c"}}
    files = ["d/a", "d/b", "d/c", "d/e", "d/x"]
    assert modules.split_scattered({"d": files}, near) == [("d#1", "split", ["d/a", "d/b", "d/x"]), ("d#2", "split", ["d/c", "d/e"])]
    assert modules.split_scattered({"d": ["d/a", "d/b", "d/c"]}, {})[0][1] == "directory"
    loose = ["d/a", "d/b", *(f"d/f{i}" for i in range(3))]
    assert modules.split_scattered({"d": loose}, near) == [("d", "directory", loose)]


def test_merge_is_greedy_and_names_branches():
    mods = [("p/a", "directory", ["p/a/1", "p/a/2"]), ("p/b", "directory", ["p/b/1"]), ("z", "directory", ["z/1", "z/2", "z/3"])]
    got = modules.merge_coupled(mods, {("p/a/1", "p/b/1"), ("p/b/1", "p/a/2"), ("z/1", "p/a/1")})
    assert got == [("z", "directory", ["z/1", "z/2", "z/3"]), ("p/{a,b}", "merged", ["p/a/1", "p/a/2", "p/b/1"])]


def test_merge_at_exactly_the_threshold():
    mods = [("a", "directory", [f"a/{i}" for i in range(5)]), ("b", "directory", ["b/0"])]
    assert modules.merge_coupled(mods, {("a/0", "b/0"), ("b/0", "a/1")})[0][:2] == ("a+b", "merged")
    assert modules.merge_coupled(mods, {("a/0", "b/0")}) == mods


def brute_merge(mods, links):
    mods = [(n, o, list(f)) for n, o, f in mods]
    while True:
        best, at = 0, None
        for i in range(len(mods)):
            for j in range(i + 1, len(mods)):
                n = len({tuple(sorted(e)) for e in links if {e[0] in mods[i][2], e[1] in mods[i][2]} == {True, False} and (e[0] in mods[j][2] or e[1] in mods[j][2])})
                share = n / (len(mods[i][2]) * len(mods[j][2]))
                if share >= 0.4 and share > best:
                    best, at = share, (i, j)
        if at is None:
            return {tuple(sorted(m[2])) for m in mods}
        i, j = at
        mods = [m for k, m in enumerate(mods) if k not in at] + [("m", "merged", mods[i][2] + mods[j][2])]


def test_additive_counts_give_the_same_merges():
    rng = random.Random(3)
    for _ in range(40):
        files = [f"d{rng.randrange(6)}/f{i}" for i in range(14)]
        links = {(rng.choice(files), rng.choice(files)) for _ in range(25)}
        links = {(a, b) for a, b in links if a != b}
        groups = {}
        for f in files:
            groups.setdefault(f.split("/")[0], []).append(f)
        mods = [(n, "directory", sorted(v)) for n, v in sorted(groups.items())]
        assert {tuple(sorted(m[2])) for m in modules.merge_coupled(mods, links)} == brute_merge(mods, links)


def test_clusters_partition_the_files(spark):
    rng = random.Random(4)
    files = [("r", f"d{rng.randrange(4)}/s{rng.randrange(2)}/f{i}") for i in range(30)] + [("q", "only.py")]
    pairs = [("r", rng.choice(files[:30])[1], rng.choice(files[:30])[1]) for _ in range(40)]
    out = modules.cluster(spark.createDataFrame(files, "repo_id string, path string"), spark.createDataFrame(pairs, "repo_id string, src string, dst string")).collect()
    assert sorted((r.repo_id, r.path) for r in out) == sorted(files)
    names = {(r.repo_id, r.name) for r in out}
    assert len({n for repo, n in names if repo == "r"}) == len([n for n in names if n[0] == "r"])


def test_layering_thresholds(spark):
    owned = lambda f, b: spark.createDataFrame([(f"a{i}", f"b{i}", "A", "B") for i in range(f)] + [(f"b{i}", f"a{i}", "B", "A") for i in range(b)], "src string, dst string, src_module string, dst_module string")
    hit = modules.layering(owned(10, 1)).collect()
    assert len(hit) == 1 and hit[0].against == "backward" and hit[0].minority == 1
    assert modules.layering(owned(5, 5)).count() == 0 and modules.layering(owned(2, 1)).count() == 0 and modules.layering(owned(8, 0)).count() == 0
    assert {(r.src, r.dst) for r in modules.minority_edges(owned(10, 1), modules.layering(owned(10, 1))).collect()} == {("b0", "a0")}


def brute_gate(rows, slots, queue):
    """State rebuilt from all operations so far, for every operation."""
    out = []
    for i, (seq, op, task) in enumerate(rows):
        running, waiting = [], []
        for j, (_, o, t) in enumerate(rows[: i + 1]):
            promoted, result = None, None
            if o == "acquire":
                known = t in running or t in waiting
                if not known and len(running) < slots:
                    running.append(t)
                elif not known and len(waiting) < queue:
                    waiting.append(t)
                result = "running" if t in running else "queued" if t in waiting else "rejected"
            else:
                result = "released" if t in running + waiting else "unknown"
                if t in running:
                    running.remove(t)
                    if waiting:
                        promoted = waiting.pop(0)
                        running.append(promoted)
                elif t in waiting:
                    waiting.remove(t)
        place = waiting.index(task) + 1 if op == "acquire" and task in waiting else 0
        out.append((seq, task, result, place, promoted))
    return out


def test_gate_equals_brute_force(spark):
    from loamline.streaming import limits

    rng = random.Random(8)
    rows = [(f"g{rng.randrange(3)}", i, rng.choice(["acquire", "acquire", "release"]), f"t{rng.randrange(7)}") for i in range(300)]
    got = limits.gate(spark.createDataFrame(rows, "gate string, seq long, op string, task_id string"), 2, 3).collect()
    for g in ("g0", "g1", "g2"):
        own = sorted((r.seq, r.task_id, r.result, r.place, r.promoted) for r in got if r.gate == g)
        assert own == brute_gate([r[1:] for r in rows if r[0] == g], 2, 3)


def test_reads_covered_before_equal_brute_force(spark):
    from loamline.operators import ranking

    rng = random.Random(9)
    rows = []
    for i in range(400):
        a = rng.randint(1, 200)
        rows.append((f"p{rng.randrange(4)}", i, a, a + rng.randint(0, 60)))
    got = {r.seq for r in ranking.overlapped_reads(spark.createDataFrame(rows, "path string, seq long, start long, end long"), ["path"]).collect()}
    want = {i for p, i, a, b in rows if any(q == p and j < i and min(b, d) - max(a, c) + 1 >= 0.6 * (b - a + 1) for q, j, c, d in rows)}
    assert got == want


def test_quota_equals_brute_force(spark):
    from loamline.operators import ranking

    rng = random.Random(10)
    for spread in (1000, 3):
        rows = [(f"r{i:03}", rng.randint(1, 50), float(rng.randrange(spread)), rng.random() < 0.2) for i in range(300)]
        total, want = sum(r[1] for r in rows), []
        for repo, size, _, running in sorted(rows, key=lambda r: (r[2], r[0])):
            if not running and total > 3000:
                want.append((repo, total))
                total -= size
        got = ranking.lru_evictions(spark.createDataFrame(rows, "repo string, size long, last_used double, running boolean"), 3000).collect()
        assert sorted((r.repo, r.used_before) for r in got) == sorted(want)
