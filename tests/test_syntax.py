import random
from collections import Counter
from pathlib import Path

import pytest

import loamline
from loamline.operators import syntax
from loamline.sources import repos
from tests.test_sources import PY, TS, files


@pytest.fixture(scope="module")
def own(spark):
    """The nodes of this library's own files."""
    root = Path(loamline.__file__).parent
    tree = {str(p.relative_to(root)): p.read_text() for p in sorted(root.glob("*/*.py")) if p.parent.name != "llm"}
    df = files(spark, tree)
    return df, syntax.nodes(df).persist()


def test_numbers_nest(own):
    for path, rows in _by_file(own[1]).items():
        assert [r.enter for r in rows] == list(range(len(rows))), path
        open_ = []
        for r in rows:
            while open_ and open_[-1].leave < r.enter:
                open_.pop()
            assert (open_[-1].enter if open_ else -1) == r.parent and len(open_) == r.depth
            assert not open_ or r.leave <= open_[-1].leave
            open_.append(r)


def _by_file(table):
    out = {}
    for r in sorted(table.collect(), key=lambda r: (r.path, r.enter)):
        out.setdefault(r.path, []).append(r)
    return out


def test_inside_is_containment(spark, own):
    table = own[1]
    found, boxes = table.where("kind in ('Call', 'Name')"), table.where("kind in ('FunctionDef.body', 'Call', 'If')")
    got = Counter((r.path, r.enter, r.box.enter) for r in syntax.inside(found, boxes).collect())
    want = Counter()
    for path, rows in _by_file(table).items():
        around = [b for b in rows if b.kind in ("FunctionDef.body", "Call", "If")]
        want.update((path, r.enter, b.enter) for r in rows if r.kind in ("Call", "Name") for b in around if b.enter < r.enter <= b.leave)
    assert got == want and len(want) > 1000
    innermost = {(r.path, r.enter): r.box and r.box.enter for r in syntax.nearest(found, boxes).collect()}
    best = {}
    for path, enter, box in want:
        best[path, enter] = max(best.get((path, enter), -1), box)
    assert {k: v for k, v in innermost.items() if v is not None} == best
    assert len(innermost) == found.count()


def test_symbols_are_those_of_the_visit(own):
    df, table = own
    shown = ["path", "name", "kind", "start_line", "end_line", "parent"]
    got = Counter(map(tuple, syntax.symbols(table).select(*shown).collect()))
    assert got == Counter(map(tuple, repos.symbols(repos.parse(df)).select(*shown).collect()))
    assert sum(got.values()) > 300


def test_python_candidates(spark):
    found = syntax.candidates(syntax.nodes(files(spark, {"a.py": PY})).persist()).collect()
    count = Counter(r.kind for r in found)
    assert count["bare_except"] == count["swallowed_exception"] == 1
    assert sorted(r.confidence for r in found if r.kind == "sql_injection") == ["certain", "contextual"]
    assert sorted(r.confidence for r in found if r.kind == "command_injection") == ["certain", "contextual"]
    assert count["unsafe_deserialization"] == 3 and count["unclosed_resource"] == 1
    io = Counter(r.evidence.split()[0] for r in found if r.kind == "unprotected_io")
    assert io["requests.get"] == 1 and io["subprocess.run"] == 2
    assert {r.enclosing for r in found if r.kind == "bare_except"} == {"top"}


def test_typescript_candidates(spark):
    nested = "const outer = () => {\n  function inner() { fetch('a'); }\n  try { fetch('b'); } catch (e) { fetch('c'); }\n  g(() => { db.query(`${x}`, 'y'); db.query('y', `${x}`); exec('a' + b); });\n};\n"
    found = syntax.candidates(syntax.nodes(files(spark, {"a.ts": TS, "b.ts": nested})).persist()).collect()
    kinds = Counter((r.kind, r.enclosing) for r in found if r.path == "a.ts")
    assert kinds["swallowed_exception", "Panel"] == 1 and kinds["unprotected_io", "handle"] == 1 and ("unprotected_io", "Panel") not in kinds
    assert kinds["sql_injection", "get"] == 1 and kinds["unsafe_deserialization", "gen"] == 1
    assert Counter((r.kind, r.line, r.enclosing) for r in found if r.path == "b.ts") == Counter([("unprotected_io", 2, "inner"), ("unprotected_io", 3, "outer"), ("sql_injection", 4, "outer"), ("command_injection", 4, "outer")])


DYNAMIC = {'"a" + x': True, '"a" % x': True, 'f"a{x}"': True, 'f"a"': False, '"a".format(x)': True, 'a.format("b")': False, '"a" + b + c': True, 'b + "a"': False, '("a" - b) + c': False, '"a" * 3 + b': False, 'f"a" + b': True, '"a".format(x) + y % z': True, '"a".join(x)': False, '("a" < b) + c': False, '"a" + (b - c)': True, 'x + ("a" + y)': False}


def test_dynamic_strings(spark):
    table = syntax.nodes(files(spark, {f"{i}.py": f"f({e})\n" for i, e in enumerate(DYNAMIC)})).persist()
    first = syntax.having(table.where("field = 'args' and nth = 0"), syntax.dynamic_strings(table))
    assert {r.path for r in first.collect() if r.parent == 1} == {f"{i}.py" for i, (_, yes) in enumerate(DYNAMIC.items()) if yes}


def test_scopes_of_detectors(spark):
    source = "with a as b:\n    x = open(c)\n    def f():\n        y = open(c)\ntry:\n    json.load(a)\n    def g():\n        json.load(b)\nexcept (A, B):\n    json.load(c)\nelse:\n    json.load(d)\n@open(e)\ndef h(v=open(f)):\n    try: pass\n    except A:\n        ...\n        'text'\n    except B:\n        ...\n"
    found = syntax.candidates(syntax.nodes(files(spark, {"a.py": source})).persist()).collect()
    assert [r.line for r in found if r.kind == "unclosed_resource"] == [4]
    assert sorted((r.line, r.enclosing) for r in found if r.evidence.startswith("json")) == [(10, ""), (12, "")]
    assert sorted((r.line, r.enclosing) for r in found if r.evidence.startswith("open ")) == [(2, ""), (4, "f"), (13, ""), (14, "")]
    assert [r.line for r in found if r.kind == "swallowed_exception"] == [19]


def test_awkward_files(spark):
    rng = random.Random(2)
    junk = "".join(rng.choice("(){}[]'\"`=>,;\n ab") for _ in range(3000))
    tree = {"a.py": "", "b.py": "def (", "c.ts": "", "d.ts": junk, "e.py": "x = " + " + ".join(["a"] * 400), "f.md": "no", "g.py": "def ok(): pass\ndef ("}
    df = files(spark, tree).union(spark.createDataFrame([("r", "h.py", 0, None)], files(spark, tree).schema))
    by_path = _by_file(syntax.nodes(df))
    assert {"a.py", "b.py", "c.ts", "f.md", "h.py"}.isdisjoint(by_path) and "d.ts" in by_path
    assert [r.name for r in by_path["g.py"] if r.kind == "FunctionDef"] == ["ok"]
    assert syntax.candidates(syntax.nodes(files(spark, {"f.md": "no"})).persist()).collect() == []
