"""Parsing, chunks, imports, entry points and reading of small repositories."""

import textwrap

from pyspark.sql import functions as F

from loamline.functions import paths
from loamline.operators import chunks, entrypoints, imports, python_source, typescript_source
from loamline.sources import repos

FILES = "repo_id string, path string, size long, text string"


def files(spark, tree, repo="r"):
    return spark.createDataFrame([(repo, p, len(t.encode()), textwrap.dedent(t)) for p, t in tree.items()], FILES)


PY = textwrap.dedent('''
    import os, sys
    from . import sibling
    from ..pkg.mod import a, b as c
    from x import *
    if TYPE_CHECKING:
        import guarded
    else:
        import other

    @deco
    def top(a):
        import late
        def inner():
            pass
        try:
            return open(a)
        except:
            pass

    class C(Base):
        import in_class
        x = 1

        @property
        def m(self):
            return requests.get("u")

        class D:
            def n(self): ...

    def q(db, x):
        sql = f"select * from t where a = {x}"
        db.execute("select " + x)
        db.execute("select ?", x)
        db.execute(x + "select")
        os.system("rm %s" % x)
        os.system("ls")
        subprocess.run(["a"], shell=True)
        subprocess.run(["a"])
        pickle.loads(x)
        self.pickle.loads(x)
        yaml.load(x)
        yaml.load(x, Loader=yaml.SafeLoader)
        eval(x)
        with open(x) as f:
            f.read()
        h = open(x)
''')


def test_python_symbols():
    s = {(n, k, p): (a, b) for n, k, a, b, p in python_source.read(PY).symbols}
    lines = PY.splitlines()
    at = lambda t: next(i for i, x in enumerate(lines, 1) if t in x)
    assert s["top", "function", None][0] == at("@deco")
    assert s["inner", "function", None][0] == at("def inner")
    assert s["m", "method", "C"][0] == at("@property") and s["n", "method", "D"][0] == at("def n")
    assert s["C", "class", None][1] == at("def n") and s["D", "class", "C"][0] == at("class D")


def test_python_imports_and_scopes():
    got = {(t, s): n for _, t, _, s, n in python_source.read(PY).imports}
    assert {k for k in got} == {("os", "module"), ("sys", "module"), (".", "module"), ("..pkg.mod", "module"), ("x", "module"), ("guarded", "type_guarded"), ("other", "module"), ("late", "deferred"), ("in_class", "module")}
    assert got["..pkg.mod", "module"] == ["a", "b"] and got["x", "module"] == ["*"]


TS = textwrap.dedent('''
    import def, { a as b, type T } from "./mod";
    import type { X } from "./types";
    import "./effect";
    import * as ns from 'pkg';
    export { y } from "./re";
    export * from "./all";
    // import no from "./comment"
    const text = `import nope from "x" ${a + "}"}`;
    export const Panel = (p: Props) => {
      try { fetch("u"); } catch (e) {}
      return /[/"]/.test(p);
    };
    export default class K extends B {
      private x = 1;
      handle = async (e) => { fetch("v"); };
      get(q: string): Promise<void> { db.query(`select ${q}`); db.query("select 1"); }
    }
    export interface I { a(): void }
    type Alias = { b: string };
    function* gen() { if (x) { eval("1"); } obj.eval("2"); }
''')


def test_typescript():
    out = typescript_source.read(TS)
    assert {(n, k, p) for n, k, _, _, p in out.symbols} == {("Panel", "function", None), ("K", "class", None), ("handle", "method", "K"), ("get", "method", "K"), ("I", "interface", None), ("Alias", "type_alias", None), ("gen", "function", None)}
    assert {(t, k) for _, t, k, _, _ in out.imports} == {("./mod", "from"), ("./types", "type_only"), ("./effect", "module"), ("pkg", "from"), ("./re", "reexport"), ("./all", "reexport")}


def test_parse_gives_a_row_for_every_failure(spark):
    df = files(spark, {"a.py": "x = 1", "b.py": "def (", "c.ts": "const x = () => 1;", "d.md": "no", "e.py": "#" * 50}).union(spark.createDataFrame([("r", "f.py", 3, None)], FILES))
    out = {r.path: (r.status, r.reason) for r in repos.parse(df, most_bytes=40).collect()}
    assert out["a.py"] == ("parsed", None) and out["c.ts"] == ("parsed", None) and "d.md" not in out
    assert out["b.py"][1].startswith("syntax error") and out["e.py"][1].startswith("too large") and out["f.py"][1] == "not UTF-8"
    reasons = {r.reason: r.n for r in repos.unparsed_reasons(repos.parse(df, 40)).collect()}
    assert reasons == {"syntax error": 1, "too large": 1, "not UTF-8": 1}


def test_python_resolution(spark):
    tree = {
        "pkg/__init__.py": "", "pkg/a.py": "from .sub import b\nfrom . import sub\nimport pkg.c\nimport numpy\nfrom .missing import x\nimport pkg.a", "pkg/c.py": "", "pkg/sub/__init__.py": "", "pkg/sub/b.py": "from ..c import f",
        "src/lib/tool.py": "", "main.py": "import lib.tool\nfrom pkg import a, c",
    }
    df = files(spark, tree)
    found = imports.resolve_python(repos.imports(repos.parse(df)), df)
    got = {(r.path, r.target, r.dst, r.outcome) for r in found.collect()}
    assert ("pkg/a.py", ".sub", "pkg/sub/b.py", "resolved") in got and ("pkg/a.py", ".", "pkg/__init__.py", "resolved") in got  # members are files, not packages
    assert ("pkg/a.py", "pkg.c", "pkg/c.py", "resolved") in got and ("pkg/a.py", "numpy", None, "external") in got
    assert ("pkg/a.py", ".missing", None, "unresolved") in got and ("main.py", "lib.tool", "src/lib/tool.py", "resolved") in got
    assert {d for p, t, d, _ in got if (p, t) == ("main.py", "pkg")} == {"pkg/a.py", "pkg/c.py"}
    tables = imports.graph_tables(found)
    edges = {(r.src, r.dst) for r in tables["edges"].collect()}
    assert ("pkg/a.py", "pkg/a.py") not in edges and ("pkg/sub/b.py", "pkg/c.py") in edges
    assert [(r.target, r.importers) for r in tables["external"].collect()] == [("numpy", ["pkg/a.py"])]
    assert [r.target for r in tables["unresolved"].collect()] == [".missing"]


ALIASES = "repo_id string, pattern string, replacement string, seq int, nth int, base_url string"


def test_typescript_resolution_with_aliases(spark):
    tree = {
        "src/app.ts": 'import a from "@/lib/a";\nimport "./b.js";\nimport "./dir";\nimport "react";\nimport "./gone";\nimport "exact";\nimport type { T } from "./types";\nimport "@/z";\nimport "@/missing/thing";\nimport "./dir.js";\nimport "../../out";',
        "src/lib/a.tsx": "", "src/b.ts": "", "src/dir/index.ts": "", "src/types.d.ts": "", "vendor/e.ts": "", "lib/z.ts": "", "lib/z/index.ts": "",
    }
    df = files(spark, tree)
    rows = [("r", "@/*", "src/*", 0, 0, None), ("r", "@/*", "lib/*", 0, 1, None), ("r", "exact", "vendor/e", 1, 0, None), ("r", "@/lib/*", "src/lib/*", 2, 0, None)]
    own = imports.alias_targets(repos.imports(repos.parse(df)), spark.createDataFrame(rows, ALIASES))
    found = imports.resolve_typescript(own, df)
    got = {r.target: (r.dst, r.outcome) for r in found.collect()}
    assert got["@/lib/a"] == ("src/lib/a.tsx", "resolved") and got["./b.js"] == ("src/b.ts", "resolved") and got["./dir"] == ("src/dir/index.ts", "resolved")
    assert got["react"] == (None, "external") and got["./gone"] == (None, "unresolved") and got["exact"] == ("vendor/e.ts", "resolved")
    assert got["@/z"] == ("lib/z.ts", "resolved")  # the second target
    assert got["@/missing/thing"] == got["./dir.js"] == got["../../out"] == (None, "unresolved")
    assert {r.target: r.aliased for r in own.collect()}["@/z"] == ["src/z", "lib/z"]
    assert len(imports.graph_tables(found, with_types=False)["edges"].where("dst like '%types%'").collect()) == 0


def test_configurations_of_repositories(spark):
    tree = {
        "tsconfig.json": '{\n // own\n "extends": "./conf/base", "compilerOptions": {"paths": {"@/*": ["app/*", "lib/*"],},}}',
        "conf/base.json": '{"compilerOptions": {"baseUrl": "src"}}', "conf/tsconfig.base.json": "{", "tsconfig.base.json": '{"compilerOptions": {"paths": {"#/*": ["x/*"]}}}',
    }
    df = files(spark, tree)
    got = {(r.pattern, r.replacement, r.nth, r.base_url) for r in imports.repository_aliases(df).collect()}
    assert got == {("@/*", "app/*", 0, None), ("@/*", "lib/*", 1, None)}  # only files named tsconfig*.json are configurations
    tree["tsconfig.json"] = '{"extends": "./conf/tsconfig.base", "compilerOptions": {"paths": {"@/*": ["app/*"]}}}'
    tree["conf/tsconfig.base.json"] = '{"extends": "./gone.json", "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["*"], "@/*": ["old/*", "older/*"]}}}'
    got = {(r.pattern, r.replacement, r.base_url) for r in imports.repository_aliases(files(spark, tree)).collect()}
    assert got == {("@/*", "app/*", "src"), ("~/*", "*", "src")}
    tree["tsconfig.json"] = '{"compilerOptions": {"baseUrl": "."}}'
    assert imports.repository_aliases(files(spark, tree)).collect() == []
    del tree["tsconfig.json"]
    assert [(r.pattern, r.replacement) for r in imports.repository_aliases(files(spark, tree)).collect()] == [("#/*", "x/*")]


def test_inherited_aliases(spark):
    rows = [("r", "a.json", "b.json", None, "@/*", "src/*", 0, 0), ("r", "b.json", "c.json", "base", "@/*", "old/*", 0, 0), ("r", "b.json", "c.json", "base", "~/*", "lib/*", 1, 0), ("r", "c.json", None, "far", "#/*", "root/*", 0, 0), ("r", "d.json", "d.json", None, None, None, 0, 0)]
    out = imports.inherited_aliases(spark.createDataFrame(rows, "repo_id string, config string, extends string, base_url string, pattern string, replacement string, seq int, nth int"))
    assert {(r.pattern, r.replacement, r.base_url) for r in out.where("config = 'a.json'").collect()} == {("@/*", "src/*", "base"), ("~/*", "lib/*", "base"), ("#/*", "root/*", "base")}
    assert out.where("config = 'd.json'").collect() == []


def test_entry_points(spark):
    tree = {
        "pyproject.toml": '[project.scripts]\nrun = "tool.cli:main"\n', "src/tool/cli.py": "", "web/package.json": '{"main": "dist/index.js", "bin": {"x": "./bin/x.js"}, "exports": {".": {"import": "./lib/m.mjs"}}, // c\n}',
        "web/src/index.ts": "", "web/bin/x.ts": "", "web/lib/m.ts": "", "apps/a/project.json": '{"targets": {"build": {"options": {"main": "apps/a/main.ts"}}}}', "apps/a/main.ts": "", "manage.py": "", "deep/a/b/index.ts": "",
        "node_modules/p/package.json": '{"main": "i.ts"}', "node_modules/p/i.ts": "", "bad/package.json": "{", "setup.py": "", "root.py": "", "leaf.py": "",
    }
    df = files(spark, tree)
    edges = spark.createDataFrame([("r", "root.py", "leaf.py"), ("r", "manage.py", "leaf.py")], "repo_id string, src string, dst string")
    got = {r.path: r.kind for r in entrypoints.entry_points(df, edges).collect()}
    assert got == {"src/tool/cli.py": "manifest", "web/src/index.ts": "manifest", "web/bin/x.ts": "manifest", "web/lib/m.ts": "manifest", "apps/a/main.ts": "manifest", "setup.py": "manifest", "manage.py": "convention", "root.py": "graph_root"}


def test_chunks_of_a_class_and_module_code():
    text = "import a\nimport b\n\nX = 1\n\n\nclass C:\n    y = 1\n\n    def m(self):\n        return 1\n\n\ndef f():\n    def g():\n        pass\n    return g\n"
    got = [(k, s, a, b) for _, _, a, b, _, s, _, k, _ in chunks.chunk_file("a.py", text)]
    assert got == [("module", "", 1, 4), ("class_header", "C", 7, 9), ("method", "m", 10, 11), ("function", "f", 14, 17)]
    assert chunks.chunk_file("a.py", "") == [] and chunks.chunk_file("a.py", "x = 1\n") == []


def test_long_functions_are_cut_at_statements():
    body = "".join(f"    x{i} = {i}\n" for i in range(300))
    rows = chunks.chunk_file("a.py", "def f():\n" + body)
    assert [r[8] for r in rows] == [1, 2, 3] and all(b - a + 1 <= 130 for _, _, a, b, *_ in rows)
    assert rows[0][2] == 1 and rows[-1][3] == 301 and all(x[3] - y[2] + 1 == 8 for x, y in zip(rows, rows[1:]))
    whole = chunks.chunk_file("a.py", "x = [\n" + "1,\n" * 400 + "]\n")
    assert [r[8] for r in whole] == [1, 2, 3, 0] and len({r[0] for r in whole}) == 4


def test_chunk_table_skips_secret_shaped_files(spark):
    out = chunks.chunk(files(spark, {"a.py": "x = 1\ny = 2\n", "k.pem": "x\ny\n", ".env": "a\nb\n", ".env.ts": "const a = 1;\nconst b = 2;\n"})).collect()
    assert {r.path for r in out} == {"a.py", ".env.ts"} and {r.chunk_id for r in out} == {"a.py:1-2", ".env.ts:1-2"}


def test_read_files_and_profile(spark, tmp_path):
    for p, t in {"r1/src/a.py": "x\r\ny\x0bz", "r1/node_modules/m.js": "1", "r1/b.md": "b", "r2/c.ts": "a\n"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t.encode())
    (tmp_path / "r2/d.py").write_bytes(b"\xff\xfe")
    df = repos.read_files(spark, str(tmp_path))
    rows = {(r.repo_id, r.path): r for r in repos.described(df).collect()}
    assert set(rows) == {("r1", "src/a.py"), ("r1", "b.md"), ("r2", "c.ts"), ("r2", "d.py")}
    a = rows["r1", "src/a.py"]
    assert (a.dir, a["name"], a.suffix, a.language, a.n_lines_py, a.n_lines_nl) == ("src", "a.py", ".py", "Python", 3, 2)
    assert rows["r2", "d.py"].text is None
    profile = {(r.repo_id, r.language): (r.n, r.share) for r in repos.language_profile(df).collect()}
    assert profile["r1", "Markdown"] == (1, 0.5) and profile["r2", "Python"] == (1, 0.5)
    assert {r.repo_id: r.admit_reason for r in repos.inventory(df).collect()} == {"r1": None, "r2": None}


def test_paths(spark):
    cases = {"a/./b/../c": "a/c", "..\\x": "", "../a": "", "a/..": "", "a//b": "a/b", "a/b/../../c": "c", "a/../../b": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", paths.normalise(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == cases
    shaped = spark.createDataFrame([(x,) for x in ("a/.env", "b/x.PEM", "c/.env.ts", "d/key.py")], "p string").select("p", paths.secret_shaped(F.col("p")).alias("s"), paths.stem(F.col("p")).alias("t"))
    assert {r.p for r in shaped.collect() if r.s} == {"a/.env", "b/x.PEM"}
    stems = spark.createDataFrame([("x.d.ts",), ("a/b.tsx",), ("c.js",)], "p string").select("p", paths.stem(F.col("p")).alias("t"))
    assert {r.p: r.t for r in stems.collect()} == {"x.d.ts": "x.d", "a/b.tsx": "a/b", "c.js": None}


def test_history_round_trip(spark, tmp_path):
    folder = str(tmp_path / "h")
    rows = spark.createDataFrame([(f"t{i}", float(i), "r", "s", i) for i in range(5)], "task_id string, created_at double, repo string, commit_sha string, finding_count int")
    repos.save_history(rows, folder)
    (tmp_path / "h" / "part-x.json").write_text('{"task_id": "bad"\n{"task_id": "old", "schema_version": 0, "created_at": 9.0}\n')
    kept, skipped = repos.read_history(spark, folder, 3)
    assert [r.task_id for r in kept.collect()] == ["t4", "t3", "t2"]
    assert tuple(skipped.first()) == (1, 1)
