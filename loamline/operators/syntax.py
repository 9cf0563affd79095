"""Syntax nodes as rows, and structure as joins on their intervals.

Every node of a file is numbered as it is entered, and knows the last number
inside it: a node contains another one if its interval does. Symbols, what
encloses what, and the review detectors are queries over this table; the
parsers know nothing of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import paths
from loamline.functions.joins import exchanged
from loamline.operators import python_source, typescript_source

FILE = ["repo_id", "path"]
NODE = (
    "repo_id string, path string, language string, enter int, leave int, depth int, parent int, kind string, field string,"
    " nth int, name string, text string, start_line int, end_line int"
)
ROWS_AT_ONCE = 20_000

# Calls that the review detectors look for.
IO_CALLS = {
    "os": ["remove", "unlink", "rmdir", "mkdir", "makedirs", "rename", "listdir"],
    "shutil": ["copy", "copytree", "move", "rmtree"],
    "requests": ["get", "post", "put", "delete", "patch", "head", "request"],
    "httpx": ["get", "post", "put", "delete", "patch", "head", "request"],
    "urllib": ["urlopen"],
    "socket": ["connect", "bind", "send", "recv", "sendall"],
    "subprocess": ["run", "call", "check_call", "check_output", "Popen"],
    "json": ["load", "loads"],
    "pickle": ["load", "loads"],
    "yaml": ["load", "safe_load"],
    "sqlite3": ["connect"],
}
IO_BUILTINS = ["open", "urlopen"]
SQL_WORDS = r"(?i)\b(select|insert\s+into|update|delete\s+from|where|from|join|union)\b"
SQL_EXECUTORS = ["execute", "executemany", "executescript", "query", "raw"]
SHELL_CALLS = ["system", "popen", "getoutput", "getstatusoutput"]
SUBPROCESS_CALLS = ["run", "call", "check_call", "check_output", "Popen"]
UNSAFE_MODULES = ["pickle", "cPickle", "dill", "shelve", "marshal"]
UNSAFE_LOADS = ["loads", "load"]
UNSAFE_EVAL = ["eval", "exec"]
TS_IO_CALLS = {"fs": ["readFile", "writeFile", "readFileSync", "writeFileSync", "unlink"], "JSON": ["parse"]}
TS_IO_BUILTINS = ["fetch"]
TS_SHELL_CALLS = ["exec", "execSync", "spawnSync", "spawn"]
TS_UNSAFE_EVAL = ["eval", "Function"]

FUNCTION_BODIES = ["FunctionDef.body", "AsyncFunctionDef.body", "function.body", "method.body"]
CLASS_BODIES = ["ClassDef.body", "class.body"]


def nodes(files: DataFrame) -> DataFrame:
    """The node table (NODE) of all files with a parsed suffix.

    ``files``: ``repo_id``, ``path``, ``text``. A Python file's nodes are those
    of its syntax tree, with a node for every list of statements; a TypeScript
    file's are declarations, blocks, calls and leaves (see the two ``nodes``
    functions). Of a file that doesn't parse as a whole the pieces that do
    give rows; null texts give none.
    """
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int32() for c in NODE.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text"))):
                python = path.endswith((".py", ".pyi"))
                found = (python_source if python else typescript_source).nodes(text)[0]
                rows += [(repo, path, "python" if python else "typescript", *r) for r in found]
                if len(rows) >= ROWS_AT_ONCE:
                    yield packed(rows)
                    rows = []
        yield packed(rows)

    own = files.where(F.lower(paths.suffix(F.col("path"))).isin(paths.PARSED_SUFFIXES) & F.col("text").isNotNull())
    return own.select(*[F.col(c).cast("string").alias(c) for c in (*FILE, "text")]).mapInArrow(run, NODE)


def inside(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs of a node of ``found`` and a node of ``boxes`` that contains it: ``repo_id``, ``path``, ``enter``, ``box`` (all columns of the box).

    Nodes of one depth never overlap, so a node's ancestor of a depth can only
    be the last one entered before it. Each node asks once for each depth above
    its own, and one sort by position answers; nodes and boxes of a file are
    never paired.
    """
    box = F.struct(*[F.col(c) for c in boxes.columns])
    marks = boxes.select(*FILE, "depth", "enter", box.alias("box"), F.lit(False).alias("asks"))
    asks = found.select(*FILE, "enter", "depth").distinct().where("depth > 0").select(*FILE, F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("depth"), "enter", F.lit(None).cast(marks.schema["box"].dataType).alias("box"), F.lit(True).alias("asks"))
    so_far = Window.partitionBy(*FILE, "depth").orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asks).withColumn("box", F.last("box", ignorenulls=True).over(so_far))
    return met.where("asks and box.leave >= enter").select(*FILE, "enter", "box")


def nearest(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """``found`` with ``box``, the innermost node of ``boxes`` around each; null for none."""
    best = inside(found, boxes).groupBy(*FILE, "enter").agg(F.max_by("box", "box.depth").alias("box"))
    return found.join(exchanged(best), [*FILE, "enter"], "left")


def parents_of(found: DataFrame) -> DataFrame:
    """Keys of the parents of nodes, to be joined on."""
    return found.select(*FILE, F.col("parent").alias("enter")).distinct()


def with_parent(found: DataFrame, parents: DataFrame) -> DataFrame:
    """Those of ``found`` whose parent is one of ``parents``."""
    return found.join(exchanged(parents.select(*FILE, F.col("enter").alias("parent")).distinct()), [*FILE, "parent"], "left_semi")


def having(found: DataFrame, keys: DataFrame, have: bool = True) -> DataFrame:
    """Those of ``found`` whose number is, or isn't, among ``keys``."""
    return found.join(exchanged(keys.select(*FILE, "enter").distinct()), [*FILE, "enter"], "left_semi" if have else "left_anti")


def symbols(table: DataFrame) -> DataFrame:
    """Declarations: ``repo_id``, ``path``, ``name``, ``kind``, ``start_line``, ``end_line``, ``parent``, ``qualified_name``.

    The parent is the class that a declaration stands in, with no function
    between the two; a function with a parent is a method.
    """
    declared = F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef", "function", "method", "class", "interface", "type_alias")
    around = nearest(table.where(declared), table.where(F.col("kind").isin(*FUNCTION_BODIES, *CLASS_BODIES)))
    kind, python = F.col("kind"), F.col("language") == "python"
    parent = F.when(F.col("box.kind").isin(CLASS_BODIES) & (python | (kind == "method")), F.col("box.name"))
    kind = F.when(~python, kind).when(kind == "ClassDef", "class").when(parent.isNotNull(), "method").otherwise("function")
    out = around.select(*FILE, "name", kind.alias("kind"), "start_line", "end_line", parent.alias("parent")).dropDuplicates([*FILE, "name", "start_line"])
    return out.withColumn("qualified_name", F.coalesce(F.concat("parent", F.lit("."), "name"), "name"))


def dynamic_strings(table: DataFrame) -> DataFrame:
    """Python nodes that put a string together at run time: f-strings with values, literals with + or % and something, ``"...".format(...)``.

    The left operands of operators nested to the left follow each other, so
    such a run is an island of consecutive numbers: all from an operator on to
    the end of its island must be + or %, and the last must be a literal.
    """
    filled = having(table.where("kind = 'JoinedStr'"), parents_of(table.where("kind = 'FormattedValue'")))
    on_literal = table.where("kind = 'Constant' and name = 'str' and field = 'value'").select(*FILE, (F.col("enter") - 2).alias("enter"), (F.col("parent") - 1).alias("call")).where("enter = call")
    formatted = having(table.where("kind = 'Call' and name = 'format'"), on_literal)
    starts = ~((F.col("field") == "left") & (F.col("parent") == F.col("enter") - 1))
    by_place = Window.partitionBy(*FILE).orderBy("enter").rowsBetween(Window.unboundedPreceding, 0)
    run = table.where("kind = 'BinOp' or field = 'left'").join(exchanged(formatted.select(*FILE, "enter", F.lit(True).alias("is_format"))), [*FILE, "enter"], "left")
    run = run.withColumn("island", F.max(F.when(starts, F.col("enter"))).over(by_place))
    literal = (F.col("kind") == "JoinedStr") | ((F.col("kind") == "Constant") & (F.col("name") == "str")) | F.coalesce("is_format", F.lit(False))
    island = Window.partitionBy(*FILE, "island").orderBy(F.desc("enter"))
    joins = (F.col("kind") == "BinOp") & F.col("name").isin("Add", "Mod")
    run = run.withColumns({"good": joins | literal, "last": F.first(literal).over(island)})
    run = run.withColumn("all_good", F.min(F.col("good").cast("int")).over(island.rowsBetween(Window.unboundedPreceding, 0)))
    added = run.where("kind = 'BinOp' and last and all_good = 1").select(*table.columns)
    return filled.unionByName(formatted).unionByName(added)


def _listed(calls: dict[str, list[str]], on: Column) -> Column:
    return F.concat(on, F.lit("."), F.col("name")).isin([f"{k}.{m}" for k, ms in calls.items() for m in ms])


def _as(found: DataFrame, category: str, kind: str, evidence: Column | str, confidence: Column | str) -> DataFrame:
    def said(x):
        return x if isinstance(x, Column) else F.lit(x)

    return found.select(*FILE, "enter", "depth", F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.col("start_line").alias("line"), said(evidence).alias("evidence"), said(confidence).alias("confidence"))


def _python(t: DataFrame) -> list[DataFrame]:
    calls = t.where("kind = 'Call'")
    called = F.concat(F.when(F.col("text") != "", F.concat("text", F.lit("."))).otherwise(""), "name")
    handlers = t.where("kind = 'ExceptHandler'")
    bare = having(handlers, parents_of(t.where("field = 'type'")), have=False)

    ellipses = having(t.where("kind = 'Expr'"), parents_of(t.where("kind = 'Constant' and name = 'Ellipsis' and field = 'value'")))
    acting = having(t.where("field = 'body' and kind <> 'Pass'"), ellipses, have=False)
    idle = having(t.where("kind = 'ExceptHandler.body'"), parents_of(acting), have=False)
    swallowed = having(handlers, parents_of(idle))

    io = calls.where(_listed(IO_CALLS, F.substring_index("text", ".", -1)) | ((F.col("text") == "") & F.col("name").isin(IO_BUILTINS)))
    loose = having(io, inside(io, t.where("kind in ('Try.body', 'TryStar.body')")), have=False)

    assigned = with_parent(t.where("field = 'value'"), t.where("kind in ('Assign', 'AnnAssign')"))
    opened = assigned.where("kind = 'Call' and name = 'open'")
    unclosed = nearest(opened, t.where(F.col("kind").isin("With", "AsyncWith", *FUNCTION_BODIES))).where("box is null or box.kind not in ('With', 'AsyncWith')")

    dynamic = dynamic_strings(t)
    put_together = having(assigned, dynamic)
    words = t.where(F.col("kind").isin("Constant", "Name", "Attribute") & F.coalesce("text", "name").rlike(SQL_WORDS))
    worded = having(put_together, inside(words, put_together).select(*FILE, F.col("box.enter").alias("enter")))
    on_dynamic = parents_of(having(t.where("field = 'args' and nth = 0"), dynamic)).withColumn("dynamic", F.lit(True))
    with_shell = with_parent(t.where("kind = 'Constant' and name = 'True'"), t.where("kind = 'keyword' and name = 'shell'"))
    with_shell = parents_of(having(t.where("kind = 'keyword'"), parents_of(with_shell))).withColumn("shell", F.lit(True))
    loader = t.where("name like '%Loader%'")
    yaml = calls.where("text = 'yaml' and name = 'load'")
    told = inside(loader, yaml).select(*FILE, F.col("box.enter").alias("enter")).distinct().withColumn("loader", F.lit(True))
    marked = calls.join(exchanged(on_dynamic), [*FILE, "enter"], "left").join(exchanged(with_shell), [*FILE, "enter"], "left").join(exchanged(told), [*FILE, "enter"], "left").fillna(False, ["dynamic", "shell", "loader"])

    shelled = (F.col("name").isin(SHELL_CALLS) & F.col("dynamic")) | (F.col("text").isin("subprocess", "sp") & F.col("name").isin(SUBPROCESS_CALLS) & F.col("shell"))
    unsafe = (F.col("text").isin(UNSAFE_MODULES) & F.col("name").isin(UNSAFE_LOADS)) | ((F.col("text") == "yaml") & (F.col("name") == "load") & ~F.col("loader")) | ((F.col("text") == "") & F.col("name").isin(UNSAFE_EVAL))
    return [
        _as(bare, "error_handling", "bare_except", "handler without a type", "certain"),
        _as(swallowed, "error_handling", "swallowed_exception", "handler without a statement", "certain"),
        _as(loose, "error_handling", "unprotected_io", F.concat(called, F.lit(" outside try")), "contextual"),
        _as(unclosed, "error_handling", "unclosed_resource", "open() assigned outside with", "contextual"),
        _as(worded, "security", "sql_injection", "SQL text put together from values", "contextual"),
        _as(marked.where(F.col("name").isin(SQL_EXECUTORS) & F.col("dynamic")), "security", "sql_injection", F.concat("name", F.lit(" on SQL put together from values")), "certain"),
        _as(marked.where(shelled), "security", "command_injection", F.concat("name", F.lit(" runs a shell")), F.when(F.col("dynamic"), "certain").otherwise("contextual")),
        _as(marked.where(unsafe), "security", "unsafe_deserialization", called, "certain"),
    ]


def _typescript(t: DataFrame) -> list[DataFrame]:
    calls = t.where("kind = 'call'")
    called = F.concat(F.coalesce(F.concat("text", F.lit(".")), F.lit("")), "name")
    empty = t.where("kind = 'catch.body' and leave = enter")
    io = calls.where(_listed(TS_IO_CALLS, F.col("text")) | (F.col("text").isNull() & F.col("name").isin(TS_IO_BUILTINS)))
    loose = having(io, inside(io, t.where("kind = 'try.body'")), have=False)
    first = with_parent(t.where("kind = 'string' and nth = 0 and name in ('filled', 'joined')"), t.where("kind = 'call.args'"))
    dynamic = having(calls, parents_of(having(t.where("kind = 'call.args'"), parents_of(first))))
    return [
        _as(having(t.where("kind = 'catch'"), parents_of(empty)), "error_handling", "swallowed_exception", "catch without a statement", "certain"),
        _as(loose, "error_handling", "unprotected_io", F.concat(called, F.lit(" outside try")), "contextual"),
        _as(dynamic.where(F.col("name").isin(SQL_EXECUTORS)), "security", "sql_injection", F.concat("name", F.lit(" on SQL put together from values")), "certain"),
        _as(dynamic.where(F.col("name").isin(TS_SHELL_CALLS)), "security", "command_injection", F.concat("name", F.lit(" runs a shell")), "certain"),
        _as(calls.where(F.col("text").isNull() & F.col("name").isin(TS_UNSAFE_EVAL)), "security", "unsafe_deserialization", F.col("name"), "certain"),
    ]


def candidates(table: DataFrame) -> DataFrame:
    """What the detectors find: ``repo_id``, ``path``, ``category``, ``kind``, ``line``, ``evidence``, ``confidence``, ``enclosing`` (a function's name or '').

    ``table`` is read by every detector: pass a stored or persisted one.
    """
    found = _python(table.where("language = 'python'")) + _typescript(table.where("language = 'typescript'"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    around = nearest(every, table.where(F.col("kind").isin(FUNCTION_BODIES)).select(*FILE, "enter", "leave", "depth", "name"))
    return around.select(*FILE, "category", "kind", "line", "evidence", "confidence", F.coalesce("box.name", F.lit("")).alias("enclosing"))
