"""Python sources through the standard parser: symbols, imports and definitions in one visit, and all nodes as rows."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass
class Source:
    """What one file yields. Rows are plain tuples in the order of the tables' columns."""

    symbols: list[tuple] = field(default_factory=list)  # name, kind, start, end, parent
    imports: list[tuple] = field(default_factory=list)  # line, target, kind, scope, names
    definitions: list[tuple] = field(default_factory=list)  # start, end, name, parent, kind, statement starts, first method line
    reason: str = ""


def first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


class _Visit:
    def __init__(self) -> None:
        self.out = Source()

    def body(self, nodes: list[ast.stmt], **at) -> None:
        for n in nodes:
            self.node(n, **at)

    def node(self, n: ast.AST, classes: tuple = (), scope: str = "module") -> None:
        at = {"classes": classes, "scope": scope}
        if isinstance(n, (*FUNCTIONS, ast.ClassDef)):
            self.definition(n, at)
            return
        if isinstance(n, ast.Import):
            self.out.imports += [(n.lineno, a.name, "module", scope, []) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            self.out.imports.append((n.lineno, "." * n.level + (n.module or ""), "from", scope, [a.name for a in n.names]))
        elif isinstance(n, ast.If):
            guarded = "TYPE_CHECKING" in ast.unparse(n.test) and scope == "module"
            self.body(n.body, classes=classes, scope="type_guarded" if guarded else scope)
            self.body(n.orelse, **at)
            return
        for child in ast.iter_child_nodes(n):
            if not isinstance(child, ast.expr):
                self.node(child, **at)

    def definition(self, n, at: dict) -> None:
        classes, is_class = at["classes"], isinstance(n, ast.ClassDef)
        parent = classes[-1] if classes else None
        start = first_line(n)
        kind = "class" if is_class else "method" if parent else "function"
        self.out.symbols.append((n.name, kind, start, n.end_lineno, parent))
        methods = [first_line(m) for m in n.body if isinstance(m, FUNCTIONS)] if is_class else []
        self.out.definitions.append((start, n.end_lineno, n.name, parent, kind, [first_line(s) for s in n.body], min(methods, default=0)))
        if is_class:
            self.body(n.body, **{**at, "classes": (*classes, n.name)})
        else:
            self.body(n.body, classes=(), scope="deferred")


#: Lines at the margin that go on with what stands above them.
GOES_ON = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}#]")


def parts(text: str) -> list[tuple[int, str]]:
    """(lines before, text) of the pieces of a file that begin at its margin; decorators begin the piece of what they decorate."""
    lines, starts, decorated = text.splitlines(keepends=True), [], False
    for n, line in enumerate(lines):
        if line.strip() and not line[0].isspace() and not GOES_ON.match(line):
            if not decorated:
                starts.append(n)
            decorated = line.startswith("@")
    return [(a, "".join(lines[a:b])) for a, b in zip(starts, [*starts[1:], len(lines)])]


def statements(text: str) -> tuple[list[ast.stmt], str]:
    """Statements of a file, and why some are missing: where the whole doesn't parse, those of the pieces that do."""
    try:
        return ast.parse(text).body, ""
    except (SyntaxError, ValueError, RecursionError) as e:
        why = f"syntax error: {type(e).__name__}"
    found: list[ast.stmt] = []
    for before, piece in parts(text):
        try:
            found += ast.increment_lineno(ast.parse(piece), before).body
        except (SyntaxError, ValueError, RecursionError):
            continue
    return found, why


def read(text: str) -> Source:
    """Everything of one file; ``reason`` says why nothing of it can be parsed. Pieces that don't parse are left out."""
    body, why = statements(text)
    if why and not body:
        return Source(reason=why)
    visit = _Visit()
    visit.body(body)
    out = visit.out
    out.symbols = sorted(dict.fromkeys(out.symbols), key=lambda s: (s[2], s[0]))
    out.imports.sort(key=lambda i: (i[0], i[1]))
    return out


#: Lists of statements and the like: each is a node of its own, so that being inside one is containment.
REGIONS = {"body", "orelse", "finalbody", "handlers", "items", "decorator_list"}


def _label(n: ast.AST) -> tuple[str, str | None]:
    """What a node is called, and the text that it stands for: of a call the object that it is made on, of a constant its string."""
    if isinstance(n, ast.Call):
        f = n.func
        return (f.attr, ast.unparse(f.value)) if isinstance(f, ast.Attribute) else (f.id if isinstance(f, ast.Name) else "", "")
    if isinstance(n, ast.Constant):
        return ("str", n.value) if isinstance(n.value, str) else (repr(n.value)[:100], None)
    if isinstance(n, ast.ImportFrom):
        return "." * n.level + (n.module or ""), None
    if isinstance(n, ast.BinOp):
        return type(n.op).__name__, None
    for own in ("name", "id", "attr", "arg"):
        if isinstance(value := getattr(n, own, None), str):
            return value, None
    return "", None


def nodes(text: str) -> tuple[list[tuple], str]:
    """(enter, leave, depth, parent, kind, field, nth, name, text, start_line, end_line) of every node, and why there is none.

    Nodes are numbered as they are entered; ``leave`` is the last number inside.
    Decorators count to the lines of what they decorate.
    """
    body, why = statements(text)
    if why and not body:
        return [], why
    rows: list[list] = []

    def put(kind: str, field: str, nth: int, parent: int, depth: int, name: str, said: str | None, lines: tuple[int, int]) -> int:
        rows.append([len(rows), 0, depth, parent, kind, field, nth, name, said, *lines])
        return len(rows) - 1

    def walk(n: ast.AST, field: str, nth: int, parent: int, depth: int, lines: tuple[int, int]) -> None:
        if hasattr(n, "lineno"):
            lines = (first_line(n), n.end_lineno or n.lineno)
        kind = type(n).__name__
        name, said = _label(n)
        me = put(kind, field, nth, parent, depth, name, said, lines)
        for f, value in ast.iter_fields(n):
            if isinstance(value, list) and f in REGIONS and value and isinstance(value[0], ast.AST):
                inside = [(first_line(c), c.end_lineno) for c in value if hasattr(c, "lineno")]
                at = (min(a for a, _ in inside), max(b for _, b in inside)) if inside else lines
                region = put(f"{kind}.{f}", f, 0, me, depth + 1, name, None, at)
                for i, c in enumerate(value):
                    walk(c, f, i, region, depth + 2, at)
                rows[region][1] = len(rows) - 1
            else:
                for i, c in enumerate(value if isinstance(value, list) else [value]):
                    if isinstance(c, ast.AST) and not isinstance(c, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                        walk(c, f, i, me, depth + 1, lines)
        rows[me][1] = len(rows) - 1

    try:
        for i, n in enumerate(body):
            walk(n, "body", i, -1, 0, (1, 1))
    except RecursionError:
        return [], "too deep"
    return [tuple(r) for r in rows], ""
