"""TypeScript sources through a small tokeniser and brace matcher.

Covers declarations (functions, classes with methods, interfaces, type
aliases, arrow functions bound by a single const), imports and re-exports, try
and catch blocks and calls. Strings, templates, regular expressions and
comments are skipped as tokens.
"""

from __future__ import annotations

import re

from loamline.operators.python_source import Source

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<regex>(?<![\w)\]])\s*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<arrow>=>)|(?P<mark>[{}()\[\];,=.:<>+*?&|!-])|(?P<number>\d[\w.]*)""",
    re.S,
)
NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "await", "typeof", "constructor_"}


#: Words before a bracket that call nothing.
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await"}
#: Of spans on the same tokens, leaves come inside.
LEAVES = {"string": 1, "word": 1, "number": 1}


class _Tokens:
    def __init__(self, text: str):
        self.kind, self.text, self.line = [], [], []
        at, line = 0, 1
        for m in TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup not in ("comment", "regex"):
                self.kind.append(m.lastgroup)
                self.text.append(m.group(m.lastgroup))
                self.line.append(line)
        self.match: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.text):
            if self.kind[i] == "mark" and t in "{([":
                stack.append(i)
            elif self.kind[i] == "mark" and t in "})]" and stack:
                self.match[stack.pop()] = i

    def __len__(self) -> int:
        return len(self.text)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self) and self.text[i] in texts and self.kind[i] != "string"

    def find(self, i: int, *texts: str, stop: tuple[str, ...] = (";",)) -> int:
        """Next of ``texts`` outside brackets, or -1."""
        while i < len(self):
            if self.is_(i, *texts):
                return i
            if self.is_(i, *stop):
                return -1
            i = self.match.get(i, i) + 1 if self.is_(i, "(", "[", "{") else i + 1
        return -1


def _block(t: _Tokens, i: int) -> tuple[int, int] | None:
    """The braces after ``i`` at its level: (open, close)."""
    b = t.find(i, "{")
    return (b, t.match[b]) if b >= 0 and b in t.match else None


#: First and last token, kind, name, text, first line.
Span = tuple[int, int, str, str, str | None, int]


def read(text: str) -> Source:
    """Symbols, imports and definitions of a file."""
    return _scan(_Tokens(text))[0]


def _scan(t: _Tokens) -> tuple[Source, list[Span]]:
    out, spans = Source(), []
    def start_line(i: int) -> int:
        while i > 0 and t.is_(i - 1, "export", "default", "async", "abstract", "declare", "public", "private", "protected", "static", "readonly", "const", "override"):
            i -= 1
        return t.line[i]

    def add(i: int, name: str, kind: str, span: tuple[int, int], parent: str | None = None, methods: int = 0) -> None:
        begin, end = start_line(i), t.line[span[1]]
        out.symbols.append((name, kind, begin, end, parent))
        spans.append((i, span[1], kind, name, None, begin))
        spans.append((*span, f"{kind}.body", name, None, t.line[span[0]]))
        if kind in ("function", "method", "class"):
            out.definitions.append((begin, end, name, parent, kind, sorted({t.line[j + 1] for j in range(span[0], span[1]) if t.is_(j, "{", ";", "}") and j + 1 < span[1]}), methods))

    def arrow(i: int) -> tuple[int, int] | None:
        """Body of a function value that starts at ``i``."""
        if t.is_(i, "async"):
            i += 1
        if t.is_(i, "function"):
            return _block(t, i)
        j = t.match.get(i, i) + 1 if t.is_(i, "(") else i + 1
        j = t.find(j, "=>", stop=(";", ",", "=", ")", "}"))
        if j < 0:
            return None
        if t.is_(j + 1, "{"):
            return (j + 1, t.match.get(j + 1, j + 1))
        end = t.find(j + 1, ";", stop=())
        return (j, end if end >= 0 else len(t) - 1)

    def members(span: tuple[int, int], name: str) -> int:
        i, first = span[0] + 1, 0
        while i < span[1]:
            if t.kind[i] == "word" and t.text[i] not in NOT_METHODS:
                j = t.find(i + 1, "(", stop=(";", "=", "{", "}", ":")) if not t.is_(i + 1, "(") else i + 1
                if j >= 0 and (j == i + 1 or t.is_(i + 1, "<")) and j in t.match:
                    body = t.find(t.match[j] + 1, "{", stop=(";", "}"))
                    if body >= 0 and body in t.match:
                        add(i, t.text[i], "method", (body, t.match[body]), name)
                        first = first or start_line(i)
                        i = t.match[body] + 1
                        continue
                eq = t.find(i + 1, "=", stop=(";", "(", "{", "}")) if t.is_(i + 1, "=", ":") else -1
                if eq >= 0 and (a := arrow(eq + 1)):
                    add(i, t.text[i], "method", a, name)
                    i = a[1] + 1
                    continue
            i = t.match.get(i, i) + 1 if t.is_(i, "(", "[", "{") else i + 1
        return first

    for i in range(len(t)):
        if t.kind[i] != "word" or t.is_(i - 1, "."):
            continue
        w, nxt = t.text[i], t.text[i + 1] if i + 1 < len(t) else ""
        if w == "function" and i + 1 < len(t):
            j = i + 2 if nxt == "*" else i + 1
            if t.kind[j] == "word" and (b := _block(t, j)):
                add(i, t.text[j], "function", b)
        elif w in ("class", "interface") and t.kind[min(i + 1, len(t) - 1)] == "word" and (b := _block(t, i + 1)):
            at = len(out.definitions)
            if w == "class":
                add(i, nxt, "class", b)
                first = members(b, nxt)
                out.definitions[at] = (*out.definitions[at][:6], first)
            else:
                add(i, nxt, "interface", b)
        elif w == "type" and i + 2 < len(t) and t.kind[i + 1] == "word" and (t.is_(i + 2, "=", "<")):
            end = t.find(i + 2, ";", stop=())
            add(i, nxt, "type_alias", (i, end if end >= 0 else i))
        elif w in ("const", "let", "var") and i + 1 < len(t) and t.kind[i + 1] == "word":
            eq = t.find(i + 2, "=", stop=(";", ",", "}"))
            if eq >= 0 and (a := arrow(eq + 1)):
                add(i + 1, nxt, "function", a)
        elif w == "import" and i + 1 < len(t) and not t.is_(i + 1, "(", "."):
            j = next((k for k in range(i + 1, min(i + 400, len(t))) if t.kind[k] == "string" or t.is_(k, ";")), -1)
            if j >= 0 and t.kind[j] == "string":
                names = [t.text[k] for k in range(i + 1, j) if t.kind[k] == "word" and t.text[k] not in ("type", "from", "as")] + (["*"] if any(t.is_(k, "*") for k in range(i + 1, j)) else [])
                kind = "type_only" if nxt == "type" and not t.is_(i + 2, "from", ",") else "module" if j == i + 1 else "from"
                out.imports.append((t.line[i], t.text[j][1:-1], kind, "module", names))
                spans.append((i, j, "import", t.text[j][1:-1], None, t.line[i]))
        elif w == "export" and i + 1 < len(t) and t.is_(i + 1, "*", "{", "type"):
            k = i + 2 if nxt == "type" else i + 1
            k = t.match.get(k, k) + 1 if t.is_(k, "{") else k + 1
            j = next((x for x in range(k, min(k + 4, len(t))) if t.kind[x] == "string"), -1)
            if j >= 0 and any(t.is_(x, "from") for x in range(k, j)):
                names = ["*"] if nxt == "*" else [t.text[x] for x in range(i + 1, k) if t.kind[x] == "word" and t.text[x] not in ("as", "type")]
                out.imports.append((t.line[i], t.text[j][1:-1], "reexport", "module", names))
                spans.append((i, j, "import", t.text[j][1:-1], None, t.line[i]))
        elif w == "try" and t.is_(i + 1, "{") and i + 1 in t.match:
            spans.append((i + 1, t.match[i + 1], "try.body", "", None, t.line[i + 1]))
        elif w == "catch":
            j = t.match.get(i + 1, i + 1) + 1 if t.is_(i + 1, "(") else i + 1
            if t.is_(j, "{") and j in t.match:
                spans += [(i, t.match[j], "catch", "", None, t.line[i]), (j, t.match[j], "catch.body", "", None, t.line[j])]

    out.symbols = sorted(dict.fromkeys(out.symbols), key=lambda s: (s[2], s[0]))
    out.imports.sort(key=lambda x: (x[0], x[1]))
    return out, spans


def nodes(text: str) -> tuple[list[tuple], str]:
    """Rows as ``python_source.nodes`` gives them.

    Declarations and their bodies, try and catch blocks, imports, calls with
    their arguments in brackets, and as leaves the words, strings, templates
    and numbers. A call is named by its function and has as text what it is
    made on; ``nth`` is 0 for what stands first in a bracket, else 1. A string is ``str``, or ``joined`` where a ``+`` follows; a
    template is ``template``, or ``filled`` with values in it.
    """
    t = _Tokens(text)
    spans = _scan(t)[1]
    for i, (kind, word) in enumerate(zip(t.kind, t.text)):
        if kind == "word" and t.is_(i + 1, "(") and i + 1 in t.match and word not in NOT_CALLS and not t.is_(i - 1, "function"):
            on = t.text[i - 2] if t.is_(i - 1, ".") and i > 1 else None
            first = i - 2 if on is not None else i
            spans.append((first, t.match[i + 1], "call", word, on, t.line[i]))
            spans.append((i + 1, t.match[i + 1], "call.args", word, None, t.line[i + 1]))
        if kind == "string":
            label = ("filled" if "${" in word else "template") if word[0] == "`" else "joined" if t.is_(i + 1, "+") else "str"
            spans.append((i, i, "string", label, word, t.line[i]))
        elif kind in ("word", "number"):
            spans.append((i, i, kind, word, None, t.line[i]))
    spans.sort(key=lambda s: (s[0], -s[1], LEAVES.get(s[2], 0)))
    rows: list[list] = []
    open_: list[tuple[int, int]] = []  # last token, row
    for a, b, kind, name, said, line in spans:
        while open_ and open_[-1][0] < a:
            rows[open_.pop()[1]][1] = len(rows) - 1
        if open_ and b > open_[-1][0]:
            continue  # crosses what it begins in: not a node
        parent = open_[-1][1] if open_ else -1
        nth = 0 if t.is_(a - 1, "(") else 1
        rows.append([len(rows), 0, len(open_), parent, kind, "", nth, name, said, line, t.line[b]])
        open_.append((b, len(rows) - 1))
    while open_:
        rows[open_.pop()[1]][1] = len(rows) - 1
    return [tuple(r) for r in rows], ""
