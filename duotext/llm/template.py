"""A small sandboxed template language, compiled to Python closures.

    {{ expr }}   {% for x in expr %} … {% endfor %}   {% if e %} … {% elif e %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}

Expressions know strings, whole numbers, names, fields of rows (``x.role``), ``== != + and or not``,
parentheses and the filters given to :func:`compile_template`. There are no calls, no attributes of
Python objects and no loops but over rows, so every template ends: a loop inside ``k`` others takes at
most the number of rows to the power of ``k + 1`` steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\w+)|(==|!=|[|.+()]))""", re.S)


class TemplateError(ValueError):
    pass


# Syntax trees are tuples: ("text", s), ("const", v), ("name", n), ("field", e, n), ("op", o, a, b),
# ("not", e), ("filter", n, e), ("print", e), ("for", n, e, body), ("if", [(e, body)…]), ("gen", body).


class _Expression:
    def __init__(self, source: str, filters: dict):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()

    def peek(self):
        return self.tokens[0] if self.tokens else None

    def take(self, *wanted):
        if not self.tokens or (wanted and self.tokens[0] not in wanted):
            raise TemplateError(f"expected {wanted or 'more'}, found {self.peek()!r}")
        return self.tokens.pop(0)

    def whole(self):
        tree = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _chain(self, ops, below):
        left = below()
        while self.peek() in ops:
            left = ("op", self.take(), left, below())
        return left

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        return ("not", self.negated()) if self.peek() == "not" and self.take() else self.compared()

    def compared(self):
        return self._chain(("==", "!="), self.added)

    def added(self):
        return self._chain(("+",), self.filtered)

    def filtered(self):
        tree = self.simple()
        while self.peek() in ("|", "."):
            if self.take() == ".":
                tree = ("field", tree, self.take())
            else:
                name = self.take()
                if name not in self.filters:
                    raise TemplateError(f"unknown filter {name!r}")
                tree = ("filter", name, tree)
        return tree

    def simple(self):
        token = self.take()
        if token == "(":
            tree = self.either()
            self.take(")")
            return tree
        if token[0] in "'\"":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1], flags=re.S))
        if token.isdigit():
            return ("const", int(token))
        if token in ("true", "false"):
            return ("const", token == "true")
        if not token.isidentifier() or token.startswith("_"):
            raise TemplateError(f"unexpected {token!r}")
        return ("name", token)


def parse(source: str, filters: dict) -> list:
    """The tree of a template."""
    parts, at = [], 0
    for m in _BLOCK.finditer(source):
        parts.append(("text", source[at : m.start()]))
        parts.append(("print", _Expression(m[1], filters).whole()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    parts.reverse()

    def body(*ends):
        out = []
        while parts:
            kind, value = part = parts.pop()
            if kind != "tag":
                out.append(part)
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read for {rest!r}")
                out.append(("for", m[1], _Expression(m[2], filters).whole(), body("endfor")[0]))
            elif word == "generation":
                out.append(("gen", body("endgeneration")[0]))
            elif word == "if":
                cases, test = [], _Expression(rest, filters).whole()
                while True:
                    inner, word, rest = body("elif", "else", "endif")
                    cases.append((test, inner))
                    if word == "endif":
                        break
                    test = _Expression(rest, filters).whole() if word == "elif" else ("const", True)
                out.append(("if", cases))
            else:
                raise TemplateError(f"unexpected {{% {value} %}}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return out, "", ""

    return body()[0]


def _apply(op: str, a, b):
    try:
        return {"==": lambda: a == b, "!=": lambda: a != b, "and": lambda: a and b, "or": lambda: a or b, "+": lambda: a + b}[op]()
    except TypeError as e:
        raise TemplateError(f"{op} does not take {a!r} and {b!r}") from e


def fold(tree: list, filters: dict) -> list:
    """Evaluate what holds constants only; join neighbouring texts; drop branches never taken."""

    def expr(e):
        if e[0] == "op":
            a, b = expr(e[2]), expr(e[3])
            return ("const", _apply(e[1], a[1], b[1])) if a[0] == b[0] == "const" else ("op", e[1], a, b)
        if e[0] == "not":
            a = expr(e[1])
            return ("const", not a[1]) if a[0] == "const" else ("not", a)
        if e[0] == "filter":
            a = expr(e[2])
            return ("const", filters[e[1]](str(a[1]))) if a[0] == "const" else ("filter", e[1], a)
        return ("field", expr(e[1]), e[2]) if e[0] == "field" else e

    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "print":
            e = expr(node[1])
            add(("text", str(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "for":
            add(("for", node[1], expr(node[2]), fold(node[3], filters)))
        elif node[0] == "gen":
            add(("gen", fold(node[1], filters)))
        elif node[0] == "if":
            cases = []
            for test, inner in node[1]:
                test = expr(test)
                if test[0] != "const":
                    cases.append((test, fold(inner, filters)))
                elif test[1]:
                    cases.append((test, fold(inner, filters)))
                    break
            if cases and cases[0][0][0] == "const":
                for x in cases[0][1]:
                    add(x)
            elif cases:
                add(("if", cases))
        else:
            add(node)
    return out


def compile_template(source: str, filters: dict[str, Callable[[str], str]]):
    """``render(names) -> (text, spans)``; spans are the stretches of text made inside generation
    blocks, as code point offsets, in order."""

    def value(e):
        kind = e[0]
        if kind == "const":
            return lambda names, v=e[1]: v
        if kind == "name":
            return lambda names, n=e[1]: names[n]
        if kind == "field":
            return lambda names, of=value(e[1]), n=e[2]: of(names)[n]
        if kind == "filter":
            return lambda names, f=filters[e[1]], of=value(e[2]): f(str(of(names)))
        if kind == "not":
            return lambda names, of=value(e[1]): not of(names)
        a, b, op = value(e[2]), value(e[3]), e[1]
        if op == "and":
            return lambda names: a(names) and b(names)
        if op == "or":
            return lambda names: a(names) or b(names)
        return lambda names: _apply(op, a(names), b(names))

    def block(tree):
        steps = [step(x) for x in tree]

        def run(names, out):
            for s in steps:
                s(names, out)

        return run

    def step(node):
        kind = node[0]
        if kind == "text":
            return lambda names, out, s=node[1]: out.add(s)
        if kind == "print":
            of = value(node[1])
            return lambda names, out: out.add(str(of(names)))
        if kind == "for":
            name, rows, inner = node[1], value(node[2]), block(node[3])

            def loop(names, out):
                for row in rows(names):
                    inner({**names, name: row}, out)

            return loop
        if kind == "gen":
            inner = block(node[1])

            def mark(names, out):
                start = out.size
                inner(names, out)
                out.spans.append((start, out.size))

            return mark
        cases = [(value(test), block(inner)) for test, inner in node[1]]

        def choose(names, out):
            for test, inner in cases:
                if test(names):
                    return inner(names, out)

        return choose

    class Out:
        def __init__(self):
            self.parts, self.spans, self.size = [], [], 0

        def add(self, text):
            self.parts.append(text)
            self.size += len(text)

    run = block(fold(parse(source, filters), filters))

    def render(**names):
        out = Out()
        run(names, out)
        return "".join(out.parts), out.spans

    return render
