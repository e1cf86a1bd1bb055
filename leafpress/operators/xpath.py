"""The part of XPath 1.0 that site rules use, over our trees.

Location steps with ``/`` and ``//``, names and ``*``, unions, and predicates of
positions, attributes, ``=``, ``!=``, ``and``, ``or``, ``not``, ``contains``,
``starts-with``, ``string-length``, ``text()`` and relative paths. As in XPath
1.0, a node set stands for the string of its first node in functions, and
matches in comparisons if any of its nodes does.
"""

from __future__ import annotations

import re
from functools import lru_cache

from leafpress.operators.htmltree import Node

_TOKEN = re.compile(r"""\s*(//|/|\.\.|\.|\||\[|\]|\(|\)|,|@|\*|!=|<=|>=|=|<|>|"[^"]*"|'[^']*'|\d+(?:\.\d+)?|[A-Za-z_][\w:.-]*)""")


class XPathError(ValueError):
    """An expression outside the supported part."""


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise XPathError(f"cannot read {text[at:]!r}")
        out.append(m[1])
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want and got != want:
            raise XPathError(f"expected {want or 'more'}, found {got!r}")
        self.i += 1
        return got

    def either(self) -> tuple:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.compared()
        while self.peek() == "and":
            self.take()
            out = ("and", out, self.compared())
        return out

    def compared(self) -> tuple:
        out = self.union()
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            out = (self.take(), out, self.union())
        return out

    def union(self) -> tuple:
        out = self.value()
        while self.peek() == "|":
            self.take()
            out = ("|", out, self.value())
        return out

    def value(self) -> tuple:
        p = self.peek()
        if p[:1] in "\"'" and p:
            return ("text", self.take()[1:-1])
        if p[:1].isdigit():
            return ("number", float(self.take()))
        if p == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        if self.peek(1) == "(" and p not in ("text", "node"):
            name = self.take()
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.either())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", name, args)
        return self.path()

    def path(self) -> tuple:
        steps, start = [], "here"
        if self.peek() in ("/", "//"):
            start = "root"
            deep = self.take() == "//"
        else:
            deep = False
        while True:
            steps.append(self.step(deep))
            if self.peek() not in ("/", "//"):
                return ("path", start, steps)
            deep = self.take() == "//"

    def step(self, deep: bool) -> tuple:
        p, kind, name = self.take(), "child", ""
        if p == "@":
            kind, name = "attr", self.take()
        elif p in (".", ".."):
            kind = "self" if p == "." else "parent"
        elif p == "text" and self.peek() == "(":
            self.take("(")
            self.take(")")
            kind = "text"
        elif re.match(r"[A-Za-z_*]", p):
            name = p
        else:
            raise XPathError(f"unexpected {p!r}")
        tests = []
        while self.peek() == "[":
            self.take()
            tests.append(self.either())
            self.take("]")
        return (kind, name, deep, tests)


@lru_cache(maxsize=4096)
def compiled(text: str) -> tuple:
    parser = _Parser(text)
    out = parser.either()
    if parser.peek():
        raise XPathError(f"unexpected {parser.peek()!r}")
    return out


def _string(node: Node) -> str:
    return node.text + "".join(_string(c) + c.tail for c in node.children)


def _as_string(v) -> str:
    if isinstance(v, list):
        return "" if not v else v[0] if isinstance(v[0], str) else _string(v[0])
    return v if isinstance(v, str) else str(v)


def _as_bool(v) -> bool:
    return bool(v)


def _texts(node: Node) -> list[str]:
    return [t for t in (node.text, *(c.tail for c in node.children)) if t]


def _evaluate(e: tuple, here: Node, root: Node, at: int = 1, last: int = 1):
    kind = e[0]
    ev = lambda x: _evaluate(x, here, root, at, last)
    if kind in ("text", "number"):
        return e[1]
    if kind == "or":
        return _as_bool(ev(e[1])) or _as_bool(ev(e[2]))
    if kind == "and":
        return _as_bool(ev(e[1])) and _as_bool(ev(e[2]))
    if kind == "|":
        got = {id(n): n for x in (e[1], e[2]) for n in ev(x)}
        return [n for n in root.all() if id(n) in got]
    if kind in ("=", "!=", "<", ">", "<=", ">="):
        a, b = ev(e[1]), ev(e[2])
        sides = [[x if isinstance(x, str) else _string(x) for x in v] if isinstance(v, list) else [v] for v in (a, b)]
        return any(_compare(kind, x, y) for x in sides[0] for y in sides[1])
    if kind == "call":
        args = [ev(a) for a in e[2]]
        if e[1] == "contains":
            return _as_string(args[1]) in _as_string(args[0])
        if e[1] == "starts-with":
            return _as_string(args[0]).startswith(_as_string(args[1]))
        if e[1] == "not":
            return not _as_bool(args[0])
        if e[1] == "string-length":
            return float(len(_as_string(args[0] if args else [here])))
        if e[1] == "position":
            return float(at)
        if e[1] == "last":
            return float(last)
        if e[1] == "count":
            return float(len(args[0]))
        if e[1] == "normalize-space":
            return " ".join(_as_string(args[0] if args else [here]).split())
        raise XPathError(f"unknown function {e[1]}")
    _, start, steps = e
    nodes: list = [None if start == "root" else here]
    for step in steps:
        nodes = _step(nodes, step, root)
    return nodes


def _compare(op: str, a, b) -> bool:
    if op in ("=", "!=") and isinstance(a, str) and isinstance(b, str):
        return (a == b) == (op == "=")
    try:
        x, y = float(a), float(b)
    except ValueError:
        return op == "!="
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _step(nodes: list, step: tuple, root: Node) -> list:
    kind, name, deep, tests = step
    out, seen = [], set()
    for base in nodes:
        starts = [base]
        if deep:
            starts = [None, *root.all()] if base is None else list(base.all())
        for n in starts:
            if kind == "child":
                got = [root] if n is None else n.children
                got = [c for c in got if name in ("*", c.tag)]
            elif n is None:
                continue
            elif kind == "attr":
                got = list(n.attrs.values()) if name == "*" else [n.attrs[name]] if name in n.attrs else []
            elif kind == "text":
                got = _texts(n)
            else:
                got = [n] if kind == "self" else [n.parent] if n.parent else []
            for test in tests:
                kept = []
                for i, c in enumerate(got, 1):
                    v = _evaluate(test, c, root, i, len(got)) if isinstance(c, Node) else True
                    if v == i if isinstance(v, float) else _as_bool(v):
                        kept.append(c)
                got = kept
            for c in got:
                if isinstance(c, str):
                    out.append(c)
                elif id(c) not in seen:
                    seen.add(id(c))
                    out.append(c)
    if len(nodes) > 1 or deep:
        if out and isinstance(out[0], Node):
            order = {id(n): i for i, n in enumerate(root.all())}
            out.sort(key=lambda n: order.get(id(n), 0))
    return out


def select(root: Node, path: str, here: Node | None = None) -> list[Node]:
    """Elements that a path finds, in document order."""
    if re.fullmatch(r"//[A-Za-z][\w-]*", path) and here is None:
        return [n for n in root.all() if n.tag == path[2:]]
    got = _evaluate(compiled(path), here or root, root)
    return [n for n in got if isinstance(n, Node)] if isinstance(got, list) else []
