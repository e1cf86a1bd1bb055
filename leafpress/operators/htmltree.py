"""HTML trees: a repairing parser, addresses (preorder numbers and xpaths), and a serialiser.

The parser covers the part of the HTML5 tree construction that pages rely on:
implied html, head and body, implied end tags, formatting elements that reopen
in later blocks, table sections, raw text and void elements. A node's text is
what precedes its first child; its tail is what follows the node.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style iframe noembed noframes xmp noscript title textarea".split())
SCOPE = frozenset("html table td th caption button object marquee applet template svg math".split())
_IMPLIED = frozenset("dd dt li option optgroup p rb rp rt rtc".split())
_SPACE = " \t\n\r\f"


class Node:
    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent", "pid", "xpath")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.text = self.tail = ""
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.pid: int | None = None
        self.xpath = ""

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def write(self, text: str) -> None:
        if self.children:
            self.children[-1].tail += text
        else:
            self.text += text

    def remove(self) -> None:
        """Detach; the text that follows stays in the parent."""
        up = self.parent
        if up is None:
            return
        i = up.children.index(self)
        if i:
            up.children[i - 1].tail += self.tail
        else:
            up.text += self.tail
        del up.children[i]
        self.parent, self.tail = None, ""

    def below(self) -> Iterator[Node]:
        """All descendants in document order."""
        todo = self.children[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.children[::-1]

    def all(self) -> Iterator[Node]:
        yield self
        yield from self.below()


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = self.root.add(Node("head"))
        self.body: Node | None = None
        self.open: list[Node] = [self.root]
        self.active: list[Node] = []
        self.raw: str | None = None

    # -- the stack of open elements --

    def _body(self) -> None:
        if self.body is None:
            self.body = self.root.add(Node("body"))
            self.open = [self.root, self.body]

    def _within(self, tags: frozenset | set, stop: frozenset = SCOPE) -> Node | None:
        for node in reversed(self.open):
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
        return None

    def _pop_to(self, node: Node) -> None:
        while self.open[-1] is not node:
            self.open.pop()
        self.open.pop()

    def _close_p(self) -> None:
        if p := self._within({"p"}):
            self._pop_to(p)

    def _reopen(self) -> None:
        """Formatting elements that a block's end closed are opened again."""
        if not self.active or self.active[-1] in self.open:
            return
        at = len(self.active)
        while at and self.active[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            new = self.open[-1].add(Node(old.tag, dict(old.attrs)))
            self.open.append(new)
            self.active[i] = new

    # -- tokens --

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, True)

    def _start(self, tag: str, pairs: list, closed: bool) -> None:
        if self.raw:
            if self.raw in ("title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"):
                self.open[-1].write(self.get_starttag_text() or "")
            return
        attrs: dict[str, str] = {}
        for k, v in pairs:
            attrs.setdefault(k, v or "")
        if tag == "html" or tag == "body":
            if tag == "body":
                self._body()
            target = self.root if tag == "html" else self.body
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        if self.body is None and tag in HEAD_ONLY:
            self._insert(self.head, tag, attrs, closed)
            return
        self._body()
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag == "li" or tag in ("dd", "dt"):
            kinds = {"li"} if tag == "li" else {"dd", "dt"}
            if node := self._within(kinds, SCOPE | {"ul", "ol", "dl"}):
                self._pop_to(node)
            self._close_p()
        elif tag in ("option", "optgroup") and self.open[-1].tag == "option":
            self.open.pop()
        elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
            self._table(tag)
        elif tag == "a" and (old := next((n for n in self.active if n.tag == "a"), None)):
            self._end_formatting(old)
        if tag not in CLOSES_P and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup", "col", "script", "style", "link", "meta", "base"):
            self._reopen()
        node = self._insert(self.open[-1], tag, attrs, closed)
        if tag in FORMATTING and not closed:
            same = [n for n in self.active if n.tag == tag and n.attrs == attrs]
            if len(same) >= 3:  # at most three alike are reopened
                self.active.remove(same[0])
            self.active.append(node)

    def _insert(self, into: Node, tag: str, attrs: dict, closed: bool) -> Node:
        node = into.add(Node(tag, attrs))
        foreign = tag in ("svg", "math") or any(n.tag in ("svg", "math") for n in self.open)
        if tag in VOID or closed and foreign:
            return node
        self.open.append(node)
        if tag in RAW and not foreign:
            self.raw = tag
        return node

    def _table(self, tag: str) -> None:
        """Close and imply table sections so that the element has its place."""
        if self._within({"table"}, frozenset()) is None:
            return
        cells, rows, parts = {"td", "th"}, {"tr"}, {"tbody", "thead", "tfoot", "caption", "colgroup"}
        stop = frozenset({"table", "html"})
        for kinds in ([cells] if tag in cells else [cells, rows] if tag == "tr" else [cells, rows, parts]):
            if node := self._within(kinds, stop):
                self._pop_to(node)
        need = {"tr": ["tbody"], "td": ["tbody", "tr"], "th": ["tbody", "tr"], "col": ["colgroup"]}.get(tag, [])
        for kind in need:
            have = {"tbody", "thead", "tfoot"} if kind == "tbody" else {kind}
            if self._within(have, stop) is None:
                while self.open[-1].tag not in ("table", "tbody", "thead", "tfoot", "html"):
                    self.open.pop()
                self.open.append(self.open[-1].add(Node(kind)))

    def _end_formatting(self, node: Node) -> None:
        if node in self.active:
            self.active.remove(node)
        if node in self.open:
            at = self.open.index(node)
            if any(n.tag in CLOSES_P or n.tag in SCOPE for n in self.open[at + 1 :]):
                del self.open[at]  # blocks inside stay open
            else:
                del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag == self.raw:
                self.raw = None
                self.open.pop()
            else:
                self.open[-1].write(f"</{tag}>")
            return
        if tag in ("html", "body", "head"):
            if tag == "head":
                return
            self._body()
            return
        if tag == "br":
            self._start("br", [], False)
            return
        if self.body is None:
            return
        if tag == "p":
            if self._within({"p"}) is None:
                self.open[-1].add(Node("p"))
            else:
                self._close_p()
            return
        if tag in FORMATTING:
            if old := next((n for n in reversed(self.active) if n.tag == tag), None):
                self._end_formatting(old)
                return
        stop = SCOPE - {tag} if tag in SCOPE else SCOPE
        kinds = HEADINGS if tag in HEADINGS else {tag}
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"):
            stop = frozenset({"table", "html"})
        if tag == "table":
            stop = frozenset({"html"})
        if node := self._within(kinds, stop):
            if node is not self.body and node is not self.root:
                self._pop_to(node)

    def handle_data(self, data: str) -> None:
        if self.raw:
            self.open[-1].write(data)
            return
        if self.body is None:
            if not data.strip(_SPACE):
                return
            data = data.lstrip(_SPACE)
            self._body()
        if self.open[-1].tag not in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
            self._reopen()
        self.open[-1].write(data)


def parse(html: str) -> Node:
    """The repaired tree of a page."""
    builder = _Builder()
    builder.feed(html.replace("\r\n", "\n").replace("\x00", ""))
    builder.close()
    builder._body()
    return builder.root


def address(root: Node, first: int = 1) -> int:
    """Number the elements in document order and give them xpaths; the last number."""
    pid = first
    root.xpath = f"/{root.tag}"
    todo = [root]
    while todo:
        node = todo.pop()
        node.pid, pid = pid, pid + 1
        count: dict[str, int] = {}
        for c in node.children:
            count[c.tag] = count.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        for c in node.children:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            c.xpath = f"{node.xpath}/{c.tag}" + (f"[{seen[c.tag]}]" if count[c.tag] > 1 else "")
        todo += node.children[::-1]
    return pid - 1


def serialise(node: Node, tail: bool = False) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
        after = escape(n.tail, quote=False) if n is not node or tail else ""
        if n.tag in VOID and not n.children and not n.text:
            out.append(f"<{n.tag}{attrs} />{after}")
        else:
            out.append(f"<{n.tag}{attrs}>")
            out.append(n.text if n.tag in ("script", "style") else escape(n.text, quote=False))
            todo.append(f"</{n.tag}>{after}")
            todo += n.children[::-1]
    return "".join(out)


_NUMBER = re.compile(r"^[+-]?[0-9]+$")
_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_-]*$")


def prune(root: Node, useless: list[str], absolute: Callable[[str], str]) -> list[Node]:
    """Drop hidden, useless and navigation elements; the style and formula nodes saved on the way."""
    saved: list[Node] = []

    def visit(node: Node) -> list[Node]:
        """The children that stay to be looked at."""
        style = node.attrs.get("style", "")
        if node.attrs.get("aria-hidden") == "true":
            if node.tag != "svg":
                node.remove()
            return []
        if "display: none" in style or "display:none" in style:
            node.remove()
            return []
        if node.tag == "iframe":
            node.children, node.text = [], ""
            return []
        if node.tag in useless:
            formula = node.tag == "script" and "math" in node.attrs.get("src", "")
            if formula or node.tag == "style":
                copy = Node(node.tag, dict(node.attrs))
                copy.text = node.text
                if copy.attrs.get("href"):
                    copy.attrs["href"] = absolute(copy.attrs["href"])
                saved.append(copy)
            node.remove()
            return []
        if node.attrs.get("class") in ("nav", "footer", "header"):
            node.remove()
            return []
        node.attrs = {k: v for k, v in node.attrs.items() if _NAME.match(k) and not _NUMBER.match(k)}
        return node.children[::-1]

    todo = [root]
    while todo:
        todo += visit(todo.pop())
    return saved
