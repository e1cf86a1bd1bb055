"""The page kernel: everything on one page whose steps depend on their order.

One page goes in, one nested row comes out; the DataFrame operators call it in
Arrow batches and do the rest natively on its columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import SplitResult, parse_qs, urljoin, urlsplit

from leafpress.functions import fixed
from leafpress.functions.common import common_bytes
from leafpress.operators import sentences, xpath
from leafpress.operators.htmltree import Node, address, parse, prune, serialise

MARK = "data-leaf-"
VNODE = "leaf-"
_CLEAN = [(re.compile(p), into) for p, into in fixed.CLEAN_CHAIN]
_SKIP = frozenset("script style noscript iframe object".split())
_TEXT_ATTR = re.compile(r"^(\s|·)*|(\s|·)*\Z")


class PageError(ValueError):
    """A page that a rule refuses."""


@dataclass
class Rule:
    """What a site's rule says about its pages."""

    bodies: list[str] = field(default_factory=list)
    noises: list[str] = field(default_factory=list)
    title: str = ""
    author: str = ""
    pub_time: str = ""
    reserved_nodes: list[str] = field(default_factory=list)
    no_semantic_denoise: bool = False
    body_use_rule_only: bool = False


def clean(text: str) -> str:
    for pattern, into in _CLEAN:
        text = pattern.sub(into, text)
    return text.strip()


def unescape(html: str) -> str:
    return html.replace("&amp;", "&").replace("&nbsp;", " ").replace("<ne-", "<").replace("</ne-", "</")


def absolute(link: str, url: str) -> str:
    if link.startswith("http"):
        return link
    if link.startswith("//"):
        return "http:" + link
    if link.startswith("://"):
        return "http" + link
    try:
        return urljoin(url, link)
    except ValueError:
        return link


def _split(url: str) -> SplitResult:
    """The parts of a url; empty ones if it is none."""
    try:
        return urlsplit(url)
    except ValueError:
        return urlsplit("")


def size(text: str) -> int:
    return len(text.encode())


def share(part: int, whole: int) -> float:
    return part / whole if whole else (float("nan") if not part else float("inf"))


def _style(text: str) -> dict[str, str]:
    pairs = (p.split(":") for p in text.split(";"))
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}


def _unseen(node: Node) -> bool:
    hidden = "display:none" in node.attrs.get("style", "").replace(" ", "").lower()
    return hidden or node.attrs.get("class", "").replace(" ", "") == "hidden" or node.tag in _SKIP


def _block_text(top: Node) -> str:
    """Text of an element and what follows it, line by line in reading order."""
    if top.tag in _SKIP or top.tag == "head":
        return ""
    lines = [] if _unseen(top) or not top.text.strip() else [top.text.strip()]
    waiting: list[Node] = []
    shut: tuple[str, ...] = ()
    for node in top.below():
        while waiting and not node.xpath.startswith(waiting[-1].xpath):
            lines.append(waiting.pop().tail.strip())
        if node.xpath.startswith(shut):
            continue
        if _unseen(node):
            shut += (node.xpath,)
        elif node.text.strip():
            lines.append(node.text.strip())
        if node.tail.strip():
            waiting.append(node)
    lines += [n.tail.strip() for n in reversed(waiting)]
    return "\n".join([*lines, top.tail.strip()]).strip()


def raw_text(node: Node) -> str:
    """Readable text of an element."""
    parts = [node.text] if node.text.strip() else []
    return "\n".join(parts + [t for t in map(_block_text, node.children) if t])


def valid_image(n: Node) -> bool:
    return n.tag == "svg" and bool(n.children or n.text) or n.tag == "img" and any(n.attrs.get(a) for a in fixed.IMAGE_ATTRS)


def has_media(node: Node) -> bool:
    return any(valid_image(n) or n.tag == "video" for n in node.all())


def top_most(node: Node) -> Node:
    """The highest ancestor with the same text and no image or video of its own."""
    text, seen = clean(raw_text(node)), set()
    while node.parent is not None:
        up = node.parent
        todo, media = [up], False
        while todo and not media:
            n = todo.pop()
            if n.pid in seen:
                continue
            media = valid_image(n) or n.tag == "video"
            seen.add(n.pid)
            todo += n.children
        if media or clean(raw_text(up)) != text:
            break
        node = up
    return node


class Page:
    """A page's tree with its address, rule and metadata."""

    def __init__(self, html: str, url: str, rule: Rule | None = None, light: bool = True):
        self.url, self.rule = url, rule
        self.html = unescape(html) if light else html
        text = re.sub(r"(?i)<textarea\b([^>]*)>", r"<div\1>", self.html)
        self.root = parse(re.sub(r"(?i)</textarea>", "</div>", text))
        reserved = rule.reserved_nodes if rule else []
        self.saved = prune(self.root, [t for t in fixed.USELESS_TAGS if t not in reserved], lambda link: absolute(link, url))
        self.last_pid = address(self.root)

    def find(self, path: str) -> list[Node]:
        return xpath.select(self.root, path)

    def _attached(self, node: Node) -> bool:
        while node.parent is not None:
            node = node.parent
        return node is self.root

    # -- metadata --

    def by_xpath(self, paths: str) -> str:
        """First filled value of alternative paths; a path may end in an attribute or a function."""
        for path in paths.split(" | "):
            key = what = ""
            if m := re.search(r"/@(.*?)$", path):
                key, path = m[1], path[: m.start()]
            elif m := re.search(r"/([^/]+?)\(\)$", path):
                what, path = m[1], path[: m.start()]
            if found := self.find(path):
                n = found[0]
                value = n.attrs.get(key, "") if key else n.text if what == "text" else raw_text(n)
                if value := _TEXT_ATTR.sub("", value):
                    return value
        return ""

    def metas(self) -> dict[str, str]:
        out = {}
        for n in self.find("//meta"):
            key, value = n.attrs.get("name") or n.attrs.get("property") or "", n.attrs.get("content", "")
            if key and value:
                out[key] = value
        return out

    def title(self) -> str:
        ruled = self.by_xpath(self.rule.title).strip() if self.rule and self.rule.title else ""
        found = ruled
        for get in (lambda: self.by_xpath("//title"), lambda: next((self.metas()[k] for k in fixed.TITLE_META if k in self.metas()), ""), lambda: self.by_xpath(" | ".join(f"//h{i}" for i in range(1, 7)))):
            found = found or get().strip()
        if not found:
            return ""
        if not ruled:
            found = denoised_title(found)
        lines = [t.strip() for t in found.replace("\\n", "\n").split("\n")]
        return next((t for t in lines if t), found)

    def author(self) -> str:
        if self.rule and self.rule.author == "empty":
            return ""
        if self.rule and self.rule.author and (got := self.by_xpath(self.rule.author)):
            return got
        metas = self.metas()
        if got := next((metas[k] for k in fixed.AUTHOR_META if k in metas), ""):
            return got
        for n in self._author_nodes():
            if n.text:
                return n.text
        text = raw_text(self.root)
        if m := _AUTHOR.search(text):
            return m[2]
        m = re.search(fixed.AUTHOR_NAME, text)
        return m[1] if m else ""

    def _author_nodes(self) -> list[Node]:
        """Elements that name an author. A function of all attributes looks at the first one."""
        first = lambda n: next(iter(n.attrs.values()), "")
        some = lambda n, v: v in n.attrs.values()
        out, inside = [], set()
        for n in self.root.all():
            f = first(n)
            named = some(n, "author") or any(w in f for w in ("author", "Author", "作者"))
            own = named and not any(w in f for w in ("footer", "statement", "authorize", "comment"))
            if id(n.parent) in inside:
                inside.add(id(n))
            under = id(n.parent) in inside and (some(n, "name") or "name" in f)
            if own or under:
                out.append(n)
            if (some(n, "作者信息") or some(n, "author") or "author" in f or "author" in n.attrs.get("class", "")) and "comment" not in f:
                inside.add(id(n))
        return out

    def author_meta(self) -> dict[str, str]:
        uid = parse_qs(_split(self.metas().get("og:url", "")).query).get("__biz", [""])[0]
        get = lambda p: m[1] if (m := re.search(p, self.html)) else ""
        return {"name": self.author(), "profile_url": get(fixed.PROFILE_IMG), "description": get(fixed.AUTHOR_DESCRIPTION).strip(), "uid": uid or get(fixed.AUTHOR_ID)}

    def publish_time(self) -> str:
        """The time as found; the native function brings it to normal form."""
        if self.rule and self.rule.pub_time == "empty":
            return ""
        if self.rule and self.rule.pub_time and (got := self.by_xpath(self.rule.pub_time).strip()):
            return got
        metas = self.find("//meta")
        tagged = next((n.attrs["content"] for attr, start in fixed.TIME_META for n in metas if n.attrs.get(attr, "").startswith(start) and n.attrs.get("content")), "")
        if tagged.strip():  # a blank one leaves the time to the patterns
            return tagged.strip()
        if m := re.search(fixed.CREATE_TIME, self.html):
            return m[1].strip()
        for pattern in _TIMES:
            if m := pattern.search(self.html):
                return m[0].strip()
        return ""

    def icon(self) -> str:
        links = self.find("//link")
        if not links:
            return f"https://{_split(self.url).netloc}/favicon.ico"
        for n in links:
            if n.attrs.get("rel", "").lower() in ("icon", "shortcut icon") and n.attrs.get("href"):
                return absolute(n.attrs["href"], self.url)
        return ""

    def meta(self) -> dict:
        metas = self.metas()
        image = "" if "tmtpost.com" in self.url else next((absolute(metas[k], self.url) for k in fixed.IMAGE_META if k in metas), "")
        return {"title": self.title(), "author": self.author(), "content_source": "", "publish_time": self.publish_time(), "site_icon": self.icon(), "surface_image": image, "description": next((metas[k] for k in fixed.DESCRIPTION_META if k in metas), ""), "author_meta": self.author_meta()}

    # -- cleaning before segmentation --

    def _rebody(self, picked: list[Node]) -> None:
        for n in picked:
            n.remove()
        self.root = Node("body")
        for n in picked:
            self.root.add(n)
        self._rename()

    def _rename(self) -> None:
        """New xpaths after the tree has changed; numbers stay."""
        pids = {id(n): n.pid for n in self.root.all()}
        address(self.root)
        for n in self.root.all():
            n.pid = pids[id(n)]

    def centroid(self) -> None:
        if self.rule and self.rule.bodies or any(h in self.url for h in ("mp.weixin.qq.com", "mp.weixin.com")):
            return
        body = next((n for n in self.root.all() if n.tag == "body"), None)
        if body is None:
            return
        articles = [n for n in body.below() if n.tag == "article"]
        text = "".join(map(raw_text, articles))
        if articles and share(size(text), size(raw_text(self.root))) > 0.6:
            # An article inside another leaves it, as both become parts of the new body.
            self._rebody(articles)
        else:
            self._rebody([body])

    def by_rule(self, strict: bool = False) -> None:
        if not self.rule:
            return
        for path in self.rule.noises:
            for n in self.find(path):
                n.remove()
        found = [n for path in self.rule.bodies for n in self.find(path)]
        if found:
            self._rebody(list({id(n): n for n in found}.values()))
        if self.rule.body_use_rule_only and self.rule.bodies and (strict or not found):
            raise PageError("no body that the rule names")

    def tiny_noise(self) -> None:
        nodes = sorted(self.root.all(), key=lambda n: n.xpath)
        first = {id(n): n.text or next((c.tail for c in n.children if c.tail), "") for n in nodes}
        held = {id(n) for n in nodes if _PHRASES.search(first[id(n)])}
        nodes = [n for n in nodes if id(n) in held]
        for phrase, most in fixed.TINY_NOISE if nodes else ():
            for n in nodes:
                if phrase in first[id(n)] and self._attached(n) and n is not self.root and len(raw_text(n)) <= most:
                    n.remove()

    def potential_noise(self) -> None:
        for n in sorted(self.root.all(), key=lambda n: n.xpath):
            if not self._attached(n) or n is self.root or not re.search(fixed.NOISE_ATTR, " ".join(k for k in n.attrs if k != "xpath")):
                continue
            for key in ("clsss", "id"):
                value = n.attrs.get(key)
                if not value:
                    continue
                bad = True  # the attribute's name counts against it
                ok = re.search(fixed.OK_CANDIDATE, value) or re.search(fixed.POSITIVE, value)
                if bad and not ok or n.tag not in fixed.UNDELETABLE and share(size(raw_text(n)), size(raw_text(self.root))) < 0.5:
                    n.remove()
                    break

    def noise_images(self) -> None:
        if self.rule:
            return
        for n in [n for n in self.root.all() if n.tag == "img"]:
            text = " ".join(n.attrs.get(k, "") for k in [*fixed.IMAGE_ATTRS, "alt", "class"])
            if re.search(fixed.NEGATIVE_IMG, text):
                n.remove()
            n.children, n.text = [], ""

    def noise_links(self) -> None:
        for n in [n for n in self.root.all() if n.tag == "a"]:
            if self._attached(n) and re.search(fixed.NEGATIVE_LINK, raw_text(n)):
                n.remove()

    def meta_links(self) -> None:
        for n in [n for n in self.root.all() if n.tag in ("link", "script")]:
            n.remove()

    def link_bundles(self) -> None:
        if self.rule and (self.rule.bodies or self.rule.noises):
            return
        seen: set[int] = set()
        for n in [n for n in self.root.all() if n.tag == "a"]:
            if n.parent is None or id(n) in seen or not self._attached(n):
                continue
            seen.add(id(n))
            if bundle := _bundle(n):
                seen |= {id(a) for a in bundle.below() if a.tag == "a"}
                bundle.remove()

    def pre_clean(self, strict: bool = False) -> None:
        self.centroid()
        self.by_rule(strict)
        for step in (self.tiny_noise, self.potential_noise, self.noise_images, self.noise_links, self.meta_links, self.link_bundles):
            step()
            self._rename()

    def empty_tags(self) -> None:
        todo = [self.root]
        while todo:
            n = todo.pop()
            if n.tag in ("img", "svg", "video"):
                continue
            if n is self.root or clean(raw_text(n)) or has_media(n):
                todo += n.children[::-1]
            else:
                n.remove()

    def beyond_canvas(self, sents: list[dict]) -> None:
        if not sents:
            return
        by_pid = {n.pid: n for n in self.root.all()}
        lead = {"O", "author", "article_title", "publish_time", "source"}
        first = next((s["atoms"][0]["position_id"] for s in sents if s["label"] not in lead and s["atoms"]), 0)
        last = next((s["atoms"][-1]["position_id"] for s in reversed(sents) if s["label"] != "O" and s["atoms"]), 0)
        first, last = (top_most(by_pid[p]).pid if p in by_pid else p for p in (first, last))
        if not first + last:
            return
        for n in [n for n in self.root.all() if n.tag in ("svg", "video")]:
            if not first <= (top_most(n).pid or 0) <= (last or 1 << 62):
                n.remove()

    # -- segmentation --

    def atoms(self, title: str = "", segments: dict[str, int] | None = None) -> list[dict]:
        """Text runs of the page in reading order."""
        segments = {} if segments is None else segments
        out: list[dict] = []
        if title:
            path = self.rule.title if self.rule and self.rule.title else "//title"
            out.append(atom(title, 0, path, segment=0))
        page_size = size(raw_text(self.root))
        waiting: list[dict] = []
        shut: tuple[str, ...] = ()
        for n in list(self.root.below()):
            while waiting and not n.xpath.startswith(waiting[-1]["xpath"]):
                out.append(waiting.pop())
            if n.xpath.startswith(shut):
                continue
            special = self._special(n, segments, page_size)
            if special is not None:
                out += special
                shut += (n.xpath,)
            elif n.text.strip():
                out.append(atom(n.text, n.pid, n.xpath, segment=_segment(segments, n.xpath)))
            if n.tail.strip():
                waiting.append(atom(n.tail, n.pid, n.xpath, True, _segment(segments, n.xpath)))
        return out + waiting[::-1]

    def _special(self, n: Node, segments: dict[str, int], page_size: int) -> list[dict] | None:
        """Atoms of an image or table, none for a video, null for other elements."""
        if n.tag in fixed.IMAGE_TAGS:
            if link := next((n.attrs[k] for k in fixed.IMAGE_ATTRS if is_link(n.attrs.get(k, ""))), None):
                return self._image(n, link, segments)
        elif m := re.search(r"url\((.*)\)", _style(n.attrs.get("style", "")).get("background-image", "")):
            if m[1]:
                n.tag, n.children, n.text = "img", [], ""
                n.attrs["src"] = m[1]
                return self._image(n, m[1] if is_link(m[1]) else "", segments)
        if n.tag == "table" and not any(c.tag == "table" for c in n.below()) and not share(size(raw_text(n)), page_size) >= 0.8:
            return [atom("<table " + serialise(n), n.pid, n.xpath, segment=_segment(segments, n.xpath), fixed_text=True)]
        names = n.attrs.get("class", "")
        if n.tag == "video" or any(v in names for v in fixed.VIDEO_CLASS_PARTS) or names in fixed.VIDEO_CLASSES:
            n.tag, n.children, n.text = "video", [], ""
            return []
        return None

    def _image(self, n: Node, link: str, segments: dict[str, int]) -> list[dict]:
        text = n.tag
        if link:
            text = absolute(link, self.url)
            n.attrs = {k: v for k, v in n.attrs.items() if k not in fixed.IMAGE_ATTRS and "http" not in v}
            n.attrs["src"] = text
        return [atom(f"<img {text}", n.pid, n.xpath, segment=_segment(segments, n.xpath), fixed_text=True)]

    def sentences(self, title: str = "") -> list[dict]:
        """Sentences with their atoms; images and tables are sentences of their own."""
        out: list[dict] = []
        group: list[dict] = []

        def flush() -> None:
            out.extend(cut_paragraph(group))
            group.clear()

        for a in self.atoms(title):
            if a["text"].startswith(("<img", "<table")):
                flush()
                out.append(sentence([a]))
                continue
            if group and depth(group[-1]["xpath"]) != depth(a["xpath"]):
                flush()
            group.append(a)
        flush()
        return self._distinct_images(out)

    def _distinct_images(self, sents: list[dict]) -> list[dict]:
        by_pid, kept = {n.pid: n for n in self.root.all()}, []
        for s in sents:
            if kept and s["url"] and kept[-1]["url"] == s["url"]:
                if n := by_pid.get(s["atoms"][0]["position_id"]):
                    n.remove()
            else:
                kept.append(s)
        return kept

    def mark_atoms(self, sents: list[dict]) -> None:
        """Give every text atom an element of its own in the tree."""
        by_pid = {n.pid: n for n in self.root.all()}
        for window in runs([a for s in sents for a in s["atoms"]], lambda a: (a["xpath"], a["tail"])):
            window = [a for a in window if not a["text"].startswith(("<img", "<table")) and "math" not in re.sub(r"\[\d+\]", "", a["xpath"]).split("/")]
            n = by_pid.get(window[0]["position_id"]) if window else None
            if n is None or window[0]["position_id"] == 0:
                continue
            group = Node(VNODE + "pos-group")
            group.pid = self.last_pid = self.last_pid + 1
            tail = window[0]["tail"]
            for a in window:
                node = group.add(Node(VNODE + "pos"))
                node.pid = self.last_pid = self.last_pid + 1
                node.text, a["tail"], a["position_id"] = a["text"], False, node.pid
            if tail and n.parent is not None:
                n.tail = ""
                at = n.parent.children.index(n) + 1
                group.parent = n.parent
                n.parent.children.insert(at, group)
            elif not tail:
                n.text = ""
                group.parent = n
                n.children.insert(0, group)

    # -- formatting --

    def format_nodes(self) -> None:
        """Styles, links and attributes of the reader page."""
        for n in self.root.all():
            if n.attrs.get("style"):
                style = kept_style(n.tag, n.attrs["style"])
                n.attrs = kept_attrs(n.attrs) | {"style": style}
            if n.tag == "a":
                href = n.attrs.get("href", "")
                n.attrs = kept_attrs(n.attrs) | {"href": absolute(href, self.url)}
            elif n.tag in ("div", "section"):
                n.attrs = kept_attrs(n.attrs)
            elif n.tag == "img":
                links = {k: absolute(n.attrs[k], self.url) for k in fixed.IMAGE_ATTRS if n.attrs.get(k)}
                n.attrs = kept_attrs(n.attrs) | links

    def label_nodes(self, sents: list[dict]) -> None:
        """Clear the elements of noise labels and mark those of references."""
        by_pid = {n.pid: n for n in self.root.all()}
        for s in sents:
            for a in s["atoms"]:
                n = by_pid.get(a["position_id"])
                if n is None:
                    continue
                if s["label"] in fixed.CLEARED_LABELS:
                    if n.tag in ("img", "svg", "table"):
                        n.remove()
                    else:
                        n.text = ""
                elif s["label"] in fixed.MARKED_LABELS:
                    n.attrs[MARK + fixed.MARKED_LABELS[s["label"]]] = "1"

    def label_subtrees(self, sents: list[dict]) -> None:
        """Mark the element that holds each run of one subtree label, or gather the run in a new one."""
        by_pid = {n.pid: n for n in self.root.all()}
        for window in label_windows(sents):
            mark, _ = fixed.SUBTREE_LABELS[window[0]["label"]]
            nodes = [by_pid[a["position_id"]] for s in window for a in s["atoms"] if a["position_id"] in by_pid]
            nodes = [n for n in nodes if self._attached(n)]
            if not nodes:
                continue
            holder = nodes[0] if len(nodes) == 1 else self._holder(nodes, 0.97, 1.03)
            if holder is not None:
                top_most(holder).attrs[MARK + mark] = "1"
                continue
            picked = []
            for group in runs([(s["segment_id"], by_pid[a["position_id"]]) for s in window for a in s["atoms"] if a["position_id"] in by_pid], lambda g: g[0]):
                own = [n for _, n in group if self._attached(n)]
                if own:
                    whole = self._holder(own, 0.95, 1.05)
                    picked += [whole] if whole is not None else own
            self._gather(list({id(n): n for n in picked}.values()), mark)

    def _holder(self, nodes: list[Node], low: float, high: float) -> Node | None:
        """The first ancestor of which the nodes' texts are about the whole text, in bytes."""
        bare = lambda t: size(_BLANKS.sub("", t))
        want, n = sum(bare(raw_text(x)) for x in nodes), nodes[0].parent
        while n is not None:
            ratio = share(want, bare(raw_text(n)))
            if low <= ratio <= high:
                return n
            if ratio < 0.9:
                return None
            n = n.parent
        return None

    def _gather(self, nodes: list[Node], mark: str) -> None:
        nodes = [n for n in nodes if n.parent is not None and not any(m is not n and _under(n, m) for m in nodes)]
        if not nodes:
            return
        first = nodes[0]
        box = Node("span", {MARK + mark: "1", "subtree": "1"})
        box.pid = self.last_pid = self.last_pid + 1
        box.parent = first.parent
        first.parent.children.insert(first.parent.children.index(first), box)
        for n in nodes:
            n.remove()
            line = box.add(Node("span", {"style": "display:block"}))
            line.pid = self.last_pid = self.last_pid + 1
            line.add(n)
            for x in n.all():
                if x.tag in ("p", "div", "ul"):
                    x.tag = "span"

    def tier_headings(self) -> None:
        """Number the levels of the headings that there are from 1, without gaps."""
        heads = [n for n in self.root.all() if n.tag in _HEADINGS]
        level = {tag: f"h{i}" for i, tag in enumerate(sorted({n.tag for n in heads}), 1)}
        for n in heads:
            n.tag = level[n.tag]

    def styles(self) -> None:
        """Items of marked introductions flow with their text; sites that need it get a style of their own."""
        for n in self.root.all():
            up = n.parent
            if up is None or up.tag != "li":
                continue
            while up is not None and MARK + "intro" not in up.attrs:
                up = up.parent
            if up is not None:
                n.attrs["style"] = n.attrs.get("style", "") + "; display: contents;"
        for host, style in fixed.SITE_STYLES.items():
            if host in self.url:
                self.root.add(Node("style")).text = style

    def restore(self) -> None:
        """The style and formula elements saved while pruning, back in the head."""
        head = next((n for n in self.root.all() if n.tag == "head"), None)
        if head is None:
            head = Node("head")
            head.parent = self.root
            self.root.children.insert(0, head)
        for n in self.saved:
            head.add(n)

    def title_by_headings(self) -> str:
        """The longest part of the title that a heading repeats, if that is most of it; else the title."""
        title = self.by_xpath("//title").strip()
        found = ""
        for n in self.find(" | ".join(f"//h{i}" for i in range(1, 7))) if title else ():
            part = common_part(title, raw_text(n))
            if size(part) > size(found):
                found = part
        return found if title and share(size(found), size(title)) >= fixed.TITLE_RATIO else title

    def images(self) -> list[str]:
        return [v for n in self.root.all() if n.tag == "img" for k in fixed.IMAGE_ATTRS if (v := n.attrs.get(k, "")).startswith("http")]

    def images_with_pid(self) -> dict[str, str]:
        return {v: str(n.pid) for n in self.root.all() if n.tag == "img" for k in fixed.IMAGE_ATTRS if (v := n.attrs.get(k, "")).startswith("http")}

    def to_html(self, meta: dict | None = None) -> str:
        """The page as HTML with numbered elements, and the metadata in its head."""
        for n in self.root.all():
            if n.pid is not None:
                n.attrs["position_id"] = str(n.pid)
        if meta is not None:
            head = next((n for n in self.root.all() if n.tag == "head"), None)
            if head is None:
                head = Node("head")
                head.parent = self.root
                self.root.children.insert(0, head)
            for n in reversed(meta_nodes(meta)):
                n.parent = head
                head.children.insert(0, n)
        return unescape(serialise(self.root))


def meta_nodes(meta: dict) -> list[Node]:
    title = Node("title")
    title.text = meta["title"]
    pairs = [("name", "description", meta["description"]), ("property", "og:image", meta["surface_image"]), ("name", "publish_time", meta["publish_time"]), ("name", "author", meta["author"])]
    icon = Node("link", {"rel": "icon", "href": meta["site_icon"]})
    metas = [Node("meta", {k: n, "content": v}) for k, n, v in pairs]
    return [metas[0], metas[1], icon, metas[2], metas[3], title]


def common_part(full: str, part: str) -> str:
    """The longest common text of two cleaned texts, read off the first as it was before cleaning."""
    bare = clean(full)
    common = common_bytes(bare.encode(), clean(part).encode()).decode("utf-8", "ignore")
    at = bare.find(common)
    return full[at : at + len(common)]


def _under(n: Node | None, top: Node) -> bool:
    while n is not None:
        if n is top:
            return True
        n = n.parent
    return False


def _segment(segments: dict[str, int], path: str) -> int:
    return segments.setdefault(depth(path), len(segments) + 1)


_DEPTH = re.compile(rf"(.*/({'|'.join(fixed.PARAGRAPH_TAGS)})(\[\d+\])?)(/.*)?\Z", re.S)
_TIMES = [re.compile(p, re.A) for p in fixed.TIME_PATTERNS]
_PHRASES = re.compile("|".join(re.escape(p) for p, _ in fixed.TINY_NOISE))
_AUTHOR = re.compile(
    "(" + "|".join(rf"{k[0]}\s{{0,1}}{k[1]}" if len(k) == 2 else k for k in fixed.AUTHOR_KEYWORDS) + ")\\s*[：|:| |丨|/]\\s*([一-龥a-zA-Z]{2,20})[^一-龥|:|：]*"
)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLANKS = re.compile("[\t\n\f\r \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+")


def depth(path: str) -> str:
    return _DEPTH.sub(r"\1", path)


def tags_of(path: str) -> list[str]:
    return sorted({fixed.GOLD_TAGS[t] for t in re.sub(r"\[\d*\]", "", path).split("/") if t in fixed.GOLD_TAGS})


def is_link(value: str) -> bool:
    return value.startswith(("http", "//", "/", "://", "./", "../"))


def atom(text: str, pid: int, path: str, tail: bool = False, segment: int = 0, fixed_text: bool = False) -> dict:
    return {"text": text, "position_id": pid, "xpath": path, "immutable": fixed_text, "tags": tags_of(path), "tail": tail, "segment_id": segment}


def sentence(atoms: list[dict]) -> dict:
    text = "".join(a["text"] for a in atoms)
    url = text.removeprefix("<img ") if text.startswith("<img ") else ""
    table = text.removeprefix("<table ") if text.startswith("<table ") else ""
    segment = next((a["segment_id"] for a in atoms if a["segment_id"]), 0)
    return {"text": text, "atoms": atoms, "segment_id": segment, "tags": sorted({t for a in atoms for t in a["tags"]}), "url": url, "table_html": table, "label": ""}


def cut_paragraph(atoms: list[dict]) -> list[dict]:
    """Sentences of a paragraph's atoms; an atom that spans several is split."""
    text = "".join(a["text"] for a in atoms)
    out, at, begin = [], 0, 0
    for start, end in sentences.cut(text):
        got = []
        while at < len(atoms) and begin < end:
            a = atoms[at]
            stop = begin_end = begin + len(a["text"])
            if begin_end > end:
                cut = end - begin
                got.append(a | {"text": a["text"][:cut]})
                atoms[at] = a | {"text": a["text"][cut:]}
                begin = end
                break
            got.append(a)
            begin, at = stop, at + 1
        out.append(sentence(got))
    return [s for s in out if s["text"].strip()]


def runs(items: list, key: Callable) -> list[list]:
    """Maximal runs of neighbours with one key."""
    out: list[list] = []
    for x in items:
        if out and key(out[-1][-1]) == key(x):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def label_windows(sents: list[dict]) -> list[list[dict]]:
    """Runs of one subtree label; those of headings end with their segment."""

    def key(s: dict) -> tuple:
        rule = fixed.SUBTREE_LABELS.get(s["label"])
        return (s["label"], s["segment_id"] if rule and rule[1] else None)

    return [r for r in runs(sents, key) if r[0]["label"] in fixed.SUBTREE_LABELS]


def _bundle(link: Node) -> Node | None:
    """The block of links that a link belongs to."""
    count = lambda n: sum(c.tag == "a" for c in n.all())
    n, text, here = count(link), clean(raw_text(link)), link
    for i in range(1, 4):
        up = here.parent
        if up is None:
            return None
        links = [c for c in up.all() if c.tag == "a"]
        whole = clean(raw_text(up))
        if len(links) == n:
            if i >= 2 and n >= 2:
                return up
            if not (size(whole) == size(text) or share(size(text), size(whole)) >= 0.7):
                return None
            text, here = whole, up
        else:
            own = clean("".join(map(raw_text, links)))
            return up if size(own) == size(whole) or share(size(own), size(whole)) >= 0.7 else None
    return None


def denoised_title(title: str) -> str:
    again = True
    while again:
        again = False
        for left, right in fixed.TITLE_PAIRS:
            if len(title) > 1 and title.startswith(left) and title.endswith(right):
                title, again = title[1:-1], True
                break
    front = "".join(re.split(fixed.TITLE_SPLIT, title)[:-1])
    return front if share(size(front), size(title)) > fixed.TITLE_RATIO + 1e-8 else title


def white(color: str) -> bool:
    return color in fixed.WHITE or color.replace(" ", "") in ("rgb(255,255,255)", "rgba(255,255,255,1)")


def dark(color: str) -> bool:
    if "black" in color.lower() or "dark" in color.lower():
        return True
    dim = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b < 128
    if re.search(r"rgba?\(\d+,\s*\d+,\s*\d+\)", color) and dim(*map(int, re.findall(r"\d+", color)[:3])):
        return True
    digits = color.removeprefix("#")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return bool(re.search("#([0-9a-fA-F]{3}){1,2}", color)) and bool(re.fullmatch("[0-9a-fA-F]{6}", digits)) and dim(*(int(digits[i : i + 2], 16) for i in (0, 2, 4)))


def kept_style(tag: str, text: str) -> str:
    names = fixed.STYLE_KEPT + (fixed.STYLE_KEPT_IMAGE if tag in fixed.IMAGE_TAGS else [])
    style = {k: v for k, v in ((k, v.replace("!important", "").strip()) for k, v in _style(text).items()) if k in names and v}
    bg = style.get("background") or style.get("background-color") or ""
    drop = {"width"} if style.get("width") == "100%" else set()
    if bg and (white(bg) or dark(bg)):
        drop |= {"background", "background-color"}
    if white(style.get("color", "")):
        drop.add("color")
    if tag != "ol":
        drop.add("list-style")
    return ";".join(f"{k}: {v}" for k, v in sorted(style.items()) if k not in drop)


def kept_attrs(attrs: dict[str, str]) -> dict[str, str]:
    names = {*fixed.ATTRS_KEPT, *fixed.IMAGE_ATTRS, *fixed.ANCHOR_ATTRS}
    return {k: v for k, v in attrs.items() if k in names or "leaf" in k.lower()}
