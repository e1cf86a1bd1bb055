"""Sentence cutting: word tokens, break marks, and the exceptions that clear them."""

from __future__ import annotations

import re

from leafpress.functions import fixed

_STOPS = tuple(dict.fromkeys(fixed.STOPS_CN + fixed.STOPS_EN))
_MOVED = tuple(fixed.CLOSERS + fixed.STOPS_CN)
_ENDS = set("".join(_STOPS) + "".join(fixed.CLOSERS))
_TIMES = [re.compile(p.replace(":", r"\s*:\s*"), re.A) for p in fixed.TIME_PATTERNS]
_PAIRS = {"（": "）)", "(": ")）", "【": "】", "[": "]", "《": "》", "<": ">", "「": "」", "『": "』", "{": "}"}
#: Abbreviations after which a full stop ends no sentence (an approximation of a trained model).
ABBREVIATIONS = frozenset("sgt gov no mr mrs ms dr prof st vs etc e.g i.e inc ltd co corp jr sr fig vol jan feb mar apr jun jul aug sep sept oct nov dec u.s".split())


def _words(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, newline follows) of words, which end at white space or after a stop or closer."""
    out, start, n = [], None, len(text)
    for i, ch in enumerate(text):
        if ch.isspace():
            if start is not None:
                out.append([start, i, False])
                start = None
            if ch == "\n" and out:
                out[-1][2] = True
        else:
            if start is None:
                start = i
            if ch in _ENDS:
                out.append([start, i + 1, False])
                start = None
    if start is not None:
        out.append([start, n, False])
    return [tuple(w) for w in out]


def _full_stop(word: str, following: str) -> bool:
    """Whether a word that ends like a sentence ends one."""
    core = word.rstrip("\"'”’)）」")
    if not core.endswith((".", "。")) or core.endswith(".."):
        return False
    bare = core.rstrip(".").lower()
    if bare in ABBREVIATIONS or re.fullmatch(r"[a-z]", bare) or not following:
        return False
    return not (following[:1].islower() or following[:1] in ",;")


def cut(text: str) -> list[tuple[int, int]]:
    """(start, end) of contiguous slices of a text, one for each sentence."""
    words = _words(text)
    if not words:
        return [(0, len(text))] if text else []
    tok = [text[a:b] for a, b, _ in words]
    brk = [line or _full_stop(t, tok[i + 1] if i + 1 < len(tok) else "") or t.endswith(("!", "?")) for i, (t, (_, _, line)) in enumerate(zip(tok, words))]
    for i in range(len(tok) - 1):
        a, b = tok[i], tok[i + 1]
        if a.endswith(("https:", "http:")) and b.startswith("//"):
            brk[i] = False
            continue
        if a.endswith(".") and b == ".":
            brk[i] = False
            continue
        if a.endswith(_STOPS):
            brk[i] = True
        if b.endswith(_STOPS):
            brk[i + 1] = True
        if brk[i] and b.startswith(_MOVED):
            brk[i], brk[i + 1] = False, True
    joined, places, at = " ".join(tok) + " ", [], 0
    for t in tok:
        places.append((at, at + len(t) + 1))
        at += len(t) + 1
    for pattern in _TIMES:
        if m := pattern.search(joined):
            inside = [i for i, (s, e) in enumerate(places) if s < m.end() and e > m.start()]
            for i in inside[:-1]:
                brk[i] = False
            break
    opened: list[str] = []
    for i, t in enumerate(tok):
        for ch in t:
            if ch in _PAIRS:
                opened.append(ch)
            elif opened and ch in _PAIRS[opened[-1]]:
                opened.pop()
        if opened:
            brk[i] = False
    out, start = [], 0
    for i, (_, end, _) in enumerate(words):
        if brk[i] and i + 1 < len(words):
            out.append((start, end))
            start = end
    out.append((start, len(text)))
    return out
