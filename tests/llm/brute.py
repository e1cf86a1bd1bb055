"""Brute-force versions of the operators' fixed results, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    ws = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    n, r = len(ws), len(hit)
    return (n, sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, r, n < 10 or 100 * r > 20 * n)


def secrets(text):
    text = text or ""
    found = []
    for rank, (kind, pattern, group, least) in enumerate((
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    )):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    found.sort()
    n = Counter(k for _, _, k, _ in found)
    spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(spans.encode()).hexdigest()


def dedup_words(docs, k=20):
    """doc -> (words, removed, sha256 of the kept) for (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        ws, drop = words(text), set()
        for i in range(len(ws) - k + 1):
            w = tuple(ws[i : i + k])
            if w in seen:
                drop.update(range(i, i + k))
            seen.add(w)
        kept = [w for i, w in enumerate(ws) if i not in drop]
        out[doc] = (len(ws), len(drop), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def dedup_bytes(docs, k=200):
    """doc -> (bytes, removed, spans, sha256 of the kept)."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    n = Counter(b[i : i + k] for _, b in raw for i in range(len(b) - k + 1))
    out = {}
    for d, b in raw:
        drop = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if n[b[i : i + k]] > 1:
                drop[i : i + k] = b"\1" * k
        kept = bytes(x for x, m in zip(b, drop) if not m)
        spans = sum(1 for i, m in enumerate(drop) if m and not (i and drop[i - 1]))
        out[d] = (len(b), sum(drop), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    ws = words(text)
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def jaccard_groups(docs, least=0.8):
    """doc -> (smallest doc of its group, number of linked documents)."""
    sets = {d: shingles(t) for d, t in docs}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    links = defaultdict(set)
    for d, s in sets.items():
        for e in set().union(*(where[x] for x in s)) if s else ():
            if e > d:
                both = len(s & sets[e])
                if both >= least * (len(s) + len(sets[e]) - both) - 1e-9:
                    links[d].add(e)
                    links[e].add(d)
    group = {}
    for d in sorted(sets):
        if d not in group:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = d
                    todo += links[x]
    return {d: (group[d], len(links[d])) for d in sets}


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target for source -> size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else left * w[s] / open_ for s in names}
        more = {s for s in names if s not in full and share[s] > most * sizes[s]}
        if not more:
            return share
        full |= more


def crc(text):
    return zlib.crc32((text or "").encode())
