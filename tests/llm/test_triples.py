"""The language model against a plain version, and search inside coded levels."""

import math
import re
import zlib
from collections import Counter

import brute
import numpy as np

from leafpress.llm import language_model as lm
from leafpress.llm import rounds


def test_search_in_coded_levels():
    r = np.random.default_rng(5)
    for n, top in [(1, 1), (5, 9), (3000, 4000), (3000, 10**9), (1000, 1000)]:
        values = np.sort(r.choice(top, n, replace=False)).astype(np.int64)
        code = lm.EliasFano(values)
        some = np.concatenate([values, values + 1, values - 1])
        place = {v: k for k, v in enumerate(values.tolist())}
        assert (code.get(np.arange(n)) == values).all()
        assert code.find(some).tolist() == [place.get(v, -1) for v in some.tolist()]


def test_successors_of_contexts():
    r = np.random.default_rng(2)
    pairs = np.unique(r.integers(0, 50, (400, 2)), axis=0)
    p = -r.random(len(pairs)) * 5
    level = lm.Level(50, pairs[:, 0], pairs[:, 1], lm.quantise(p))
    known = {tuple(k): i for i, k in enumerate(pairs.tolist())}
    c, w = np.divmod(np.arange(2500), 50)
    at = level.find(c, w)
    assert at.tolist() == [known.get(k, -1) for k in zip(c.tolist(), w.tolist())]
    assert np.abs(np.log10(lm.probability(level.codes[at[at >= 0]])) - p).max() < 1 / lm.STEPS


def test_counts_are_exact():
    counts = np.array([0, 1, 128, 129, 254, 255, 256, 70_000, 1 << 40])
    assert (lm.decode_counts(b"xx" + lm.code_counts(counts), len(counts), 2) == counts).all()


def plain_scores(rows, order):
    """doc -> score, by counting in dictionaries."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = {d: ["<begin>", *brute.words(low(t)), "<end>"] for d, t in rows}
    train = [x for d, x in texts.items() if zlib.crc32(str(d).encode()) % 10]
    grams = Counter(tuple(x[i : i + k]) for x in train for k in range(1, order + 1) for i in range(len(x) - k + 1))
    begins = grams.pop(("<begin>",), 0)
    words = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    discount = min(max(once / max(1, once + 2 * twice) if once else 0.5, 0.1), 0.9)

    def p(context, w):
        if not context:
            return (words[w] - discount) / n if w in words else discount * v / n
        seen = begins if context == ("<begin>",) else grams[context]
        if seen < (1 if len(context) == 1 else 2):
            return p(context[1:], w)
        c = grams[(*context, w)]
        types = lm.TYPES * math.sqrt(seen)
        return ((c if len(context) == 1 or c > 1 else 0) + types * p(context[1:], w)) / (seen + types)

    return {d: sum(math.log10(p(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(1, len(x))) for d, x in texts.items()}


def test_scores_equal_plain_ones(spark, pairs, docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm, "PART", 10)
    monkeypatch.setattr(rounds, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(lm, "FEW", 5)
    rows = [(d + 200 * k, t) for k in range(3) for d, t in pairs] + [(900 + i, f"A b c d{i % 3} e f. {'the end ' * (i % 4)}") for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, lm.ORDER, 4):
        got = {r["doc_id"]: r for r in lm.score(table, order=order).collect()}
        want = plain_scores(rows, order)
        assert set(got) == set(want)
        for d, s in want.items():
            assert abs(got[d]["score"] - s) <= got[d]["n_tokens"] / lm.STEPS, (order, d)


def test_the_word_before_the_last_counts(spark):
    """Pairs (m, x) and (m, y) come equally often; only the word before m tells them apart."""
    rows = [(i, ("a m x", "b m y")[i % 2]) for i in range(400)]
    rows += [(d, "a m y") for d in range(2000, 2200) if zlib.crc32(str(d).encode()) % 10 == 0]  # held out
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    usual = min(got[d] for d in range(400))
    assert len(rows) > 400 and all(got[d] < usual - 0.1 for d, _ in rows[400:])
