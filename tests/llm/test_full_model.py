"""The query's language model holds every n-gram up to its order, those that occur once, too."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import pytest

from leafpress.llm import language_model as lm
from leafpress.llm import queries, rounds


def full_scores(rows, order):
    """doc -> score, by counting all n-grams in dictionaries."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = {d: ["<begin>", *brute.words(low(t)), "<end>"] for d, t in rows}
    train = [x for d, x in texts.items() if zlib.crc32(str(d).encode()) % 10]
    grams = Counter(tuple(x[i : i + k]) for x in train for k in range(1, order + 1) for i in range(len(x) - k + 1))
    words = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != ("<begin>",)}
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    discount = min(max(once / max(1, once + 2 * twice) if once else 0.5, 0.1), 0.9)

    def p(context, w):
        if not context:
            return (words[w] - discount) / n if w in words else discount * v / n
        seen = grams[context]
        types = lm.TYPES * math.sqrt(seen)
        return (grams[(*context, w)] + types * p(context[1:], w)) / (seen + types) if seen else p(context[1:], w)

    return {d: sum(math.log10(p(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(1, len(x))) for d, x in texts.items()}


@pytest.mark.parametrize("block", [3_000, 60_000])
def test_scores_hold_all_ngrams(spark, tmp_path, monkeypatch, block):
    """Held-out texts share words, pairs and longer runs that occur once with training texts in other blocks."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "PART", 10)
    monkeypatch.setattr(rounds, "BUCKET_BYTES", 10_000)
    r = random.Random(3)
    rows = []
    for i in range(300):
        words = [r.choice(["the", "of", "A", f"w{r.randrange(60)}", f"v{r.randrange(3000)}"]) for _ in range(r.randrange(40))]
        if i and r.random() < 0.4:  # a part of an earlier text
            other = rows[r.randrange(len(rows))][1].split()
            at = r.randrange(len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[at : at + r.randrange(2, 30)]
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op5_elias_fano_scores(spark, str(tmp_path)).collect()}
    want = full_scores(rows, 4)
    assert set(got) == set(want)
    for d, s in want.items():
        assert abs(got[d]["score"] - s) <= got[d]["n_tokens"] / lm.STEPS, d
