"""Which key-like strings are examples: those widely copied by texts and by owners."""

from leafpress.llm import secrets

COLUMNS = "doc_id long, text string, source string"
KEYS = {n: n + "x9aB" * 6 for n in ("Two", "Copied", "Hot", "Wide", "Null")}


def rows():
    texts = []
    texts += [(f"two {i} {KEYS['Two']} end", "ab"[i]) for i in range(2)]
    texts += [(f"same {KEYS['Copied']} end", "abcde"[i]) for i in range(5)]  # copies of one text
    texts += [(f"hot {i} {KEYS['Hot']} end", "a") for i in range(20)]
    texts += [(f"wide {i} {KEYS['Wide']} end", "abcd"[i % 4]) for i in range(8)]
    texts += [(f"null {i} {KEYS['Null']} end", ["a", "b", None][i % 3]) for i in range(6)]
    texts += [(f"nothing {i}", "abcde"[i % 5]) for i in range(20)] + [(None, None)]
    return [(i, *t) for i, t in enumerate(texts)]


def test_examples_are_copied_widely_by_both_counts(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for d, text, _ in rows():
        name = next((n for n, k in KEYS.items() if k in (text or "")), None)
        live = name in ("Two", "Copied", "Hot")
        at = text.index(KEYS[name]) if live else None
        assert spans[d] == (f"live:{at}:{at + len(KEYS[name])}" if live else ""), text
        assert masked[d] == (text.replace(KEYS[name], "[secret]") if live else text)


def test_bounds_grow_with_the_corpus():
    assert secrets.needed(2, 3) == (0.2, 3)
    assert secrets.needed(10_000, 20) == (13, 3)
    assert secrets.needed(1_000_000, 50_000) == (1003, 50)
