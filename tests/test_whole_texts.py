"""Queries over whole texts: what stands after the first characters or words counts too."""

import re

import pytest

import __spark_entry__ as entry


@pytest.fixture
def whole(spark, tmp_path):
    """Rows of a query over given texts, by doc_id."""

    def run(name, texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        rows = entry.queries()[name](spark, str(tmp_path)).collect()
        return {r["doc_id"]: r[1] for r in rows}

    return run


def test_sentences_of_whole_texts(whole):
    one = "A stop ends this. "
    texts = [one * 400, "（开。合）完。" + "字。" * 1500, "x " * 1500 + "Yes! No? Go on", "see http://a.b/c . Then go.\n" * 100, "", " \n ", None]
    assert whole("sentences_stop_sign", texts) == {0: 400, 1: 1501, 2: 3, 3: 100 * 2, 4: 0, 5: 0, 6: 0}


def test_links_of_whole_texts(whole):
    texts = ["and an land " * 100, "x" * 5000 + "and", "", "aand ann", None]
    marked = [t and t + " <the> and" if t is not None else None for t in texts]
    marked[2] = " <the> and"
    want = {i: t and re.sub("and|an", lambda m: {"and": "an", "an": "B"}[m[0]], t) for i, t in enumerate(marked)}
    assert whole("replace_links", texts) == want


def test_distinct_words_of_whole_texts(whole):
    texts = [" ".join(f"w{i % 997}" for i in range(20_000)), "a b a  c\nd a c\nd", "", " ", "x", None]
    want = {i: t if t is None else " ".join(dict.fromkeys(t.split(" "))) for i, t in enumerate(texts)}
    assert whole("dedup_ordered", texts) == want
