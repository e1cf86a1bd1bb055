import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Documents' columns, and extra ones whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, size string, `key` string, spans string, copies double"


def make_docs(seed=3, n=40):
    """Random prose with copies, near copies, shared passages, secrets, repeats and junk."""
    r = random.Random(seed)
    vocab = ["w" + "".join(r.choices("abcdeö", k=r.randint(1, 6))) for _ in range(300)]
    line = lambda k: " ".join(r.choices(vocab, k=k))
    passage = line(60)
    texts = [line(r.randint(1, 150)) for _ in range(n)]
    texts[3] = texts[2]
    words = texts[4] = line(120)
    texts[5] = words.replace(words.split()[50], "changed", 1)
    texts[6], texts[7] = line(10) + " " + passage + "\n" + line(5), passage + " " + line(30)
    texts[8] = "\n".join([line(8)] * 5)
    texts[9] = "a b c d e f " * 60
    texts[10] = 'say token = "' + "0123456789abcdef" * 2 + '"; AKIA' + "Q1" * 10 + " password: short1 secret=abc"
    texts[11] = "ÀÉ ☃ " * 40 + "PASSWORD='hunter22'\tapi_key:ZZtop99x"
    texts[12], texts[13] = "", "   \n\t "
    texts[14] = "two words"
    texts[15] = "x" * 700 + " " + "x" * 700
    return texts


def rows_of(texts):
    sources = ["b", "a", None, "c"]
    return [(i, t, "en", sources[i % 4] if i % 3 else "hot", len(t or ""), 1, "s", "k", "sp", 2.0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Distinct ids, all kinds of texts, one of them null and one long."""
    rows = rows_of(texts)
    rows.append((100, None, None, None, None, None, None, None, None, None))
    rows.append((101, " ".join(f"v{i % 977}" for i in range(30_000)), "en", "b", 0, 1, "s", "k", "sp", 2.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Null ids, repeated rows, and one id with two texts."""
    rows = rows_of(texts[:12])
    rows += [rows[1], rows[1], (1, "another text of the same id " * 6, "en", "a", 0, 1, "s", "k", "sp", 2.0), (None, texts[2], "en", "a", 0, 1, "s", "k", "sp", 2.0), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
