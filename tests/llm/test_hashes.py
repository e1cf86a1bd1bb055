"""Hashes tell structured texts apart, and the operators that compare by them do, too."""

import brute
import numpy as np

from leafpress.llm import quality, rounds, substrings, suffixes
from leafpress.llm import textnum as tn

THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_and_windows():
    text = f"{THUE} {MORSE} a ab abcdefgh abcdefghi abcdefg\0 abcdefg {'x' * 300} {'x' * 301}"
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = tn.word_spans(raw, np.array([0, len(raw)]))
    hashes = tn.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len(text.split(" ")) == len(hashes)
    for k in (64, 200):
        one = raw[: 2 * len(THUE)]
        want = [bytes(one[i : i + k]) for i in range(len(one) - k + 1)]
        got = tn.byte_windows(one, k).tolist()
        assert len(got) == len(want) and len(set(got)) == len(set(want)) == len(set(zip(got, want)))
    assert len(tn.byte_windows(raw[:5], 8)) == len(tn.window_hash(hashes[:3], 4)) == 0


def test_thue_morse_texts(spark, monkeypatch):
    monkeypatch.setattr(rounds, "BLOCK_BYTES", 3000)
    rows = [(1, f"{THUE}\n{MORSE}\n{THUE}"), (2, MORSE * 2), (3, " ".join(THUE)), (4, " ".join(MORSE)), (5, "\0" * 500 + "a"), (6, "\0" * 199 + "b" + "\0" * 63)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    base = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(base[d]["n_dup_lines"] == brute.base_counts(t)[3] for d, t in rows) and base[1]["n_dup_lines"] == 1
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(docs).collect()}
    assert got == brute.dedup_words(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(docs).collect()}
    assert got == brute.dedup_bytes(rows)
