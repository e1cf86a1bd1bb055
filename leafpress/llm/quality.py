"""Quality rules: counts with fixed limits, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word 1- and 2-grams and
character 4-grams, each family as relative frequencies. It is trained in one
task on a bounded sample of labelled documents (``SAMPLE`` rows, those with the
smallest hashed ids), four fifths for the weights and one fifth for Platt's
calibration. All documents are scored in Arrow batches against fixed thresholds.

Defined cases: a null text has no words and fails the base rules; a label row
without a document or with a null quality is not used; with labels of one class
only, or none, every document that passes the base rules is kept; repeated rows
are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm import textnum as tn

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 4000
#: Features of each family.
WIDTH = 1 << 16
EPOCHS, RATE = 4, 0.6
#: Documents with a calibrated probability of good quality under this are rejected.
LEAST_GOOD = 0.1
MIN_WORDS, MOST_REPEAT_PERCENT = 10, 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("good", pa.float64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good double"


def base_counts(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, doc: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text in a slice."""
    n = len(off) - 1
    out = {"n_words": np.bincount(doc, minlength=n), "n_symbols": tn.counts(_SYMBOL[raw], off)}
    solid = ~tn.SEPARATOR[raw]
    out["word_chars"] = tn.counts(solid & ((raw & 0xC0) != 0x80), off)
    # Lines: every text starts one, and every newline starts another.
    line = np.union1d(off[:-1][off[:-1] < off[1:]], np.flatnonzero(raw == 10) + 1)
    line = line[line < len(raw)]
    if len(line):
        of = np.searchsorted(off, line, side="right") - 1
        end = np.minimum(np.append(line[1:], len(raw)), off[of + 1])
        end -= (raw[end - 1] == 10) & (end > line)
        full = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(solid, out=full[1:])
        some = full[end] > full[line]
        key = tn.mix64(tn.word_hashes(raw, line[some], end[some]) + of[some].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        out["n_dup_lines"] = np.bincount(of[some][tn.later(key)], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, dtype=np.int64)
    window = tn.window_hash(words, 5)
    if len(window):
        inside = doc[: len(window)] == doc[4:]
        key = tn.mix64(window + doc[: len(window)].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        at = np.flatnonzero(inside)
        marks = np.zeros(len(window), dtype=bool)
        marks[at[tn.repeated(key[at])]] = True
        out["n_repeat_words"] = np.bincount(doc[tn.covered(marks, 5, len(words))], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, dtype=np.int64)
    return out


def features(raw: np.ndarray, off: np.ndarray, doc: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, the features of all texts in text order, and each text's offsets."""
    n = len(off) - 1
    top = np.uint64(64 - 16)
    ends = np.searchsorted(doc, np.arange(n + 1))
    out = [((words >> top).astype(np.int32), ends)]
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    out.append(((tn.window_hash(words, 2)[pair] >> top).astype(np.int32) + WIDTH, np.searchsorted(doc[pair], np.arange(n + 1))))
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    chars = np.concatenate([[0], np.cumsum(tn.counts(lead, off))])
    if len(points) != chars[-1]:  # not well-formed UTF-8: bytes stand for characters
        points, chars = raw.astype(np.uint32), off
    gram = np.zeros(max(0, len(points) - 3), dtype=np.uint32)
    for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
        gram += points[k : k + len(gram)] * np.uint32(m)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x2C1B3C6D)
    of = np.repeat(np.arange(n), np.diff(chars))
    same = np.flatnonzero(of[3:] == of[: len(gram)]) if len(gram) else np.zeros(0, dtype=np.int64)
    out.append(((gram[same] >> np.uint32(16)).astype(np.int32) + 2 * WIDTH, np.searchsorted(of[same], np.arange(n + 1))))
    return out


def _parts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = tn.word_spans(raw, off)
    return starts, doc, tn.word_hashes(raw, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray | None:
    """Weights, bias and Platt's two numbers from (features, values, label) rows."""
    part = [(i % 5 == 4) for i in range(len(rows))]
    train, held = [r for r, h in zip(rows, part) if not h], [r for r, h in zip(rows, part) if h]
    if len({y for *_, y in train}) < 2:
        return None
    w, g, bias, gb = np.zeros(3 * WIDTH), np.full(3 * WIDTH, 1e-8), 0.0, 1e-8
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            at, v, y = train[i]
            d = _sigmoid(bias + w[at] @ v) - y
            step = d * v
            g[at] += step * step
            w[at] -= RATE * step / np.sqrt(g[at])
            gb += d * d
            bias -= RATE * d / np.sqrt(gb)
    a, b = 1.0, 0.0
    if len({y for *_, y in held}) == 2:
        z = np.array([bias + w[at] @ v for at, v, _ in held])
        good = np.array([y for *_, y in held])
        target = np.where(good == 1, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
        for _ in range(50):  # Newton's method on two numbers
            p = _sigmoid(a * z + b)
            r, h = p - target, p * (1 - p)
            grad = np.array([r @ z + 1e-3 * (a - 1), r.sum()])
            hess = np.array([[h @ (z * z) + 1e-3, h @ z], [h @ z, h.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        a = max(a, 1e-3)
    return np.concatenate([w, [bias, a, b]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The classifier, fitted in one task on at most ``sample`` labelled rows."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna().filter("_good in (0, 1)")
    chosen = labels.orderBy(F.xxhash64("_id"), "_id", "_good").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_good")  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for part, raw, off in tn.slices(batch, 1):
                _, doc, words = _parts(raw, off)
                families = features(raw, off, doc, words)
                for i, (key, y) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    at, v = [], []
                    for f, ends in families:
                        if ends[i] < ends[i + 1]:
                            u, c = np.unique(f[ends[i] : ends[i + 1]], return_counts=True)
                            at.append(u)
                            v.append(c / c.sum())
                    if at:
                        got.append((key, (np.concatenate(at), np.concatenate(v), y)))
        got.sort(key=lambda r: (hash(r[0] * 0x9E3779B97F4A7C15 % (1 << 61)), r[0], r[1][2], len(r[1][0])))
        model = fit([r for _, r in got])
        yield pa.RecordBatch.from_arrays([pa.array([None if model is None else model.astype("<f8").tobytes()], pa.binary())], ["model"])

    models = [r["model"] for r in rows.repartition(1).mapInArrow(run, "model binary").collect() if r["model"] is not None]
    return np.frombuffer(models[0], dtype="<f8") if models else None


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_good: float = LEAST_GOOD, carry: bool = False) -> DataFrame:
    """One row per document with counts, verdicts and probability; ``carry``: the kept documents themselves."""
    model = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 * WIDTH numbers
    names = docs.columns

    def score(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        starts, doc, words = _parts(raw, off)
        out = base_counts(raw, off, starts, doc, words)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * out["n_words"])
        w = shared.value
        if w is None:
            out["good"] = np.ones(len(off) - 1)
        else:
            z = np.full(len(off) - 1, w[-3])
            for f, ends in features(raw, off, doc, words):
                sums = np.zeros(len(f) + 1)
                np.cumsum(w[f], out=sums[1:])
                z += (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(np.diff(ends), 1)
            out["good"] = _sigmoid(w[-2] * z + w[-1])
        out["kept"] = ~out["base_failed"] & (out["good"] >= least_good)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = names.index("text") if carry else 1
        for batch in batches:
            for part, raw, off in tn.slices(batch, text):
                out = score(raw, off)
                if carry:
                    yield part.filter(pa.array(out["kept"]))
                else:
                    out["doc_id"] = part.column(0)
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], t) if n != "doc_id" else part.column(0) for n, t in FIELDS], [n for n, _ in FIELDS])

    if carry:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
