"""Exact repeated-substring removal over bytes, with logarithmic index families.

Each block of documents is a batch. Its suffixes are indexed sparsely: where the
hash of the next 64 bytes is the least of 137 in a row, so that equal 200-byte
strings always share an indexed suffix at the same place. A bucket keeps a family
of suffix arrays, ordered by the suffixes' bytes; a new batch is sorted, merge-
scanned against every level for suffixes that match 64 bytes long, and levels of
like size merge, so each suffix is merged a logarithmic number of times. Suffixes
that occur elsewhere are then extended, to whole phrases around them (a run of
windows that share a suffix) and, where phrases of one suffix differ, to single
200-byte windows, both compared by 64-bit hash: two unlike strings are taken for
equal with odds of one in 2^64.

Defined cases: a null text is empty; matches never cross documents; repeated rows
and repeated ids are documents of their own, so equal rows of 200 bytes or more
remove each other; texts under 200 bytes stay whole; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafpress.llm import rounds
from leafpress.llm import textnum as tn

LENGTH, SUFFIX = 200, 64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,length:int>>"


class Part:
    """A slice of a block: hashes of its windows, and runs of windows with one least suffix."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, length: int):
        self.raw, self.off, self.length = raw, off, length
        n = max(0, len(raw) - length + 1)
        self.grams = np.maximum(tn.byte_windows(raw, SUFFIX), np.uint64(1))  # 0 marks windows without one
        self.whole = tn.window_hash(self.grams, length, SUFFIX)
        if not n:
            self.least = np.zeros(0, np.uint64)
            self.first = self.last = np.zeros(0, np.int64)
            self.value, self.split = np.zeros(0, np.uint64), np.zeros(0, dtype=bool)
            return
        self.least = rounds.sliding_min(self.grams, length - SUFFIX + 1)
        for end in off[1:-1]:  # windows that would leave their document
            self.least[max(0, end - length + 1) : end] = 0
        edge = np.flatnonzero(self.least[1:] != self.least[:-1]) + 1
        first, last = np.concatenate([[0], edge]), np.append(edge, n)  # after the run's last window
        some = self.least[first] > 0
        first, last = first[some], last[some]
        # Runs longer than one suffix can serve (periodic texts) are cut, so that
        # their first and last windows cover them.
        most = length - SUFFIX + 1
        times = -(-(last - first) // most)
        of = np.repeat(np.arange(len(first)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        self.first = first[of] + nth * most
        self.last = np.minimum(self.first + most, last[of])
        # Least hashes lie near zero; mixed again, they spread over the buckets.
        self.value, self.split = tn.mix64(self.least[self.first]), (times > 1)[of]

    def suffixes(self) -> np.ndarray:
        """Places of indexed suffixes: those that are the least of some window."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        width = self.length - SUFFIX
        padded = np.concatenate([np.zeros(width, np.uint64), self.least, np.zeros(width, np.uint64)])
        np.invert(padded, out=padded)
        over = rounds.sliding_min(padded, width + 1)
        np.invert(over, out=over)
        return np.flatnonzero(self.grams == over[: len(self.grams)])

    def texts(self, places: np.ndarray) -> np.ndarray:
        """The bytes of suffixes, as far as they are compared."""
        return self.raw[places[:, None] + np.arange(SUFFIX)].reshape(-1).view(f"S{SUFFIX}")


class Runs:
    """Runs of windows in a part: first, last (exclusive) and least suffix of each."""

    def __init__(self, part: Part, some: np.ndarray):
        self.part, self.first, self.last, self.value, self.split = part, part.first[some], part.last[some], part.value[some], part.split[some]

    def hulls(self) -> np.ndarray:
        """Hashes of the phrases: all bytes that a run's windows cover, by its first and last window."""
        ends = tn.join2(self.part.whole[self.first], self.part.whole[self.last - 1])
        return tn.join2(ends, (self.last - self.first).astype(np.uint64))

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of some runs."""
        first, sizes = self.first[some], (self.last - self.first)[some]
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        places = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return places, self.part.whole[places]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mask of the values that a sorted array has."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Block:
    """A block's documents and what the rounds so far have told about them."""

    def __init__(self, table: pa.Table, length: int):
        self.table, self.length = rounds.ordered(table), length

    def parts(self) -> Iterator[Part]:
        for _, raw, off in tn.slices(self.table, self.table.schema.get_field_index("text")):
            yield Part(raw, off, self.length)

    def suffixes(self) -> np.ndarray:
        """Hashes of all indexed suffixes."""
        return _joined([tn.mix64(p.grams[p.suffixes()]) for p in self.parts()])

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct indexed suffixes, their bytes, and which occur twice."""
        hashes, texts = [], []
        for part in self.parts():
            at = part.suffixes()
            hashes.append(tn.mix64(part.grams[at]))
            texts.append(part.texts(at))
        own, first, n = np.unique(_joined(hashes), return_index=True, return_counts=True)
        return own, (np.concatenate(texts) if texts else np.zeros(0, f"S{SUFFIX}"))[first], n > 1

    def runs(self, replies: pa.Table, buckets: int) -> list[Runs]:
        """Runs whose suffix is repeated, by part."""
        parts, known = [], []
        for part in self.parts():
            known.append(np.unique(part.value))  # every run's least suffix is an indexed one
            part.grams = part.least = None
            parts.append(part)
        distinct = np.unique(_joined(known))
        wanted = distinct[rounds.answered(replies, 1, distinct, buckets)]
        return [Runs(p, _among(p.value, wanted)) for p in parts]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: bytes, removed bytes, removed spans, hash of the rest."""
    blocks, deal = rounds.dealt(docs)
    buckets = deal.buckets

    def suffixes(table: pa.Table) -> pa.Table:
        own, texts, twice = Block(table, length).index()
        return rounds.questions(table["block"][0].as_py(), own, buckets, twice, send=texts)

    def phrases(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Ask which phrases are repeated, and which suffixes have several phrases."""
        if not table.num_rows:
            return rounds._ASK.empty_table()
        block, whole_block = table["block"][0].as_py(), Block(table, length)
        runs = whole_block.runs(replies, buckets)
        hulls, values = _joined([r.hulls() for r in runs]), _joined([r.value for r in runs])
        split = np.concatenate([r.split for r in runs]) if runs else np.zeros(0, dtype=bool)
        whole, _ = rounds.ask_repeats(block, hulls, buckets)
        if not len(values):
            return whole
        order = np.argsort(values, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
        least, most = np.minimum.reduceat(hulls[order], at), np.maximum.reduceat(hulls[order], at)
        # A run with its suffix at several places may hold equal windows itself.
        suffix, n = np.unique(whole_block.suffixes(), return_counts=True)
        inner = n[np.searchsorted(suffix, values[order][at])] > np.diff(np.append(at, len(values)))
        inner |= np.logical_or.reduceat(split[order], at)
        kinds = rounds.questions(block, values[order][at], buckets, inner | (least != most), least)
        shifted = pa.array(kinds["bucket"].to_numpy() + buckets)
        return pa.concat_tables([whole, kinds.set_column(1, kinds.schema.field("bucket"), shifted)])

    def compare(asked: pa.Table) -> pa.Table:
        if asked["bucket"][0].as_py() < buckets:
            return rounds.repeats(asked, 2, firsts=3)
        out = rounds.repeats(asked, 4, valued=True)
        return out.set_column(1, out.schema.field("bucket"), pa.array(out["bucket"].to_numpy() - buckets))

    def told(table: pa.Table, replies: pa.Table) -> list[tuple[Runs, np.ndarray, np.ndarray, np.ndarray]]:
        """By part: runs, those repeated as a whole, those to be compared window by
        window, and those that speak for their phrase."""
        runs = Block(table, length).runs(replies, buckets)
        hulls, values = [r.hulls() for r in runs], [r.value for r in runs]
        phrase, first = np.unique(_joined(hulls), return_index=True)
        suffix = np.unique(_joined(values))
        whole = phrase[rounds.answered(replies, 2, phrase, buckets)]
        speaks = np.zeros(sum(map(len, hulls)), dtype=bool)
        speaks[first[rounds.answered(replies, 3, phrase, buckets)]] = True
        several = suffix[rounds.answered(replies, 4, suffix, buckets)]
        ends = np.cumsum([len(h) for h in hulls])[:-1]
        return [(r, _among(h, whole), _among(v, several), s) for r, h, v, s in zip(runs, hulls, values, np.split(speaks, ends))]

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Ask about the windows of phrases with a rival, once for each phrase."""
        if not table.num_rows:
            return rounds._ASK.empty_table()
        keys, known = [], []
        for run, whole, rivals, speaks in told(table, replies):
            for mask, mark in ((rivals & speaks & whole, True), (rivals & ~whole, False)):
                key = run.windows(mask)[1]
                keys.append(key)
                known.append(np.full(len(key), mark))
        keys, known = _joined(keys), np.concatenate(known) if known else np.zeros(0, dtype=bool)
        if not len(keys):
            return rounds._ASK.empty_table()
        distinct, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        marks = n > 1
        marks[at[known]] = True
        return rounds.questions(table["block"][0].as_py(), distinct, buckets, marks)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = rounds.ordered(table)
        parts = told(table, replies)
        # The windows asked about, as in the round before.
        asked = [(run, run.windows(rivals & speaks & whole)[1], run.windows(rivals & ~whole)) for run, whole, rivals, speaks in parts]
        distinct = np.unique(_joined([k for _, a, (_, b) in asked for k in (a, b)]))
        again = distinct[rounds.answered(replies, 5, distinct, buckets)]
        out: list[list] = [[], [], [], [], []]
        for (run, whole, _, _), (_, _, (places, keys)) in zip(parts, asked):
            steps = np.zeros(len(run.part.raw) + 1, dtype=np.int32)
            np.add.at(steps, run.first[whole], 1)
            np.add.at(steps, run.last[whole] - 1 + length, -1)
            hit = places[_among(keys, again)]
            steps[hit] += 1
            steps[hit + length] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            off = run.part.off
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                m = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8)))
                spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                kept = run.part.raw[a:b][~m] if len(spans) else run.part.raw[a:b]
                for col, v in zip(out, (b - a, int(m.sum()), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans)):
                    col.append(v)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        return pa.table([block["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    first = rounds.reply_round(deal, rounds.first_round(blocks, suffixes), lambda t: rounds.repeats(t, 1, kind=f"S{SUFFIX}"))
    second = rounds.reply_round(deal, rounds.next_round(blocks, first, phrases, rounds.ASK), compare)
    third = rounds.reply_round(deal, rounds.next_round(blocks, first.unionByName(second), windows, rounds.ASK), lambda t: rounds.repeats(t, 5))
    return rounds.next_round(blocks, first.unionByName(second).unionByName(third), finish, SCHEMA)
