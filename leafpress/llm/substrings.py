"""Substring dedup by relative Lempel-Ziv factors over words.

Blocks of documents are references for each other. A block's index is a sample
of its word 5-grams, the minimum of every 16 in a row, so that equal 20-word
windows always share a sampled anchor. Windows whose anchor occurs elsewhere are
compared by hash with those of all other blocks; consecutive windows with an
earlier source form factors, and factors of 20 words or more are duplicate
spans. As every candidate window is compared, no match is missed where two
factors meet.

Defined cases: a null text has no words; null ids come last; rows that repeat an
id are ordered by their text's checksum, and of equal rows the first is the
source of the others; an empty table gives an empty table; a text of any length
is one document of its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafpress.llm import rounds
from leafpress.llm import textnum as tn

WINDOW, ANCHOR = 20, 5
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int>>"


class Block:
    """Words of a block's documents in order, with their windows' hashes and anchors."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window = rounds.ordered(table), window
        starts, ends, docs, hashes, at = [], [], [], [], 0
        for part, raw, off in tn.slices(self.table, self.table.schema.get_field_index("text")):
            s, e, d = tn.word_spans(raw, off)
            hashes.append(tn.word_hashes(raw, s, e) if len(s) else np.zeros(0, np.uint64))
            starts.append(s - off[d] if len(s) else s)
            ends.append(e - off[d] if len(s) else e)
            docs.append(d + at)
            at += part.num_rows
        self.starts, self.ends, self.docs, words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, docs, hashes))
        self.words = words.astype(np.uint64)
        n = max(0, len(self.words) - window + 1)
        self.valid = self.docs[:n] == self.docs[window - 1 :] if n else np.zeros(0, dtype=bool)
        grams = tn.window_hash(self.words, ANCHOR)
        self.least = np.where(self.valid, rounds.sliding_min(grams, window - ANCHOR + 1), np.uint64(0)) if n else np.zeros(0, np.uint64)
        # An anchor is a gram that is the least of some window: its value equals the largest minimum over it.
        width = window - ANCHOR
        padded = np.concatenate([np.zeros(width, np.uint64), self.least, np.zeros(width, np.uint64)])
        over = ~rounds.sliding_min(~padded, width + 1) if n else np.zeros(0, np.uint64)
        # Least hashes lie near zero; mixed again, they spread over the buckets.
        self.anchors = tn.mix64(grams[: len(over)][grams[: len(over)] == over])
        self.least = tn.mix64(self.least)

    def candidates(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose anchor is repeated: their places and hashes."""
        known = np.unique(self.anchors)
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        wanted = known[rounds.answered(replies, 1, known, buckets)]
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(wanted, self.least), len(wanted) - 1)
        places = np.flatnonzero(self.valid & (wanted[at] == self.least))
        return places, tn.window_hash(self.words, self.window)[places]


def _first_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and where each occurs first."""
    return np.unique(keys, return_index=True)


def _earliest(asked: pa.Table) -> pa.Table:
    """Bits of the windows that another block has in an earlier document."""
    asked = asked.combine_chunks()
    keys, anchors, rows, docs, checks, sizes = [], [], [], [], [], []
    for k, raw in enumerate(asked["body"].to_pylist()):
        (key, anchor, row), head = rounds.body(raw, "<u8", "<u4", "<u4")
        anchors.append(anchor)
        ids = np.frombuffer(head, dtype="<i8").reshape(3, -1)
        keys.append(key)
        docs.append(ids[0][row])
        checks.append(ids[1][row] | ids[2][row] << 40)  # a null id counts as larger than any
        rows.append(np.full(len(key), k))
        sizes.append(len(key))
    key, anchor, row, doc, check = (np.concatenate(x) for x in (keys, anchors, rows, docs, checks))
    every = key
    order = np.argsort(key, kind="stable")
    key = key[order]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= key[1:] == key[:-1]
    twice[:-1] |= key[1:] == key[:-1]
    order = order[twice]
    null = check[order] >> 40
    order = order[np.lexsort((check[order], doc[order], null, anchor[order], every[order]))]
    flat, beside = every[order], anchor[order]
    bits = np.zeros(len(row), dtype=bool)
    bits[order[1:][(flat[1:] == flat[:-1]) & (beside[1:] == beside[:-1])]] = True
    return rounds.answers(asked, np.split(bits, np.cumsum(sizes)[:-1]), 2)


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per document: words, removed words, hash of the kept text and the factors."""
    blocks, deal = rounds.dealt(docs)
    buckets = deal.buckets

    def anchors(table: pa.Table) -> pa.Table:
        return rounds.ask_repeats(table["block"][0].as_py(), Block(table, window).anchors, buckets)[0]

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rounds._ASK.empty_table()
        block = Block(table, window)
        places, keys = block.candidates(replies, buckets)
        if not len(keys):
            return rounds._ASK.empty_table()
        distinct, first = _first_places(keys)
        doc = block.docs[places[first]]
        rows, local = np.unique(doc, return_inverse=True)
        ids = block.table["doc_id"]
        head = np.stack([ids.fill_null(0).to_numpy()[rows], block.table["check"].to_numpy()[rows], ids.is_null().to_numpy(zero_copy_only=False)[rows].astype(np.int64)]).astype("<i8").tobytes()
        anchor = (block.least[places[first]] >> np.uint64(32)).astype("<u4")
        return rounds.questions(table["block"][0].as_py(), distinct, buckets, anchor, local.astype("<u4"), head=head)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table, window)
        places, keys = block.candidates(replies, buckets)
        marks = np.zeros(len(block.valid), dtype=bool)
        if len(keys):
            distinct, first = _first_places(keys)
            again = np.ones(len(keys), dtype=bool)
            again[first] = rounds.answered(replies, 2, distinct, buckets)
            marks[places[again]] = True
        gone = tn.covered(marks, window, len(block.words)) if len(marks) else np.zeros(len(block.words), dtype=bool)
        n = block.table.num_rows
        bounds = np.searchsorted(block.docs, np.arange(n + 1))
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[bounds[1:]] - sums[bounds[:-1]]
        digests, factors = [], []
        for i, text in enumerate(block.table["text"]):
            a, b = bounds[i], bounds[i + 1]
            raw, m = text.as_py().encode(), gone[a:b]
            kept = [raw[s:e] for s, e in zip(block.starts[a:b][~m].tolist(), block.ends[a:b][~m].tolist())]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            edge = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8)))
            factors.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        return pa.table({"doc_id": block.table["doc_id"], "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "factors": pa.array(factors, kind)})

    first = rounds.reply_round(deal, rounds.first_round(blocks, anchors), lambda t: rounds.repeats(t, 1))
    second = rounds.reply_round(deal, rounds.next_round(blocks, first, windows, rounds.ASK), _earliest)
    return rounds.next_round(blocks, first.unionByName(second), finish, SCHEMA)
