"""Best-fit-decreasing packing of token sequences.

Documents are tokenised once (Arrow batches), cut into pieces of at most one
sequence, and packed by best-fit decreasing. Best-fit decreasing depends on
lengths alone, so the driver packs the histogram of lengths (at most ``capacity``
entries whatever the corpus): a segment tree over remaining capacities finds the
tightest open bins of each length in logarithmic time, and bins with equal
contents are kept as ranges. Executors then look up each piece, by its rank
among the pieces of its length, in the resulting plan.

Defined cases: a null text counts as empty and gives the one piece that holds
only the end id; repeated rows are packed as documents of their own; an empty
table gives an empty table; very long texts become full sequences and a rest.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.sharding import gapless
from leafpress.llm.staging import stage

#: Most words kept in a worker's memory (about 150 bytes each); others are encoded again.
WORD_CACHE = 700_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts, word by word, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and folds ASCII case before it merges, so a
    text's ids are those of its words in turn, and words repeat.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {b"": b""}
        self.tail = re.compile(rb"([a-z]+)([.,;:!?|#*$%&()]+)")

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def full(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: bytes) -> bytes:
        got = self.known.get(word)
        if got is None:
            if m := self.tail.fullmatch(word):
                got = self.word(m[1]) + self.word(m[2])
            elif word.isalpha():  # ASCII letters: the merges alone decide
                got = self._ids([t.id for t in self.model.tokenize(word.decode())])
            else:
                got = self.full(word.decode())
            if len(self.known) < WORD_CACHE:
                self.known[word] = got
        return got

    def text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.full(text)
        words = text.encode().lower().replace(b"\n", b" ").split(b" ")
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            return b"".join(map(self.word, words))


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer)
        if encoder is None:
            encoder = _encoders[tokenizer] = WordEncoder(tokenizer)
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.text(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


class CapacityTree:
    """Segment tree over remaining capacities: how many open bins each has."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.n = [0] * (2 * self.base)

    def add(self, capacity: int, bins: int) -> None:
        i = self.base + capacity
        while i:
            self.n[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= ``least`` that an open bin has."""
        i = self.base + least
        while not self.n[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.base:
            i = 2 * i if self.n[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first bin, pieces per bin, offset) rows, by length and rank.

    Pieces of one length fill the tightest bins first; a bin just filled is the
    tightest for the next equal piece, so bins of one range take equally many.
    """
    tree, ranges, plan, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                count = -(-left // per)
                first, bins, room, opened = bins, bins + count, capacity, True
            else:
                first, count = ranges[room].pop()
                tree.add(room, -count)
                per, opened = room // length, False
            whole = min(count, left // per)
            if whole:
                plan.append((length, rank, first, per, capacity - room))
                rank, left = rank + whole * per, left - whole * per
                _open(tree, ranges, room - per * length, first, whole)
            if whole < count and left:
                plan.append((length, rank, first + whole, left, capacity - room))
                _open(tree, ranges, room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < count and not opened:
                _open(tree, ranges, room, first + whole, count - whole)
    return plan




def _open(tree: CapacityTree, ranges: dict, room: int, first: int, count: int) -> None:
    if room and count:
        ranges.setdefault(room, []).append((first, count))
        tree.add(room, count)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, rows_per_cell: int = 50_000) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    cut = stage(pieces(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = np.array(best_fit_plan(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by capacity, not by the corpus
    spread = max(8, max(histogram.values(), default=0) // rows_per_cell)
    ranked = gapless(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank", spread)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            length, rank = length.astype(np.int64), rank.astype(np.int64)
            row = rows[np.searchsorted(key, length << 44 | rank, side="right") - 1] if len(rank) else rows[:0]
            nth = rank - row[:, 1]
            extra = [pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, _PLACED)
