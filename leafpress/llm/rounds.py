"""Corpus-wide repeat tests on hashes, in rounds between document blocks and hash buckets.

Documents are dealt into blocks of a few MB. In each round a block sends the
sorted distinct hashes of what it asks about, packed by bucket; a bucket answers
each block with one bit a hash. A hash reaches a bucket once from each block
however often it occurs in it, so no common passage floods a task; and all of a
block's work is bounded by its size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm import textnum as tn
from leafpress.llm.staging import text_bytes

#: Text bytes of a block of documents, of those that share a bucket, and of a task's.
BLOCK_BYTES, BUCKET_BYTES, TASK_BYTES = 2_500_000, 8_000_000, 12_000_000
ASK = "block int, bucket int, body binary"
ANSWER = "block int, bucket int, round int, bits binary"
_ASK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("bits", pa.binary())])


class Deal:
    """How documents are dealt: blocks and buckets grow with the texts, and so do the tasks that hold them."""

    def __init__(self, docs: DataFrame, block_bytes: int):
        size = text_bytes(docs)
        self.blocks, self.buckets = max(8, -(-size // block_bytes)), max(8, -(-size // BUCKET_BYTES))
        # Above some 100,000 tasks each takes more blocks, one after the other.
        self.tasks = min(max(8, -(-size // TASK_BYTES)), 100_000)

    def by(self, df: DataFrame, column: str) -> DataFrame:
        return df.repartition(min(self.tasks, getattr(self, f"{column}s")), column)


def dealt(docs: DataFrame, *more: Column, block_bytes: int | None = None) -> tuple[DataFrame, Deal]:
    """(block, doc_id, check, more, text), by block, and how they were dealt. Equal rows share a block."""
    deal = Deal(docs, block_bytes or BLOCK_BYTES)
    text = F.coalesce(F.col("text"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(deal.blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.col("doc_id").cast("long"), F.crc32(text.cast("binary")).alias("check"), *more, text.alias("text"))
    return deal.by(rows, "block"), deal


def ordered(table: pa.Table) -> pa.Table:
    """A block's documents by (doc_id, check), null ids last."""
    docs, check = table["doc_id"], table["check"].to_numpy()
    order = np.lexsort((check, docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)))
    return table.take(pa.array(order)).combine_chunks()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted hashes are grouped by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted keys reach, and where each begins and the last ends."""
    of = bucket_of(keys, buckets)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return of[at], np.append(at, len(keys))


def questions(block: int, keys: np.ndarray, buckets: int, *columns: np.ndarray, head: bytes = b"", send: np.ndarray | None = None) -> pa.Table:
    """Rows that ask about sorted distinct keys; further columns go along, key by key.
    ``send`` goes in the keys' place."""
    of, at = cuts(keys, buckets)
    send = keys if send is None else send
    bodies = []
    for i, j in zip(at[:-1], at[1:]):
        parts = [np.uint32(j - i).tobytes(), send[i:j].tobytes(), *(c[i:j].tobytes() for c in columns), head]
        bodies.append(b"".join(parts))
    return pa.table([pa.array(np.full(len(of), block, dtype=np.int32)), pa.array(of.astype(np.int32)), pa.array(bodies, pa.binary())], schema=_ASK)


def body(raw: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    n, at, out = int(np.frombuffer(raw, dtype=np.uint32, count=1)[0]), 4, []
    for k in kinds:
        out.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
        at += n * np.dtype(k).itemsize
    return out, raw[at:]


def answers(asked: pa.Table, bits: list[np.ndarray], number: int) -> pa.Table:
    packed = [np.packbits(b).tobytes() for b in bits]
    return pa.table([asked["block"], asked["bucket"], pa.array(np.full(len(bits), number, dtype=np.int32)), pa.array(packed, pa.binary())], schema=_ANSWER)


def answered(replies: pa.Table, number: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of sorted keys, from the replies to ``questions`` about them."""
    out = np.zeros(len(keys), dtype=bool)
    of, at = cuts(keys, buckets)
    place = {int(b): (i, j) for b, i, j in zip(of, at[:-1], at[1:])}
    for bucket, n, bits in zip(*(replies[c].to_pylist() for c in ("bucket", "round", "bits"))):
        if n == number:
            i, j = place[bucket]
            out[i:j] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=j - i)
    return out


#: Keys that make a batch of a level family.
BATCH_KEYS = 200_000


class LevelFamily:
    """A family of sorted arrays of distinct keys with geometrically growing sizes.

    A new batch is sorted and merge-scanned against every level; keys found there
    mark their entry, the others become a level, and levels of like size merge.
    A key is marked if it comes twice, or, where keys have values, comes with
    two different values.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []  # keys, values, marks

    def add(self, keys: np.ndarray, marks: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Mask of the places where a key came for the first time."""
        fresh = np.zeros(len(keys), dtype=bool)
        if not len(keys):
            return fresh
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        own, mark = sorted_keys[starts], np.logical_or.reduceat(marks[order], starts)
        if values is None:
            value = np.zeros(len(own), dtype=np.uint64)
            mark |= np.diff(np.append(starts, len(keys))) > 1
        else:
            value = np.minimum.reduceat(values[order], starts)
            mark |= value != np.maximum.reduceat(values[order], starts)
        new = np.ones(len(own), dtype=bool)
        for known, known_value, known_mark in self.levels:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.flatnonzero(known[at] == own)
            known_mark[at[hit]] |= True if values is None else mark[hit] | (known_value[at[hit]] != value[hit])
            new[hit] = False
        fresh[order[starts[new]]] = True
        if new.any():
            self.levels.append([own[new], value[new], mark[new]])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(b, a)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])
        return fresh

    def marked(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for known, _, mark in self.levels:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            out |= (known[at] == keys) & mark[at]
        return out


def in_order(asked: pa.Table) -> pa.Table:
    return asked.take(pa.array(np.argsort(asked["block"].to_numpy(), kind="stable"))).combine_chunks()


def repeats(asked: pa.Table, number: int, firsts: int = 0, valued: bool = False, kind: str = "<u8") -> pa.Table:
    """Bits of the keys that come from two blocks, or are marked by one; in round
    ``firsts``, of those that come here first. ``valued``: of keys with two values.
    ``kind``: of the keys, hashes or bytes."""
    family, keys, fresh, sizes = LevelFamily(), [], [], []
    asked = in_order(asked)
    batch: list[list[np.ndarray]] = []

    def flush() -> None:
        if batch:
            k, m, v = (np.concatenate(x) for x in zip(*batch))
            fresh.append(family.add(k, m, v if valued else None))
            keys.append(k)
            batch.clear()

    for raw in asked["body"].to_pylist():
        (k, m, *v), _ = body(raw, kind, "?", *["<u8"] * valued)
        batch.append([k, m, v[0] if valued else m])
        sizes.append(len(k))
        if sum(len(b[0]) for b in batch) >= BATCH_KEYS:
            flush()
    flush()
    at = np.cumsum(sizes)[:-1]
    out = answers(asked, np.split(family.marked(np.concatenate(keys)), at), number)
    return pa.concat_tables([out, answers(asked, np.split(np.concatenate(fresh), at), firsts)]) if firsts else out


def ask_repeats(block: int, keys: np.ndarray, buckets: int) -> tuple[pa.Table, np.ndarray]:
    """Questions about all distinct keys, those repeated within the block marked; and the distinct keys."""
    if not len(keys):
        return _ASK.empty_table(), keys
    distinct, n = np.unique(keys, return_counts=True)
    return questions(block, distinct, buckets, n > 1), distinct


def first_round(blocks: DataFrame, ask: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(ask, ASK)


def reply_round(deal: Deal, asked: DataFrame, reply: Callable[[pa.Table], pa.Table], more: DataFrame | None = None) -> DataFrame:
    """Replies, and ``more`` rows of that kind, dealt to their blocks."""
    replies = deal.by(asked, "bucket").groupBy("bucket").applyInArrow(reply, ANSWER)
    return deal.by(replies if more is None else replies.unionByName(more), "block")


def next_round(blocks: DataFrame, replies: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(step, schema)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    done, out = 1, values.copy()
    while done < width and len(out):
        step = min(done, width - done)
        out = tn.fold(out, step, np.minimum)
        done += step
    return out
