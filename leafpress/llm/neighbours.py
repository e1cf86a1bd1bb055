"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Vectors are dealt into blocks, each held as one row with float and int8 codes.
Query blocks meet candidate blocks in tiles: the int8 product gives every inner
product with a bound on its quantisation error, pairs whose upper bound is under
the running k-th score are dropped, and the survivors are computed again from
the original vectors in double precision and merged by a heap for each query,
which runs through all tiles of a task. What the tasks keep, k rows a query each,
is ranked again, k rows a query before and after the shuffle. The result is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors meet only vectors of
their own length, however long; equal scores rank by the smaller id; rows that repeat a
candidate's id are candidates each; of query rows that share an id the smallest
vector asks; fewer candidates than k give all of them; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, BLOCK_ROWS = 20, 8192
#: Bytes of a packed block, and of the candidate blocks that a query block meets in one task.
BLOCK_BYTES, GROUP_BYTES = 8_000_000, 64_000_000
_BLOCK = "block int, dim int, ids binary, vectors binary, codes binary, scales binary, errors binary"
_NEAR = "query_id long, vec_id long, score double"


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of each vector's quantisation error."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes, scale, error * (1 + 1e-9) + 1e-30


def blocked(vectors: DataFrame, key: str, value: str, blocks: int) -> DataFrame:
    """One row for each block (and vector length) of at most about ``BLOCK_ROWS`` vectors."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table[value].combine_chunks()
        matrix = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(table.num_rows, -1)
        ids = table[key].to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        matrix, ids = matrix[order], ids[order]
        codes, scale, error = quantised(matrix)
        cells = [matrix.astype("<f8"), codes, scale, error]
        return pa.table([[table["block"][0].as_py()], [matrix.shape[1]], [ids.tobytes()], *([c.tobytes()] for c in cells)], schema=pa.schema([("block", pa.int32()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "vectors", "codes", "scales", "errors"))]))

    rows = vectors.select(F.pmod(F.xxhash64(key, value), F.lit(blocks)).cast("int").alias("block"), F.size(value).alias("dim"), F.col(key).cast("long").alias(key), F.col(value).cast("array<double>").alias(value))
    return rows.groupBy("block", "dim").applyInArrow(pack, _BLOCK)


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row["ids"], "<i8")
    shape = (len(ids), row["dim"])
    return ids, np.frombuffer(row["vectors"], "<f8").reshape(shape), np.frombuffer(row["codes"], np.int8).reshape(shape), np.frombuffer(row["scales"], "<f8"), np.frombuffer(row["errors"], "<f8")


def tile(query: dict, cand: dict, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Merge the nearest of a candidate block into the heaps of a query block's queries.

    A heap holds (score, -id) of the k best so far, the worst on top.
    """
    qi, qv, qc, qs, qe = _unpack(query)
    ci, cv, cc, cs, ce = _unpack(cand)
    cf, cn = cc.astype(np.float32), np.linalg.norm(cv, axis=1)
    qn = np.linalg.norm(qv, axis=1)
    running = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    for at in range(0, len(qi), 256):
        s = slice(at, at + 256)
        # Products of codes are whole numbers below 2**24: exact in float32 up to 1040 dimensions.
        exact = qc.shape[1] <= 1040
        near = (qc[s].astype(np.float32 if exact else np.float64) @ (cf.T if exact else cc.astype(np.float64).T)).astype(np.float64)
        near *= qs[s, None]
        near *= cs[None, :]
        slack = qe[s, None] * cn[None, :] + (qn[s] + qe[s])[:, None] * ce[None, :] + 1e-12 * qn[s, None] * cn[None, :]
        own = qi[s, None] == ci[None, :]
        low = np.where(own, -np.inf, near - slack)
        n = min(k, low.shape[1])
        floor = np.maximum(-np.partition(-low, n - 1, axis=1)[:, n - 1], running[s])
        keep = (near + slack >= floor[:, None]) & ~own
        for i in range(keep.shape[0]):
            js, heap = np.flatnonzero(keep[i]), heaps[at + i]
            if not len(js):
                continue
            score = np.cumsum(cv[js] * qv[at + i], axis=1)[:, -1]  # summed in order
            for item in zip(score.tolist(), (-ci[js]).tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)


def _dealt(rows: DataFrame, value: str, block_rows: int) -> tuple[int, int]:
    """In how many blocks the vectors lie, and the bytes of one."""
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.size(value))).first()
    each = 9 * (widest or 1) + 24
    size = max(1, min(block_rows, BLOCK_BYTES // each))
    return -(-max(1, n) // size), size * each


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", value: str = "embedding", k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query."""
    vectors = vectors.filter(F.col(key).isNotNull() & _usable(F.col(value))).select(key, value)
    queries = queries.filter(F.col(key).isNotNull() & _usable(F.col(value))).groupBy(key).agg(F.min(value).alias(value))
    blocks, size = _dealt(vectors, value, block_rows)
    query_blocks, _ = _dealt(queries, value, block_rows)
    groups = -(-blocks // max(1, GROUP_BYTES // size))
    # A block is copied once for each block, or group of blocks, of the other side: packed rows, not pairs of vectors.
    cands = blocked(vectors, key, value, blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("g", F.pmod("block", F.lit(groups)))
    asks = blocked(queries, key, value, query_blocks).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("block", "q")
    tasks = min(query_blocks * groups, 100_000)
    meet = lambda df: df.repartition(tasks, "dim", "q", "g").groupBy("dim", "q", "g")

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for query in asked.to_pylist():
            ids = np.frombuffer(query["ids"], "<i8").tolist()
            heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
            for i in range(found.num_rows):
                tile(query, found.slice(i, 1).to_pylist()[0], k, heaps)
            for q, heap in zip(ids, heaps):
                out[0] += [q] * len(heap)
                out[1] += [-c for _, c in heap]
                out[2] += [x for x, _ in heap]
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    near = meet(asks).cogroup(meet(cands)).applyInArrow(run, _NEAR)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
