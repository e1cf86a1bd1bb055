"""Vectorised words and hashes of many texts at once, on Arrow's own text buffers.

Hashes of windows double in length: two neighbours' hashes are mixed into one by
multiplications and shifts, so there is no sum in which parts could cancel. Two
unlike strings share a 64-bit hash with odds of one in 2^64, whatever they hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Values worked on at once, so that they stay in the cache.
PART = 1 << 15
#: Text bytes worked on at once; a longer text is taken alone.
SLICE_BYTES = 2_000_000

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F))
#: Words up to so many bytes are hashed together, longer ones one by one.
_LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair (a, b), in this order; no polynomial, so no structured text cancels out."""
    x = (a ^ _K2) * _K1
    x ^= x >> np.uint64(32)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


def fold(values: np.ndarray, step: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``join`` of each value and the one ``step`` after it, in place (front to back, in
    parts that fit the cache), as a view."""
    n = len(values) - step
    for i in range(0, n, PART):
        j = min(i + PART, n)
        values[i:j] = join(values[i:j], values[i + step : j + step])
    return values[:n]


def window_hash(values: np.ndarray, k: int, done: int = 1) -> np.ndarray:
    """Hashes of all windows of ``k`` values, from those of ``done`` values, by doubling."""
    if len(values) + done - 1 < k:
        return np.zeros(0, dtype=np.uint64)
    values = np.array(values, dtype=np.uint64)
    while done < k:
        step = min(done, k - done)
        values = fold(values, step, join2)
        done += step
    return values


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, zeros after the end."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw), dtype="<u8", buffer=padded, strides=(1,))


def byte_windows(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` >= 8 bytes."""
    return window_hash(eights(raw)[: max(0, len(raw) - 7)], k, 8)


def span_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of a few short spans of values."""
    out = sizes.astype(np.uint64) * _K3
    for i in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > i)
        out[some] = join2(out[some], values[starts[some] + i])
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch | pa.Table, column: int, most: int = SLICE_BYTES) -> Iterator[tuple]:
    """Consecutive parts of a batch of about ``most`` text bytes: (part, bytes, offsets)."""
    n, at = batch.num_rows, 0
    if not n:
        return
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw, off = buffers(col)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every word; words end with their text."""
    sep = SEPARATOR[raw]
    before, after = np.ones(len(raw), dtype=bool), np.ones(len(raw), dtype=bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    inner = off[1:-1]
    before[inner[inner < len(raw)]] = True
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(before & ~sep)
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans: 8 bytes at a time, all spans that are long enough at once."""
    size = ends - starts
    eight = eights(raw)
    out = size.astype(np.uint64) * _K3
    some, done = np.flatnonzero(size <= _LONG), 0
    while len(some):
        part = eight[starts[some] + done]
        left = size[some] - done
        short = np.flatnonzero(left < 8)
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[some] = join2(out[some], part)
        done += 8
        some = some[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask holds."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places that lie in a marked window of ``width``."""
    steps = np.zeros(n + 1, dtype=np.int32)
    steps[: len(marks)] += marks
    steps[width : width + len(marks)] -= marks
    return np.cumsum(steps[:n]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out
