"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is one trie over all training documents, sharded by context: a shard
holds a part of the contexts of an order with all their successors (those of
a context counted over ``PART`` times are split by word, so that no shard holds a
frequent context alone). Its level has monotone pointers and successors in
Elias-Fano code and smoothed probabilities quantised to 16 bits, in anonymous
memory maps, and is queried by a search among the successors of a context.

Blocks of documents ask the shards, an order a round, for the n-grams that occur
in them, and tell how often they occur in their training documents; shards add
up, build their level, look every question up in it and answer with its place and
count (and its quantised probability, where that does not follow from a small
count). If one of an n-gram's two shorter n-grams has all its training occurrences
in a block, so has the n-gram, and that block need not ask for it. It still tells
it if both are wanted, that is, stand in another block's held-out texts; shards
say so with their answers. Words and n-grams have exact numbers (their shard and
place in it), which name the contexts of the next order.

The model interpolates, after Witten and Bell, with the number of different
successors of a context that occurs c times put at T(c) = ``TYPES`` * sqrt(c):
p(w | context) = (c(context w) + T(c) * p(w | shorter context)) / (c + T(c)).
N-grams of three words and more that occur less than ``least`` times are left out;
with 1, as in the query, none are, and the sum over all words is one. A word's probability is (c - D) / N, with the
discounted mass D * V / N for the one unknown word. A text's begin is a word that
only contexts hold.

Defined cases: a null text is empty and has the end token alone; a null id is
held out; with no training documents scores use a uniform unknown word; repeated
rows are learned from and scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm import rounds
from leafpress.llm import textnum as tn

BLOCK_BYTES = 8_000_000
#: Words of the longest n-grams; steps of the quantised log10.
ORDER, STEPS = 4, 2000
#: Counts up to this go in a byte, and their probabilities follow from them.
FEW = 254
#: Factor of the successor types of a context; training occurrences of a context in one part.
TYPES, PART = 2.0, 1 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(1 << 62)
_A = np.uint8(65)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
#: Place of the k-th one in a byte, the highest bit first.
_PLACE = np.array([[*np.flatnonzero(np.unpackbits(np.uint8(b))), *[8] * 8][:8] for b in range(256)], dtype=np.int64)


def mapped(values: np.ndarray) -> np.ndarray:
    """A copy in an anonymous memory map."""
    room = mmap.mmap(-1, max(1, values.nbytes))
    room.write(np.ascontiguousarray(values).tobytes())
    return np.frombuffer(room, values.dtype, values.size)


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / length) bits each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.low = max(0, (top // max(n, 1)).bit_length() - 1)
        self.n = n
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(self.low, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8)
        self.lows = mapped(np.append(np.packbits(bits), np.zeros(8, dtype=np.uint8)))
        at = (values >> np.uint64(self.low)).astype(np.int64) + np.arange(n)
        size = int(at[-1]) + 2 if n else 1  # a zero ends the last value's high part
        high = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        high[at] = 1
        packed = np.packbits(high)
        self.highs = mapped(packed).reshape(-1, 8)
        # How many ones stand before each 64 bits.
        self.rank = mapped(np.concatenate([[0], np.cumsum(_ONES[packed].reshape(-1, 8).sum(axis=1))]).astype(np.int32))
        self.most = int(values[-1]) if n else -1

    def values(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def _select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) high bit that is ``bit``."""
        rank, high = self.rank, self.highs
        before = rank if bit else np.arange(len(rank)) * 64 - rank
        block = np.searchsorted(before, k, side="right") - 1
        raw = high[block] if bit else ~high[block]
        upto = np.cumsum(_ONES[raw], axis=1)
        rest = k - before[block]
        byte = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest = rest - np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        return block * 64 + byte * 8 + _PLACE[raw[row, byte], rest]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), dtype=np.int64)
        bit = i * self.low
        raw = np.ascontiguousarray(self.lows[(bit >> 3)[:, None] + np.arange(8)]).view(">u8")[:, 0].astype(np.uint64)
        return ((raw << (bit & 7).astype(np.uint64)) >> np.uint64(64 - self.low)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places."""
        if not len(i):
            return np.zeros(0, dtype=np.int64)
        return (self._select(1, i) - i << self.low) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values in a sequence without repeats, -1 where missing: by high bits, then by low bits."""
        out = np.full(len(values), -1, dtype=np.int64)
        ask = np.flatnonzero((values >= 0) & (values <= self.most))
        if not len(ask):
            return out
        high, low = values[ask] >> self.low, values[ask] & ((1 << self.low) - 1)
        end = self._select(0, high) - high
        first = np.where(high > 0, self._select(0, np.maximum(high - 1, 0)) + 1 - high, 0)
        open_ = np.flatnonzero(first < end)
        while len(open_):
            mid = (first[open_] + end[open_]) >> 1
            got, want = self._lows(mid), low[open_]
            same = got == want
            out[ask[open_[same]]] = mid[same]
            first[open_] = np.where(got < want, mid + 1, first[open_])
            end[open_] = np.where(same, first[open_], np.where(got > want, mid, end[open_]))
            open_ = open_[first[open_] < end[open_]]
        return out


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p * STEPS), 0, 65535).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes.astype(np.float64) / -STEPS)


def successors(count: np.ndarray) -> np.ndarray:
    """How many different words follow a context that occurs so often, as assumed."""
    return TYPES * np.sqrt(count)


def level_codes(count: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Quantised probabilities of successors, by their counts and their contexts'."""
    return quantise(np.log10(count / (seen + successors(seen))))


class Level:
    """Successors grouped by context, with quantised log10 probabilities."""

    def __init__(self, contexts: int, context: np.ndarray, word: np.ndarray, codes: np.ndarray):
        """Entries are sorted by (context, word)."""
        pointers = np.searchsorted(context, np.arange(contexts + 1))
        self.pointers = EliasFano(pointers)
        # Successors restart in each context; the last value so far is added to keep them monotone.
        last = np.zeros(contexts, dtype=np.int64)
        full = pointers[1:] > pointers[:-1]
        last[full] = word[pointers[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)[:-1]]) if contexts else last
        self.successors = EliasFano(word + 1 + base[context])
        self.codes = mapped(codes)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word among the entries of its context, or -1."""
        if not self.successors.n:
            return np.full(len(word), -1, dtype=np.int64)
        # Each context's bounds are read once.
        asked = np.zeros(self.pointers.n, dtype=bool)
        asked[context] = True
        own, number = np.flatnonzero(asked), np.cumsum(asked)[context] - 1
        first, last = self.pointers.get(own), self.pointers.get(own + 1)
        base = np.where(first > 0, self.successors.get(np.maximum(first - 1, 0)), 0)
        first, last, base = first[number], last[number], base[number]
        at = self.successors.find(word + 1 + base)
        return np.where((at >= first) & (at < last), at, -1)


# -- messages: numbers go byte by byte, so that equal high bytes pack well, and packed --


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    out = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(out.T).reshape(-1).view(kind), at + n * width


def _rising(values: np.ndarray) -> bytes:
    """Sorted numbers by their steps."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _unrising(raw: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    steps, at = _unplanes(raw, kind, n, at)
    return np.cumsum(steps, dtype=steps.dtype), at


def code_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte; those from 255 on follow in eight bytes."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def decode_counts(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return _counts(raw, n, at)[0]


def _counts(raw: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(raw, "<i8", len(large), at + n)
    return out, at + n + 8 * len(large)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(raw: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    size = -(-n // 8)
    return np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n).astype(bool), at + size


def _wanted(at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of the questions of all blocks: those about what stands in another block's held-out texts."""
    return np.bincount(at, weights=held)[at] > held


def _packed(bodies: list[bytes]) -> pa.Array:
    return pa.array([len(x).to_bytes(4, "little") + pa.compress(x, "zstd", asbytes=True) for x in bodies], pa.binary())


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(memoryview(raw)[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True)


def _rows(block: int, of: np.ndarray, bodies: list[bytes]) -> pa.Table:
    return pa.table([pa.array(np.full(len(of), block, dtype=np.int32)), pa.array(of.astype(np.int32)), _packed(bodies)], schema=rounds._ASK)


def _replies(asked: pa.Table, number: int, bodies: list[bytes]) -> pa.Table:
    return pa.table([asked["block"], asked["bucket"], pa.array(np.full(len(bodies), number, dtype=np.int32)), _packed(bodies)], schema=rounds._ANSWER)


class Words:
    """First order: a block's distinct words by hash."""

    def __init__(self, hashes: np.ndarray, train: np.ndarray, held: np.ndarray):
        self.order = np.argsort(hashes)
        self.keys, self.train, self.held = hashes[self.order], train[self.order], held[self.order]

    def ask(self, block: int, buckets: int) -> pa.Table:
        of, at = rounds.cuts(self.keys, buckets)
        return _rows(block, of, [np.uint32(j - i).tobytes() + _rising(self.keys[i:j]) + code_counts(self.train[i:j]) + _bits(self.held[i:j]) for i, j in zip(at[:-1], at[1:])])

    def hear(self, replies: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corpus count and number of each word, and whether it is wanted."""
        of, at = rounds.cuts(self.keys, buckets)
        count, ident, wanted = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), bool)
        for (bucket, raw), i, j in zip(replies, at[:-1], at[1:]):
            count[self.order[i:j]], to = _counts(raw, j - i, 0)
            place, to = _unrising(raw, "<u4", j - i, to)
            ident[self.order[i:j]] = place.astype(np.uint64) | np.uint64(bucket << 32)
            wanted[self.order[i:j]] = _unbits(raw, j - i, to)[0]
        return count, ident, wanted


def add_words(asked: pa.Table) -> pa.Table:
    """A shard's words: corpus counts and numbers; and its N, V and how many words come once and twice."""
    asked = asked.combine_chunks()
    keys, counts, held, sizes = [], [], [], []
    for raw in map(_unpacked, asked["body"].to_pylist()):
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        key, to = _unrising(raw, "<u8", n, 4)
        keys.append(key)
        count, to = _counts(raw, n, to)
        counts.append(count)
        held.append(_unbits(raw, n, to)[0])
        sizes.append(n)
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)
    cut = np.cumsum(sizes)[:-1]
    wanted = _wanted(at, np.concatenate(held))
    out = _replies(asked, 1, [code_counts(total[x]) + _rising(x.astype("<u4")) + _bits(w) for x, w in zip(np.split(at, cut), np.split(wanted, cut))])
    stats = np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], dtype="<i8").tobytes()
    bucket = asked["bucket"][0].as_py()
    return pa.concat_tables([out, pa.table([[-1 - bucket], [bucket], [0], [stats]], schema=rounds._ANSWER)])


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and place of each value."""
    order = np.argsort(values)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    return order, rank


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and each value's place in them."""
    code, own = pd.factorize(values)
    order, rank = ranks(own)
    return own[order], rank[code]


class Grams:
    """An order's n-grams as a block asks for them: by shard, context and word."""

    def __init__(self, place: np.ndarray, context: np.ndarray, context_count: np.ndarray, word: np.ndarray, train: np.ndarray, held: np.ndarray, buckets: int):
        """Numbers and counts of distinct n-grams; ``place`` orders them by context and word.
        ``held``: those that stand in held-out texts."""
        key = context * np.uint64(0x9E3779B97F4A7C15)
        split = np.flatnonzero(context_count >= PART)  # parts of a frequent context by word
        key[split] += tn.mix64(word[split] + np.uint64(7)) % (context_count[split] // PART + 1).astype(np.uint64)
        shard = rounds.bucket_of(tn.mix64(key), buckets)
        top = int(place.max(initial=0)) + 1
        self.order = np.argsort(shard * top + place) if buckets < (1 << 62) // top else np.lexsort((place, shard))
        self.context, self.context_count, self.word, self.train, self.held, shard = context, context_count, word, train, held, shard[self.order]
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        self.of, self.at = shard[first], np.append(first, len(shard))

    def ask(self, block: int, last: bool) -> pa.Table:
        """``last``: no order follows, for which it would matter what is wanted."""
        of, at = self.of, self.at
        context, count, word, train, held = (x[self.order] for x in (self.context, self.context_count, self.word, self.train, self.held))
        fresh = np.ones(len(context), dtype=bool)
        fresh[1:] = context[1:] != context[:-1]
        fresh[at[:-1]] = True
        bodies = []
        for i, j in zip(at[:-1], at[1:]):
            first = np.flatnonzero(fresh[i:j]) + i
            head = np.array([len(first), j - i], dtype="<u4").tobytes()
            sizes = np.diff(np.append(first, j))
            bodies.append(b"".join([head, _rising(context[first]), code_counts(count[first]), code_counts(sizes), _planes(word[i:j]), code_counts(train[i:j]), b"" if last else _bits(held[i:j])]))
        return _rows(block, of, bodies)

    def hear(self, replies: list[tuple[int, bytes]], last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Corpus count (0 if left out), quantised probability (of counts over ``FEW``) and number of
        each n-gram, and whether it is wanted. One that no other block asks for has no number, nor have those of the last order."""
        at, n = self.at, len(self.order)
        count, code, ident, wanted = np.zeros(n, np.int64), np.zeros(n, np.uint16), np.zeros(n, np.uint64), np.zeros(n, bool)
        for (bucket, raw), i, j in zip(replies, at[:-1], at[1:]):
            n, to = _counts(raw, j - i, 0)
            many = np.flatnonzero(n > FEW)
            own = self.order[i:j]
            count[own] = n
            code[own[many]], to = _unplanes(raw, "<u2", len(many), to)
            if last:
                continue
            named, to = _unbits(raw, j - i, to)
            wanted[own], to = _unbits(raw, j - i, to)
            named = own[named]
            ident[named] = _unrising(raw, "<u4", len(named), to)[0].astype(np.uint64) | np.uint64(bucket << 32)
        return count, code, ident, wanted


def serve(asked: pa.Table, number: int, least: int, last: bool) -> pa.Table:
    """A shard of an order: adds up its n-grams, builds their level and looks every question up in it."""
    asked = asked.combine_chunks()
    contexts, totals, words, counts, helds, sizes = [], [], [], [], [], []
    for raw in map(_unpacked, asked["body"].to_pylist()):
        c, n = np.frombuffer(raw, "<u4", 2).tolist()
        context, to = _unrising(raw, "<u8", c, 8)
        total, to = _counts(raw, c, to)
        size, to = _counts(raw, c, to)
        word, to = _unplanes(raw, "<u8", n, to)
        contexts.append(np.repeat(context, size))
        totals.append(np.repeat(total, size))
        words.append(word)
        count, to = _counts(raw, n, to)
        counts.append(count)
        if not last:
            helds.append(_unbits(raw, n, to)[0])
        sizes.append(n)
    total = np.concatenate(totals)
    # Sorted by numbers, as the blocks' questions are, so that places rise within each of them.
    own, context = ranked(np.concatenate(contexts))
    vocabulary, word = ranked(np.concatenate(words))
    seen = np.zeros(len(own), dtype=np.int64)
    seen[context] = total  # every block tells the same
    keys, at = ranked(context * len(vocabulary) + word)
    count = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    ctx, wrd = np.divmod(keys, len(vocabulary))
    kept = np.flatnonzero(count >= least)
    level = Level(len(own), ctx[kept], wrd[kept], level_codes(count[kept], seen[ctx[kept]]))
    place = level.find(ctx, wrd)
    count = np.where(place >= 0, count, 0)
    code = level.codes[np.maximum(place, 0)] if len(kept) else np.zeros(len(keys), np.uint16)
    cut = np.cumsum(sizes)[:-1]
    bodies = []
    if not last:
        named = ((place >= 0) & (np.bincount(at) > 1))[at]
        wanted = _wanted(at, np.concatenate(helds))
        flags = zip(np.split(named, cut), np.split(wanted, cut))
    for x in np.split(at, cut):
        raw = code_counts(count[x]) + _planes(code[x[count[x] > FEW]].astype("<u2"))
        if not last:
            name, want = next(flags)
            raw += _bits(name) + _bits(want) + _rising(place[x[name]].astype("<u4"))
        bodies.append(raw)
    return _replies(asked, number, bodies)


class Block:
    """Tokens of a block's documents, and what the rounds so far have told about their n-grams."""

    def __init__(self, table: pa.Table):
        self.table, self.block = rounds.ordered(table), table["block"][0].as_py()
        tokens, docs, at = [], [], 0
        for part, raw, off in tn.slices(self.table, self.table.schema.get_field_index("text")):
            raw = raw + (((raw - _A) < 26).view(np.uint8) << np.uint8(5))  # A-Z in lower case
            s, e, d = tn.word_spans(raw, off)
            n = part.num_rows
            seq = np.full(len(s) + n, _END, dtype=np.uint64)
            if len(s):
                seq[np.arange(len(s)) + d] = tn.word_hashes(raw, s, e)
            size = np.bincount(d, minlength=n) + 1
            tokens.append(seq)
            docs.append(np.repeat(np.arange(n), size) + at)
            at += n
        self.docs = np.concatenate(docs)
        self.word, self.hashes = pd.factorize(np.concatenate(tokens))
        self.bounds = np.searchsorted(self.docs, np.arange(at + 1))
        self.held = self.table["held"].to_numpy(zero_copy_only=False).astype(bool)
        self.learn = ~self.held[self.docs]
        self.train = np.bincount(self.word[self.learn], minlength=len(self.hashes))
        self.words = Words(self.hashes, self.train, np.bincount(self.word[~self.learn], minlength=len(self.hashes)) > 0)

    def listen(self, replies: pa.Table, buckets: int, upto: int, least: int, score: bool = False) -> Grams | tuple[np.ndarray, np.ndarray]:
        """The n-grams of order ``upto`` to ask for; or, if all are told, the words'
        counts and the log10 probability of every token."""
        told: dict[int, list[tuple[int, bytes]]] = {}
        for bucket, number, raw in sorted(zip(*(replies[c].to_pylist() for c in ("bucket", "round", "bits")))):
            told.setdefault(number, []).append((bucket, _unpacked(raw) if number else raw))
        count, ident, wanted = self.words.hear(told.get(1, []), buckets)
        n_tokens, n_words, once, twice = np.frombuffer(told[0][0][1], "<i8").tolist() if 0 in told else (0, 0, 0, 0)
        ends = np.flatnonzero(self.hashes == _END)
        # Local numbers of the n-gram that ends at each token (-1: none), with the
        # count and corpus number of each, whether other blocks have it in training texts,
        # and whether they want it; a text's begin is one more word.
        local = np.where(count[self.word] > 0, self.word, -1)
        counts, idents = np.append(count, count[ends]), np.append(ident, _BEGIN)
        shared, wanted = np.append(count > self.train, True), np.append(wanted, True)
        if score:
            discount = min(max(once / max(1, once + 2 * twice) if once else 0.5, 0.1), 0.9)
            p = np.where(count > 0, (count - discount) / max(n_tokens, 1), discount * n_words / n_tokens if n_tokens else 1.0)
            p = probability(quantise(np.log10(p)))[self.word]
        size = len(self.hashes)
        word_rank = np.empty(size, dtype=np.int64)
        word_rank[self.words.order] = np.arange(size)  # words are numbered in the order of their hashes
        alone = np.bincount(self.word, minlength=size + 1) == 1
        for k in range(2, upto + 1):
            context = np.concatenate([[-1], local[:-1]])
            context[self.bounds[:-1]] = size if k == 2 and len(ends) and count[ends[0]] else -1
            at = np.flatnonzero((context >= 0) & (local >= 0))
            own, rest = context[at], local[at]
            asked = shared[own] & shared[rest] | wanted[own] & wanted[rest]
            if not score:  # no longer n-gram of the others is asked for
                at, asked = at[asked], asked[asked]
                own, rest = context[at], local[at]
            word = self.word[at]
            # One that holds what stands in the block but once does so, too.
            single = alone[own] | alone[rest]
            more = np.flatnonzero(~single)
            code, keys = pd.factorize(own[more] * size + word[more])
            of = np.empty(len(at), dtype=np.int64)
            of[more] = code
            single = np.flatnonzero(single)
            of[single] = np.arange(len(keys), len(keys) + len(single))
            own, word = (np.concatenate([x, y[single]]) for x, y in zip(np.divmod(keys, size), (own, word)))
            keys = len(own)
            learn = self.learn[at]
            train = np.bincount(of[learn], minlength=keys)
            every = np.bincount(of, minlength=keys)
            seen = counts[own]
            asks = np.zeros(keys, dtype=bool)
            asks[of[asked]] = True
            asks = np.flatnonzero(asks)
            some = np.zeros(len(idents), dtype=bool)
            some[own[asks]] = True
            some = np.flatnonzero(some)
            rank = np.empty(len(idents), dtype=np.int64)
            rank[some] = ranks(idents[some])[1]
            grams = Grams(rank[own[asks]] * size + word_rank[word[asks]], idents[own[asks]], seen[asks], ident[word[asks]], train[asks], every[asks] > train[asks], buckets)
            if k == upto and not score:
                return grams
            # What is not asked for is in this block's texts only.
            found, number, wanted = np.where(train >= (1 if k == 2 else least), train, 0), np.zeros(keys, np.uint64), np.zeros(keys, bool)
            found[asks], large, number[asks], wanted[asks] = grams.hear(told.get(k, []), k == upto)
            if score:
                some = np.flatnonzero(context >= 0)
                types = successors(counts[context[some]])
                p[some] *= types / (counts[context[some]] + types)
                code = level_codes(np.maximum(found, 1), seen)
                often = np.flatnonzero(found[asks] > FEW)
                code[asks[often]] = large[often]
                hit = found[of] > 0
                p[at[hit]] += probability(code[of[hit]])
            often = found >= least
            local = np.full(len(local), -1)
            local[at[often[of]]] = of[often[of]]
            counts, idents, shared, alone = found, number, found > train, every == 1
        return count, np.log10(p)


def score(docs: DataFrame, fold: int = 10, order: int = ORDER, least: int = 2) -> DataFrame:
    """One row per document; those whose crc32(doc_id) is a multiple of ``fold`` are held out.

    ``least``: training occurrences of the n-grams of three words and more that are kept.
    """
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(True))
    blocks, deal = rounds.dealt(docs, held.alias("held"), block_bytes=BLOCK_BYTES)
    buckets = deal.buckets

    def words(table: pa.Table) -> pa.Table:
        block = Block(table)
        return block.words.ask(block.block, buckets)

    def ask(k: int):
        def grams(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return rounds._ASK.empty_table()
            block = Block(table)
            return block.listen(replies, buckets, k, least).ask(block.block, k == order)

        return grams

    def reply(k: int):
        return lambda asked: serve(asked, k, 1 if k == 2 else least, k == order)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(table)
        count, got = block.listen(replies, buckets, order, least, score=True)
        (total,) = [x for x, r in zip(replies["bits"].to_pylist(), replies["round"].to_pylist()) if r == 0]
        n, v = np.frombuffer(total, "<i8").tolist()[:2]
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))[block.word]
        add = lambda x: np.add.reduceat(x, block.bounds[:-1])  # noqa: E731  every text has its end token
        cols = [pa.array(block.held), pa.array(np.diff(block.bounds)), pa.array(add((count[block.word] > 0).astype(np.int64))), pa.array(np.full(len(block.held), n)), pa.array(add(base)), pa.array(add(got))]
        return pa.table([block.table["doc_id"], *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    first = rounds.reply_round(deal, rounds.first_round(blocks, words), add_words)
    # The sums over all words go to every block.
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([np.frombuffer(x, "<i8") for x in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], list("nvot"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row,) = batch.to_pylist()
            raw = np.array([row[c] or 0 for c in "nvot"], dtype="<i8").tobytes()
            for i in range(0, deal.blocks, 10_000):
                block = np.arange(i, min(i + 10_000, deal.blocks), dtype=np.int32)
                zero = pa.array(np.zeros(len(block), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(block), zero, zero, pa.array([raw] * len(block), pa.binary())], schema=rounds._ANSWER)

    sums = first.filter("block < 0").select("bits").mapInArrow(stats, "n long, v long, o long, t long")
    sums = sums.agg(*(F.sum(c).alias(c) for c in "nvot")).mapInArrow(spread, rounds.ANSWER)
    told = first  # with the shards' sums, in the place of blocks that have no documents
    for k in range(2, order + 1):
        asked = rounds.next_round(blocks, told, ask(k), rounds.ASK)
        told = told.unionByName(rounds.reply_round(deal, asked, reply(k), sums if k == order else None))
    # Blocks without documents hear the sums, too, and give no rows.
    return rounds.next_round(blocks, told, lambda t, r: finish(t, r) if t.num_rows else _NOTHING, SCHEMA)


_NOTHING = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
