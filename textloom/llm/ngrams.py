"""n-gram language model scores from Elias-Fano tries.

The corpus is cut into chunks of documents by hash.  A chunk tokenises its texts, sorts its
distinct 1-, 2- and 3-grams by hash, and sends each shard (a range of hashes) the sorted
hashes, Elias-Fano coded, with its training counts.  A shard adds the counts of all chunks
and answers in the order asked, so answers need no keys.  Shards are ranges of a hash of
the whole n-gram: a frequent word is one key for each chunk, whatever its count.

With the answers a chunk lays out the model for its texts once, as a trie in one memory-mapped
file: level 1 the words, level 2 the successors that each word has in training, level 3 those
of each pair, written as ranks among the successors of the pair's last word.  A level is one
Elias-Fano sequence: each context's successors follow the last value of the context before,
so values rise, and pointers to each context's first one rise too and are coded alike.
N-grams, and the weight that a context leaves to shorter ones, are 16-bit codes of smoothed
log probabilities.  To score a token, its context's pointers are read, and the successor is
searched between them, by the unary upper bits and then the low parts; what training does not
have is not in the trie, and the context's weight leads to the shorter n-gram.  The model of
the whole corpus is never one file: it grows with the corpus, beyond any one machine.

The model, for context h of count c(h) > 0:
p(w|h) = (1 - g) c(hw) / c(h) + g p(w|shorter h), g = D c(h)^(b - 1), which sums to one.  D is n1 / (n1 + 2 n2)
of the level's counts; b makes the modelled successors c(h)^b of all contexts add up to the
level's distinct n-grams.  Words alone: (c + 1) / (N + V + 1), the base.  All are corpus totals.

Tokens: runs of anything but ASCII white space, ASCII letters lowered, then one end token.
Cases: a null or empty text is the end token only; rows of one doc_id are rows of their own;
a null id counts as the text "" for the split; without training texts all counts are 0;
rows that agree in id and text share a chunk; other columns are left out.
Words are compared by 64-bit hashes, longer n-grams by 48 bits.
"""

from __future__ import annotations

import math
import mmap
import struct
import tempfile
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training texts: crc32 of the id's digits modulo MODULUS is not HELD_OUT.
MODULUS, HELD_OUT = 7, 2
CHUNK_BYTES = 16 << 20
LEAST_CHUNKS = 64
KEY_BITS = {1: 64, 2: 48, 3: 48}
#: Exponents at which shards add up c ** b.
EXPONENTS = np.linspace(0, 1, 21)
#: Step of the 16-bit codes of log10 probabilities.
CODE = 16 / 65535

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SLAB = 1 << 20
#: Tokens scored at once, about; a longer text is scored alone.
TRIE_TOKENS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b))]) for b in (_BASE, _BASE_INVERSE)]
    return _POWERS[0], _POWERS[1]


def _slab_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and the number of words of each."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = True
    after[inner[inner > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    return words, np.diff(np.searchsorted(starts, offsets))


class Tokens:
    """Token hashes of texts, with end tokens, and where each text starts."""

    def __init__(self, texts: list[bytes]):
        words, counts, slab, size = [], [], [], 0
        for text in [*texts, None]:
            if text is None or size > _SLAB:
                w, c = _slab_tokens(slab)
                words.append(w)
                counts.append(c)
                slab, size = [], 0
            if text is not None:
                slab.append(text)
                size += len(text)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(counts) + 1)])
        self.tokens = np.full(self.starts[-1], _END)
        inside = np.ones(len(self.tokens), bool)
        inside[self.starts[1:] - 1] = False
        self.tokens[inside] = np.concatenate(words)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.starts[:-1]] = True

    def part(self, i: int, j: int) -> Tokens:
        """Texts i to j, j excluded."""
        out = object.__new__(Tokens)
        low, high = self.starts[i], self.starts[j]
        out.starts, out.tokens, out.first = self.starts[i : j + 1] - low, self.tokens[low:high], self.first[low:high]
        return out

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of texts of about TRIE_TOKENS tokens."""
        i, n = 0, len(self.starts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + TRIE_TOKENS, "right")) - 1)
            yield i, j
            i = j

    def _previous(self, values: np.ndarray, begin) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = begin
        return out

    def keys(self, level: int) -> np.ndarray:
        """Hash of the n-gram that ends at each token; level 3 skips each text's first token."""
        h = self.tokens
        if level == 1:
            return h
        one = self._previous(h, _BEGIN)
        if level == 2:
            return _mix(one * _BASE + h) >> np.uint64(16)
        two = self._previous(one, _BEGIN)
        later = ~self.first
        return _mix((_mix(two[later] * _BASE + one[later]) + np.uint64(3)) * _BASE + h[later]) >> np.uint64(16)


def _layout(n: int, most: int) -> int:
    """Bytes of each value's low part that make the code shortest."""
    return min(range(8), key=lambda b: n * b + (n + (most >> (8 * b))) / 8)


def ef_pack(values: np.ndarray) -> bytes:
    """Elias-Fano code of ascending unsigned values: low bytes, and unary high parts."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    b = _layout(n, int(values[-1]))
    low = np.ascontiguousarray(values).view(np.uint8).reshape(n, 8)[:, :b]
    high = (values >> np.uint64(8 * b)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    return struct.pack("<IB", n, b) + np.ascontiguousarray(low).tobytes() + np.packbits(bits).tobytes()


def ef_unpack(code: bytes) -> np.ndarray:
    n, b = struct.unpack_from("<IB", code)
    out = np.zeros((n, 8), np.uint8)
    out[:, :b] = np.frombuffer(code, np.uint8, n * b, 5).reshape(n, b)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, -1, 5 + n * b))) - np.arange(n)
    return out.view(np.uint64).ravel() + (high.astype(np.uint64) << np.uint64(8 * b))


def counts_pack(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more also in full."""
    large = np.flatnonzero(counts >= 255)
    return struct.pack("<I", len(counts)) + np.minimum(counts, 255).astype(np.uint8).tobytes() + np.column_stack([large, counts[large]]).astype(np.int64).tobytes()


def counts_unpack(code: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", code)
    out = np.frombuffer(code, np.uint8, n, 4).astype(np.int64)
    large = np.frombuffer(code[4 + n :], np.int64).reshape(-1, 2)
    out[large[:, 0]] = large[:, 1]
    return out


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Ones in each byte, and the place of its k-th one.
_ONES = _BITS.sum(axis=1).astype(np.uint8)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """Ascending values: low parts, and high parts as ones in a row of bits, a zero after each high value."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        most = int(values[-1]) if self.n else 0
        wanted = max(0, (most // max(1, self.n)).bit_length() - 1)
        self.shift, kind = next((b, k) for b, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (48, np.uint64)) if wanted <= b)
        self.last = most >> self.shift
        ones = (values >> self.shift).astype(np.int64) + np.arange(self.n)
        size = -(-(self.last + self.n + 1) // 64) * 64 + 64  # a block of zeros lets windows run over the end
        bits = np.zeros(size, np.uint8)
        bits[ones] = 1
        upper = np.packbits(bits, bitorder="little")
        blocks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))]).astype(np.int64)
        self.arrays = [(values & ((1 << self.shift) - 1)).astype(kind), upper, blocks]

    def map(self, arrays: Iterator[np.ndarray]) -> None:
        """Takes the mapped copies of its arrays."""
        self.low, upper, ones = (next(arrays) for _ in self.arrays)
        self.upper = upper.reshape(-1, 8)
        #: 64 bits from each byte on
        self.windows = np.ndarray(len(upper) - 7, "<u8", upper, strides=(1,))
        # for ones and zeros: how many come before each block, and the block of each 64th
        befores = (ones, np.arange(len(ones)) * 64 - ones)
        self.directories = [(before, np.searchsorted(before, np.arange(0, before[-1] + 64, 64), "right") - 1) for before in befores]
        del self.arrays

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one or zero of the upper bits."""
        before, hints = self.directories[zeros]
        block = hints[k >> 6]
        for _ in range(2):
            block += before[block + 1] <= k
        far = np.flatnonzero(before[block + 1] <= k)
        block[far] = np.searchsorted(before, k[far], "right") - 1
        bytes_ = self.upper[block]
        if zeros:
            bytes_ = ~bytes_
        sums = np.cumsum(_ONES[bytes_], axis=1, dtype=np.uint8)
        left = (k - before[block]).astype(np.uint8)
        byte = (sums <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(byte > 0, sums[rows, byte - 1], 0).astype(np.uint8)
        return block * 64 + byte * 8 + _PLACE[bytes_[rows, byte], left]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(i, False) - i
        return (high << self.shift) | self.low[i].astype(np.int64)

    def successor(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place in lo to hi whose value is not below each wanted one, and whether it is that value."""
        high = np.minimum(wanted >> self.shift, self.last)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) + 1 - high, 0)
        # the high value's ones follow that zero: a run of them, counted in a window
        at = start + high
        window = self.windows[at >> 3] >> (at & 7).astype(np.uint64)
        run = np.bitwise_count(window ^ (window + np.uint64(1))).astype(np.int64) - 1
        end = start + run
        long = np.flatnonzero(run >= 56)
        end[long] = self._select(high[long], True) - high[long]
        beyond = (wanted >> self.shift) > self.last
        at, end = np.minimum(np.maximum(np.where(beyond, end, start), lo), hi), np.minimum(end, hi)
        low = (wanted & ((1 << self.shift) - 1)).astype(self.low.dtype)
        stop = np.maximum(at, end)
        least, most = at.copy(), stop.copy()
        open_ = np.flatnonzero(least < most)
        while len(open_):
            middle = (least[open_] + most[open_]) >> 1
            below = self.low[middle] < low[open_]
            least[open_[below]] = middle[below] + 1
            most[open_[~below]] = middle[~below]
            open_ = open_[least[open_] < most[open_]]
        same = (least < stop) & ~beyond
        same[same] = self.low[least[same]] == low[same]
        return least, same


class Level:
    """Successors of contexts 0 to n: one Elias-Fano sequence, with pointers to each context's first one."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, n: int):
        """context, successor: the pairs in order."""
        places = np.searchsorted(context, np.arange(n + 1))
        ends = np.flatnonzero(np.diff(context, append=n))
        base = np.zeros(len(context), np.int64)
        if len(ends):
            sums = np.concatenate([[0], np.cumsum(successor[ends])[:-1]])
            base = np.repeat(sums, np.diff(ends, prepend=-1))
        self.pointers, self.values = EliasFano(places), EliasFano(base + successor)

    def children(self, context: np.ndarray) -> np.ndarray:
        """The place of each context's first successor."""
        return self.pointers.access(context)

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair, and whether it is there."""
        asked, which = np.unique(context, return_inverse=True)
        lo, hi = self.pointers.access(asked), self.pointers.access(asked + 1)
        base = np.zeros(len(asked), np.int64)
        base[lo > 0] = self.values.access(lo[lo > 0] - 1)
        return self.values.successor(base[which] + successor, lo[which], hi[which])


def mapped(arrays: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The arrays, written to one memory-mapped file that has no name and goes with its last reader."""
    sizes = [-(-a.nbytes // 8) * 8 for a in arrays]
    with tempfile.TemporaryFile() as file:
        file.truncate(max(8, sum(sizes)))
        area, at = mmap.mmap(file.fileno(), 0), 0
    for a, size in zip(arrays, sizes):
        view = np.frombuffer(area, a.dtype, len(a), at)
        view[:] = a
        yield view
        at += size


def _code(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) / CODE), 65535).astype(np.uint16)


class Totals:
    """Corpus totals from all shards."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        sums = {k: np.zeros(4 + len(EXPONENTS)) for k in (1, 2, 3)}
        for level, stats in rows:
            sums[level] += stats
        self.tokens, self.types = int(sums[1][0]), int(sums[1][1])
        self.discount, self.exponent = {}, {}
        for level in (2, 3):
            types, once, twice = sums[level][1:4]
            self.discount[level] = float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))
            self.exponent[level] = float(np.interp(types, sums[level - 1][4:], EXPONENTS)) if types else 1.0

    def lower_weight(self, level: int, context: np.ndarray) -> np.ndarray:
        return np.where(context > 0, self.discount[level] * np.maximum(context, 1) ** (self.exponent[level] - 1.0), 1.0)


def shard_stats(counts: np.ndarray) -> list[float]:
    """Sum, types, singletons, doubletons and sums of powers."""
    seen, times = np.unique(counts[counts > 0], return_counts=True)
    powers = [float(times @ seen.astype(float) ** b) for b in EXPONENTS]
    return [float(seen @ times), float(times.sum()), float(times[seen == 1].sum()), float(times[seen == 2].sum()), *powers]


class Trie:
    """The model's n-grams that the tokens of a chunk have and training has too."""

    def __init__(self, t: Tokens, counts: dict[int, np.ndarray], totals: Totals):
        """counts: of the n-gram that ends at each token, by level; level 3 skips each text's first token."""
        self.words, where, ids = np.unique(t.tokens, return_index=True, return_inverse=True)
        ids = self.ids = ids.astype(np.int32)  # of the chunk's tokens
        begin = len(self.words)
        self.size = begin + 1  # the last id stands for the beginning
        one = t._previous(ids, begin)
        c1 = counts[1][where].astype(np.int64)
        p1 = (c1 + 1) / (totals.tokens + totals.types + 1)
        # as many beginnings as ends
        c1 = np.append(c1, counts[1][t.starts[1] - 1] if len(t.starts) > 1 else 0)
        seen = counts[2] > 0
        pair = one[seen] * np.int64(self.size) + ids[seen]
        pairs, where, which = np.unique(pair, return_index=True, return_inverse=True)
        nodes = np.zeros(len(ids), np.int32)
        nodes[seen] = which
        del pair, which
        c2 = counts[2][seen][where].astype(np.int64)
        head, tail = pairs // self.size, pairs % self.size
        g2 = totals.lower_weight(2, c1)
        p2 = (1 - g2[head]) * c2 / np.maximum(c1[head], 1) + g2[head] * p1[tail]
        self.level2 = Level(head, tail, self.size)
        first = np.searchsorted(head, np.arange(self.size))
        # a triple is its first pair's node and its last pair's rank among the last pair's context
        later = np.flatnonzero(~t.first)
        # a triple whose hash is a learnt one's by chance may have pairs that are not
        there = (counts[3] > 0) & seen[later] & seen[later - 1]
        at = later[there]
        del later, seen
        rank = nodes[at] - first[one[at]]
        width = int(rank.max(initial=0)) + 1
        where = np.unique(nodes[at - 1] * np.int64(width) + rank, return_index=True)[1]
        context, rank, lower = nodes[at[where] - 1].astype(np.int64), rank[where], nodes[at[where]]
        del at, one, nodes
        c3 = counts[3][there][where].astype(np.int64)
        g3 = totals.lower_weight(3, c2)
        p3 = (1 - g3[context]) * c3 / np.maximum(c2[context], 1) + g3[context] * p2[lower]
        self.level3 = Level(context, rank, len(pairs))
        sequences = [self.level2.pointers, self.level2.values, self.level3.pointers, self.level3.values]
        codes = [_code(p) for p in (p1, p2, p3, g2, g3)]
        arrays = mapped([*(a for s in sequences for a in s.arrays), *codes])
        for s in sequences:
            s.map(arrays)
        self.codes1, self.codes2, self.codes3, self.left2, self.left3 = arrays

    def log_probabilities(self, t: Tokens, ids: np.ndarray | None = None) -> np.ndarray:
        """log10 of each token's probability; all words must be the trie's.  ids: their places among the trie's words, if they are known."""
        ids = np.searchsorted(self.words, t.tokens) if ids is None else ids.astype(np.int64)
        one = t._previous(ids, self.size - 1)
        node, there = self.level2.find(one, ids)
        out = self.left2[one].astype(np.int64) + self.codes1[ids]
        out[there] = self.codes2[node[there]]
        later = np.flatnonzero(~t.first)
        # a pair that training lacks leaves all to the shorter n-gram
        later = later[there[later - 1]]
        before = node[later - 1]
        out[later] += self.left3[before]
        known = there[later]
        later, before = later[known], before[known]
        contexts, which = np.unique(one[later], return_inverse=True)
        rank = node[later] - self.level2.children(contexts)[which]
        triple, found = self.level3.find(before, rank)
        out[later[found]] = self.codes3[triple[found]]
        return -CODE * out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the distinct keys."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), bool)
    ordered = keys[order]
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit: a chunk holds one for each token and level."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


def _edges(level: int, shards: int) -> list[int]:
    return [(i << KEY_BITS[level]) // shards for i in range(shards)]


def _requests(shards: int):
    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _chunks(batches):
            texts = [x for _, x, _ in rows]
            trained = np.array([h for _, _, h in rows]) == 0
            t = Tokens(texts)
            learn = np.repeat(trained, np.diff(t.starts))
            for level in (1, 2, 3):
                keys, mark = t.keys(level), learn if level < 3 else learn[~t.first]
                order = np.argsort(keys)
                keys, mark = keys[order], mark[order]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                distinct = keys[starts]
                counts = np.add.reduceat(mark.astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64)
                edges = _edges(level, shards)
                cuts = [*np.searchsorted(distinct, np.array(edges, np.uint64)).tolist(), len(distinct)]
                out = []
                for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    out.append((s, level, chunk, ef_pack(distinct[i:j] - np.uint64(edges[s])), counts_pack(counts[i:j])))
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "level", "chunk", "keys", "counts"), r)) for r in out], _REQUEST)

    return request


_REQUEST = pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("stats", pa.list_(pa.float64()))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (doc_id, UTF-8 text, held out) of each chunk; chunks come one after another."""
    chunk, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for c, doc_id, text, held in zip(*columns):
            if c != chunk:
                if rows:
                    yield chunk, rows
                chunk, rows = c, []
            rows.append((doc_id, (text or "").encode(), held))
    if rows:
        yield chunk, rows


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(blocks: list[tuple]) -> pa.RecordBatch:
        keys = [ef_unpack(k) for _, _, _, k, _ in blocks]
        cuts = np.cumsum([0, *map(len, keys)])
        asked = np.concatenate(keys)
        del keys
        given = np.concatenate([counts_unpack(c) for *_, c in blocks])
        order = np.argsort(asked)
        asked = asked[order]
        new = np.ones(len(asked), bool)
        new[1:] = asked[1:] != asked[:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(given[order], starts) if len(starts) else np.zeros(0, np.int64)
        totals = np.empty(len(asked), np.int64)
        totals[order] = sums[np.cumsum(new) - 1] if len(starts) else 0
        stats = shard_stats(sums)
        rows = [{"chunk": b[2], "level": b[1], "shard": b[0], "counts": counts_pack(totals[i:j]), "stats": stats} for b, i, j in zip(blocks, cuts, cuts[1:])]
        return pa.RecordBatch.from_pylist(rows, _ANSWER)

    at, blocks = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != at:
                if blocks:
                    yield answer(blocks)
                at, blocks = row[:2], []
            blocks.append(row)
    if blocks:
        yield answer(blocks)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of one chunk from its texts and the shards' answers."""
    texts = [(x.as_py() or "").encode() for x in docs.column("text")]
    if not texts:
        return _RESULT_ARROW.empty_table()
    t = Tokens(texts)
    del texts
    answers = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
    found: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
    stats = []
    for level, code, s in zip(answers.column("level").to_pylist(), answers.column("counts"), answers.column("stats").to_pylist()):
        found[level].append(_narrow(counts_unpack(code.as_py())))
        stats.append((level, s))
    del answers
    totals = Totals(stats)
    # a level at a time, and sums of texts instead of values of tokens: a chunk's arrays are most of a worker's memory
    counts = {k: np.concatenate(found.pop(k))[_ranks(t.keys(k))] for k in (1, 2, 3)}
    trie = Trie(t, counts, totals)
    first = counts.pop(1)
    counts.clear()
    sums = {"known": np.empty(len(t.starts) - 1, np.int64), "base": np.empty(len(t.starts) - 1), "score": np.empty(len(t.starts) - 1)}
    for i, j in t.slices():
        here, part = slice(t.starts[i], t.starts[j]), t.part(i, j)
        c, at = first[here].astype(np.int64), part.starts[:-1]
        sums["known"][i:j] = np.add.reduceat((c > 0).astype(np.int64), at)
        sums["base"][i:j] = np.add.reduceat(np.log10((c + 1) / (totals.tokens + totals.types + 1)), at)
        sums["score"][i:j] = np.add.reduceat(trie.log_probabilities(part, trie.ids[here]), at)
    return pa.table(
        [
            docs.column("doc_id"),
            pa.array(docs.column("held_out").to_numpy().astype(bool)),
            pa.array(np.diff(t.starts)),
            pa.array(sums["known"]),
            pa.array(np.full(len(t.starts) - 1, totals.tokens)),
            pa.array(sums["base"]),
            pa.array(sums["score"]),
        ],
        schema=_RESULT_ARROW,
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model scores of every text."""
    spark = docs.sparkSession
    held = (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(MODULUS)) == HELD_OUT).cast("int")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, math.ceil(size / CHUNK_BYTES))
    # by content, so that a chunk is the same rows whenever it is made again
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    parts = min(chunks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + chunks // 4))
    dealt = read.select(chunk.alias("chunk"), "doc_id", "text", "held_out").repartition(parts, "chunk")
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(_requests(chunks), "shard int, level int, chunk int, keys binary, counts binary")
    answers = asked.repartition(parts, "shard").sortWithinPartitions("shard", "level").mapInArrow(_answers, "chunk int, level int, shard int, counts binary, stats array<double>")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, _RESULT)
