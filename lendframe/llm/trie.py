"""A trigram trie in Elias-Fano levels: flat arrays that are read where they lie, from bytes or a memory-mapped file.

Words are whole numbers from 1. A trie holds the trigrams (a, b, c) of some middle words b:

* level 1: the middle words, and pointers to their ranges on levels 2 and 2';
* level 2: the successors c of each b, with the frequency of (b, c);
* level 2': the predecessors a of each b, with pointers to the ranges of (a, b) on level 3;
* level 3: the successors of each (a, b), not as words but as their places among the successors of b, with the frequency of
  (a, b, c). These context-relative numbers are small, and so are the gaps between them.

Each level is one ascending sequence: a range starts from the last value of the range before. Frequencies are one-byte codes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _selects() -> np.ndarray:
    """Place of the k-th set bit of each byte."""
    out = np.zeros((256, 8), dtype=np.uint8)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(places)] = places
    return out


_SELECT = _selects()
EXACT, PER_OCTAVE = 128, 4


def quantised(counts: np.ndarray) -> np.ndarray:
    """One-byte codes of counts: exact below 128, then four levels an octave."""
    big = np.round(PER_OCTAVE * np.log2(np.maximum(counts, EXACT) / EXACT)) + EXACT
    return np.where(counts < EXACT, counts, np.minimum(big, 255)).astype(np.uint8)


#: What each code stands for.
LEVELS = np.concatenate([np.arange(EXACT, dtype=float), EXACT * 2.0 ** (np.arange(256 - EXACT) / PER_OCTAVE)])


class EliasFano:
    """A non-descending sequence: low bits packed, high bits in unary. Counts of ones and zeros before each byte are made on opening."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ranks = np.zeros(len(high) + 1, dtype=np.int32)
        np.cumsum(_POP[high], dtype=np.int32, out=self.ranks[1:])
        self.zeros = np.arange(len(high) + 1, dtype=np.int32) * 8 - self.ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * low_bits + 63) // 64 + 2, dtype=U64)
        v = values.astype(U64)
        if low_bits and n:
            part = v & U64((1 << low_bits) - 1)
            at = np.arange(n, dtype=U64) * U64(low_bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            over = (shift + U64(low_bits)) > 64
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[starts]] = np.bitwise_or.reduceat(part << shift, starts)
            # at most one value crosses into each next word
            low[word[over] + 1] |= part[over] >> (U64(64) - shift[over])
        bits = (v >> U64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(bits[-1]) + 2 if n else 1) // 8 * 8 + 16, dtype=np.uint8)
        unary[bits] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i.astype(U64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        left = (U64(64) - shift) & U64(63)
        pair = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << left, U64(0))
        return (pair & U64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(self.ranks, i.astype(np.int32), side="right") - 1
        place = byte * 8 + _SELECT[self.high[byte], i - self.ranks[byte]]
        return ((place - i) << self.low_bits) | self._lows(i)

    def _with_high(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``: ones before the zero that ends ``h - 1``."""
        inside = np.minimum(np.maximum(h - 1, 0), self.zeros[-1] - 1)
        byte = np.searchsorted(self.zeros, inside.astype(np.int32), side="right") - 1
        place = byte * 8 + _SELECT[~self.high[byte] & 255, inside - self.zeros[byte]]
        return np.where(h <= 0, 0, np.minimum(place - inside, self.n))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is ``x`` or more; n if there is none."""
        return self.find(x)[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor's place, and whether it is ``x`` itself."""
        h = x >> self.low_bits
        lo, end = self._with_high(h), self._with_high(h + 1)
        hi, want = end.copy(), x & ((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_], hi[open_] = np.where(less, mid + 1, a), np.where(less, b, mid)
            open_ = open_[lo[open_] < hi[open_]]
        there = lo < end
        some = np.flatnonzero(there)
        there[some] = self._lows(lo[some]) == want[some]
        return lo, there

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits]), self.low, self.high]

    @classmethod
    def from_arrays(cls, a: list[np.ndarray]) -> EliasFano:
        return cls(int(a[0][0]), int(a[0][1]), *a[1:])


def _chained(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending ranges put one after the other: each begins from the last value of the one before."""
    if not len(values):
        return values
    lasts = values[np.r_[starts[1:], len(values)] - 1]
    base = np.concatenate([[0], np.cumsum(lasts)[:-1]])
    return values + np.repeat(base, np.diff(np.r_[starts, len(values)]))


def _heads(*columns: np.ndarray) -> np.ndarray:
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def sorted_by(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The order by three columns of whole numbers; two that fit are sorted as one."""
    if len(first) and max(int(first.max()), int(second.max())) < 1 << 31:
        return np.lexsort((third, first << 32 | second))
    return np.lexsort((third, second, first))


class Trie:
    PARTS = ("middle", "to_after", "to_before", "after", "before", "to_third", "third")

    def __init__(self, parts: dict[str, EliasFano], two: np.ndarray, three: np.ndarray) -> None:
        self.parts, self.two, self.three = parts, two, three

    @classmethod
    def of(cls, b: np.ndarray, c: np.ndarray, a: np.ndarray, counts: np.ndarray) -> Trie:
        """From trigrams sorted by b, c and a; equal ones are added up."""
        heads = _heads(b, c, a)
        counts = np.add.reduceat(counts, heads) if len(heads) else counts
        a, b, c = a[heads], b[heads], c[heads]
        pair = _heads(b, c)
        b2, c2 = b[pair], c[pair]
        two = np.add.reduceat(counts, pair) if len(pair) else counts
        start2 = _heads(b2)
        middle = b2[start2]
        which = np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, len(b)]))
        relative = which - np.repeat(start2, np.diff(np.r_[start2, len(b2)]))[which] + 1
        order = sorted_by(b, a, relative)
        a3, b3, r3, three = a[order], b[order], relative[order], counts[order]
        start3 = _heads(b3, a3)
        a1, b1 = a3[start3], b3[start3]
        start1 = _heads(b1)
        ends = lambda starts, n: EliasFano.of(np.r_[starts, n])
        parts = {
            "middle": EliasFano.of(middle), "to_after": ends(start2, len(c2)), "to_before": ends(start1, len(a1)), "after": EliasFano.of(_chained(c2, start2)),
            "before": EliasFano.of(_chained(a1, start1)), "to_third": ends(start3, len(r3)), "third": EliasFano.of(_chained(r3, start3)),
        }
        return cls(parts, quantised(two), quantised(three))

    def to_bytes(self) -> bytes:
        arrays = [x for p in self.PARTS for x in self.parts[p].arrays()] + [self.two, self.three]
        table, body, at = [], [], 8 * 3 * len(arrays)
        for x in arrays:
            raw = np.ascontiguousarray(x).tobytes()
            table += [at, len(x), {"u": 0, "i": 1}[x.dtype.kind] * 10 + x.dtype.itemsize]
            pad = -len(raw) % 8
            body.append(raw + bytes(pad))
            at += len(raw) + pad
        return np.array(table, dtype=np.int64).tobytes() + b"".join(body)

    @classmethod
    def over(cls, buffer) -> Trie:
        """A trie on a buffer or a memory map, without copying it."""
        n = 3 * len(cls.PARTS) + 2
        table = np.frombuffer(buffer, dtype=np.int64, count=3 * n).reshape(n, 3)
        kinds = {1: np.uint8, 8: np.uint64, 18: np.int64}
        arrays = [np.frombuffer(buffer, dtype=kinds[int(kind)], count=int(size), offset=int(at)) for at, size, kind in table]
        parts = {p: EliasFano.from_arrays(arrays[3 * k : 3 * k + 3]) for k, p in enumerate(cls.PARTS)}
        return cls(parts, arrays[-2], arrays[-1])

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls.over(np.memmap(path, mode="r"))

    def _range(self, pointers: str, level: str, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ranges of ``parent`` start, and the values that they start from."""
        start = self.parts[pointers].access(parent)
        base = np.zeros(len(parent), dtype=np.int64)
        inner = np.flatnonzero(start > 0)
        base[inner] = self.parts[level].access(start[inner] - 1)
        return start, base

    def _inside(self, pointers: str, parent: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """``there``, but only where the place is still in the range of its parent."""
        some = np.flatnonzero(there)
        out = np.zeros(len(at), dtype=bool)
        out[some] = at[some] < self.parts[pointers].access(parent[some] + 1)
        return out

    def codes(self, b: np.ndarray, c: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the frequencies of (b, c) and (a, b, c), 0 for what isn't there. Sorted queries share their steps."""
        two, three = np.zeros(len(b), dtype=np.uint8), np.zeros(len(b), dtype=np.uint8)
        if not len(self.two) or not len(b):
            return two, three
        after, before, third = self.parts["after"], self.parts["before"], self.parts["third"]
        # once for each run of b: its place and its ranges of successors and predecessors
        heads = _heads(b)
        middle, known = self.parts["middle"].find(b[heads])
        middle[~known] = 0
        (start2, base2), (_, base1) = self._range("to_after", "after", middle), self._range("to_before", "before", middle)
        run = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(b)]))
        # once for each (b, c)
        pair = _heads(b, c)
        own = run[pair]
        at, there = after.find(base2[own] + c[pair])
        there = self._inside("to_after", middle[own], at, there & known[own])
        spread = np.diff(np.r_[pair, len(b)])
        two = np.repeat(np.where(there, self.two[np.where(there, at, 0)], 0).astype(np.uint8), spread)
        relative = np.repeat(at - start2[own] + 1, spread)
        # only where (b, c) is there: the context (a, b), then the relative number
        rest = np.flatnonzero(np.repeat(there, spread))
        context, there = before.find(base1[run[rest]] + a[rest])
        there = self._inside("to_before", middle[run[rest]], context, there)
        rest, context = rest[there], context[there]
        _, base3 = self._range("to_third", "third", context)
        at, there = third.find(base3 + relative[rest])
        there = self._inside("to_third", context, at, there)
        three[rest[there]] = self.three[at[there]]
        return two, three
