"""Elias-Fano sequences and a two-level n-gram trie made of them, all searched in numpy on whole query arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_HALVES = [(w, _U((1 << w) - 1)) for w in (32, 16, 8, 4, 2, 1)]


def _pack(words: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """OR values into 64-bit words; ``at`` is ascending."""
    out = np.zeros(words, dtype=np.uint64)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.bitwise_or.reduceat(values, first)
    return out


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones = n, low_bits, low, high, ones
        # zeros before each block of 8 words
        self.zeros = np.arange(len(ones), dtype=np.int64) * 512 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bit = np.arange(n, dtype=np.int64) * low_bits
        low = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
        if low_bits:
            part = values & _U((1 << low_bits) - 1)
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            low |= _pack(len(low), word, part << off)
            over = np.flatnonzero((bit & 63) + low_bits > 64)
            low |= _pack(len(low), word[over] + 1, part[over] >> (_U(64) - off[over]))
        place = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        length = n + (top >> low_bits) + 1
        words = -(-(length + 1) // 512) * 8
        high = _pack(words, place >> 6, _U(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, 8).sum(axis=1, dtype=np.int64))])
        return cls(n, low_bits, low, high, ones)

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th set bit of ``high`` (of the k-th clear one with ``flip``)."""
        block = np.searchsorted(directory, k, side="right") - 1
        rest = k - directory[block]
        at = block * 8
        word = np.zeros(len(k), dtype=np.uint64)
        done = np.zeros(len(k), dtype=bool)
        where = at.copy()
        for step in range(8):
            w = self.high[at + step]
            if flip:
                w = ~w
            c = np.bitwise_count(w).astype(np.int64)
            here = ~done & (rest < c)
            word[here] = w[here]
            where[here] = at[here] + step
            done |= here
            rest = np.where(done, rest, rest - c)
        bit = np.zeros(len(k), dtype=np.int64)
        for width, mask in _HALVES:
            c = np.bitwise_count(word & mask).astype(np.int64)
            right = rest >= c
            rest = rest - c * right
            word = np.where(right, word >> _U(width), word)
            bit += width * right
        return where * 64 + bit

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.l
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        over = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return ((self.low[word] >> off) | over) & _U((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        place = self._select(i, self.ones, False)
        return ((place - i).astype(np.uint64) << _U(self.l)) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first position with a value of at least ``x``; n if there is none."""
        if not self.n:
            return np.zeros(len(x), dtype=np.int64)
        last = self.access(np.array([self.n - 1]))[0]
        beyond = x > last
        x = np.where(beyond, last, x)
        h = (x >> _U(self.l)).astype(np.int64)
        high = self._select(h, self.zeros, True) - h
        low = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        want = x & _U((1 << self.l) - 1)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self._lows(middle) < want[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        return np.where(beyond, self.n, low)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.l], dtype=np.int64), self.low, self.high, self.ones]


SCALE = 2048  # codes per decade
MISSING = 0xFFFF


def quantise(log10_p: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 probabilities in steps of 1/2048."""
    return np.clip(np.rint(-log10_p * SCALE), 0, MISSING - 1).astype(np.uint16)


class Trie:
    """Contexts, a monotone pointer each, and their successors with quantised probabilities.

    Successors are 40-bit fingerprints, ascending within a context and shifted by the last value of the context
    before, so the whole level is one ascending sequence. A query finds its context, reads the two pointers and
    searches the successor relative to that base.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, contexts: np.ndarray, counts: np.ndarray, fingerprints: np.ndarray, codes: np.ndarray) -> Trie:
        """``contexts`` ascending and distinct, ``counts`` of successors, both further arrays in that order."""
        ends = np.cumsum(counts)
        starts = ends - counts
        tops = np.cumsum(fingerprints[ends - 1] + _U(1)) if len(counts) else np.empty(0, dtype=np.uint64)
        base = np.concatenate([np.zeros(min(1, len(tops)), dtype=np.uint64), tops[:-1]])
        values = fingerprints + _U(1) + np.repeat(base, counts)
        return cls(EliasFano.build(contexts), EliasFano.build(np.concatenate([starts, ends[-1:]])), EliasFano.build(values), codes)

    def search(self, contexts: np.ndarray, which: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """Codes of (contexts[which], fingerprints); MISSING where the pair isn't in the trie."""
        out = np.full(len(which), MISSING, dtype=np.uint16)
        if not self.contexts.n or not len(which):
            return out
        rank = self.contexts.successor(contexts)
        inside = np.minimum(rank, self.contexts.n - 1)
        known = (rank < self.contexts.n) & (self.contexts.access(inside) == contexts)
        first = self.pointers.access(inside).astype(np.int64)
        last = self.pointers.access(inside + 1).astype(np.int64)
        base = np.where(first > 0, self.successors.access(np.maximum(first - 1, 0)), _U(0))
        rows = np.flatnonzero(known[which])
        for at in range(0, len(rows), 1 << 17):
            part = rows[at : at + (1 << 17)]
            c = which[part]
            want = base[c] + fingerprints[part] + _U(1)
            place = self.successors.successor(want)
            near = place < last[c]
            place = np.minimum(place, self.successors.n - 1)
            hit = near & (self.successors.access(place) == want)
            out[part[hit]] = self.codes[place[hit]]
        return out

    def save(self, path: str) -> None:
        levels = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.codes]
        with open(path, "wb") as f:
            f.write(np.array([x.nbytes for x in levels], dtype="<i8").tobytes())
            for x in levels:
                f.write(x.tobytes())
                f.write(b"\0" * (-x.nbytes % 8))

    @classmethod
    def mapped(cls, path: str) -> Trie:
        """The trie of a file, its levels mapped into memory."""
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = raw[: 13 * 8].view("<i8")
        at, levels = 13 * 8, []
        for i, size in enumerate(sizes.tolist()):
            kind = np.uint16 if i == 12 else (np.int64 if i % 4 in (0, 3) else np.uint64)
            levels.append(raw[at : at + size].view(kind))
            at += size + (-size % 8)
        parts = [EliasFano(int(levels[k][0]), int(levels[k][1]), levels[k + 1], levels[k + 2], levels[k + 3]) for k in (0, 4, 8)]
        return cls(*parts, levels[12])
