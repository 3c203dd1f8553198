"""Vectorised text helpers for Arrow batches: word bounds, hashes, shingles.

Words are runs of bytes other than space and 0x09..0x0D, with A-Z lowered; in UTF-8 that is the
pattern ``[^\\x20\\x09-\\x0D]+``. A word is known by a 64-bit hash. Long batches are cut into slices
of a few megabytes, so that memory follows the slice, not the batch; one text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 3 << 20
PIECE = 1 << 20
LONG_WORD = 1 << 16

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + LONG_WORD + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def utf8(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(arr) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the number of words before it."""
    n = len(data)
    if not n:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    ink = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:n]
    stop = ink
    stop[:-1] &= ~(ink[1:] & ~first[1:n])
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; spans are in order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    far = np.flatnonzero(lengths > LONG_WORD)
    for i in far:
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    edges = np.concatenate([[-1], far, [len(starts)]])
    for before, after in zip(edges[:-1], edges[1:], strict=True):
        at = int(before) + 1
        while at < after:
            to = min(max(int(np.searchsorted(starts, starts[at] + PIECE)), at + 1), int(after))
            low = starts[at]
            piece = data[low : ends[to - 1]]
            up, down = _power_tables(len(piece) + 1)
            total = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            h = (total[e] - total[s]) * down[s]
            out[at:to] = mix(h + lengths[at:to].astype(np.uint64) * _U(0xA0761D6478BD642F))
            at = to
    return out


def words(arr) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of words before each text."""
    data, offsets = utf8(arr)
    data = LOWER[data]
    starts, ends, before = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), before


_PLACE = mix(np.arange(1, 9, dtype=np.uint64) * _U(0x8BB84B93962EACC9)) | _U(1)


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the text of each, in text order.

    A text of fewer than ``size`` words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    parts, owners = [], []
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total += hashes[k : k + n] * _PLACE[k]
        whole = owner[:n] == owner[size - 1 :]
        parts.append(mix(total[whole]))
        owners.append(owner[:n][whole])
    for k in range(1, size):
        texts = np.flatnonzero(counts == k)
        if len(texts):
            total = np.full(len(texts), k, dtype=np.uint64)
            for j in range(k):
                total += hashes[before[texts] + j] * _PLACE[j]
            parts.append(mix(total))
            owners.append(texts)
    if not parts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    values, who = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return values[order], who[order]


def shingle_sets(arr, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, who = shingles(*words(arr), size)
    edges = np.searchsorted(who, np.arange(len(arr) + 1))
    return [np.unique(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def binary_column(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
