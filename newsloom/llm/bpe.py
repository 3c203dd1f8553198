"""Token ids of whole texts with the tokenizers library, each distinct chunk encoded once per worker.

A text is cut only where the tokenizer's own split pattern always ends a token: before a single space
between two other characters (byte level), at white space (word level), between an ASCII letter and ASCII
punctuation, and after a single line break. Ids of the chunks, joined, are the ids of the text. Chunks are
found and hashed in numpy; a worker keeps the ids of up to ``MOST`` chunks and then starts afresh.

The added tokens of the tokenizer's file count as the library counts them by default: each place where one stands in
a text is that token's id, so it is a chunk of its own, never cut.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from newsloom.llm.tokens import LOWER, SPACE, span_hashes, utf8, word_bounds

MOST = 2_000_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True  # no apostrophe: it may open a token with letters
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
_ADDED = np.uint64(0x6A09E667F3BCC909)  # keeps an added token's key apart from the same letters in ordinary text


class Encoder:
    """``kind`` byte: byte-level BPE that keeps white space; word: BPE that lowers case and drops white space."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("an added token that takes spaces, whole words or normalized text can't be found by its bytes")
        parts = sorted((t["content"].encode() for t in added), key=len, reverse=True)  # the longest of those that begin at one place
        self.added = re.compile(b"|".join(map(re.escape, parts))) if parts else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.first = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _find_added(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Start and end of each added token inside a text, in order."""
        found, at = [], 0
        while self.added and (m := self.added.search(raw, at)):
            border = int(off[np.searchsorted(off, m.start(), side="right")])
            if m.end() > border:  # no token runs across two texts, but a shorter one may end before the border
                m = self.added.search(raw, m.start(), border)
            if m:
                found.append(m.span())
            at = m.end() if m else border
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def _cuts(self, data: np.ndarray, off: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the chunks, and the chunks before each text."""
        n = len(data)
        cut = np.zeros(n, dtype=bool)
        if n > 1:
            cut[1:] = _LETTER[data[:-1]] & _PUNCT[data[1:]]
        if self.kind == "word":
            starts, ends, _ = word_bounds(data, off)
            inside = np.zeros(n, dtype=bool)
            inside[starts] = True
            cut |= inside
            cut &= ~SPACE[data]
            stop = np.zeros(n + 1, dtype=bool)
            stop[ends] = True
            for a, b in added.tolist():
                cut[a + 1 : b] = stop[a + 1 : b] = False
                cut[a] = stop[b] = True
                if b < n and not SPACE[data[b]]:
                    cut[b] = True
            starts = np.flatnonzero(cut)
            stop[starts] = True
            # a chunk ends at the next cut or at the end of its word
            marks = np.flatnonzero(stop)
            ends = marks[np.searchsorted(marks, starts, side="right")] if len(starts) else starts
        else:
            space = SPACE[data]
            if n > 2:
                cut[1:-1] |= (data[1:-1] == 32) & ~space[:-2] & ~space[2:]
                cut[2:] |= _LETTER[data[2:]] & (data[1:-1] == 10) & _VISIBLE[data[:-2]]
            heads = off[:-1][off[1:] > off[:-1]]
            tails = off[1:][off[1:] > off[:-1]] - 1
            # a space at the border of a text is no single space between two characters of it
            edge = np.concatenate([heads[data[heads] == 32], tails[data[tails] == 32]]) if n else heads
            cut[edge] = False
            second = heads + 1
            second = second[second < n]
            cut[second[_LETTER[data[second]] & (data[second - 1] == 10)]] = False
            cut[heads] = True
            for a, b in added.tolist():
                cut[a + 1 : b] = False
                cut[a] = True
                if b < n:
                    cut[b] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n) if len(starts) else starts
        return starts, ends, np.searchsorted(starts, off)

    def encode(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and the number of ids before each text."""
        data, off = utf8(arr)
        raw = data.tobytes()
        added = self._find_added(raw, off)
        if self.kind == "word":
            data = LOWER[data]
        starts, ends, before = self._cuts(data, off, added)
        hashes = span_hashes(data, starts, ends)
        hashes[np.searchsorted(starts, added[:, 0])] ^= _ADDED
        keys, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MOST:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        new = np.flatnonzero(fresh)
        if len(new):
            found: list[list[int]] = []
            for k in range(0, len(new), 2000):
                rows = example[new[k : k + 2000]]
                parts = [raw[a:b].decode() for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
                found += [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            count = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.array([i for x in found for i in x], dtype=np.uint32)
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, flat])
            place = at[new]
            self.keys = np.insert(self.keys, place, keys[new])
            self.first = np.insert(self.first, place, first)
            self.count = np.insert(self.count, place, count)
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][which]
        ends_of = np.cumsum(count)
        total = int(ends_of[-1]) if len(ends_of) else 0
        where = np.repeat(self.first[at][which] - (ends_of - count), count) + np.arange(total)
        return self.ids[where], np.concatenate([[0], ends_of])[before]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
