"""The prefix trie against a plain one built from whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, weight string, place long"


def _rows(seed):
    rng = random.Random(seed)
    out = []
    for conv in [*range(0, 40), *range(100, 160), -7, -5, -3, -1, 1003]:
        for turn in range(rng.choice([0, 1, 2, 2, 3, 5, 9, 12])):
            out.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "bé", None, "", "日本"])))
    out += [(200, None, "user", "a"), (200, None, "user", "a"), (200, 5, "user", "b"), (None, 1, "user", "a"), (300, 1, None, None)]
    out += [(c, t, "user", "same") for c in (410, 415, 420, 425) for t in range(3)]  # copies
    out += [(500, t, "user", f"t{t % 3}") for t in range(1300)] + [(600, 0, "user", "wörter " * 50000)]
    short = next(c for c in range(1004, 5000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    return [*out, (short, 0, "user", "gone")]


def _plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(rs)] for c, rs in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        stem = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = tuple(turns.get(stem, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (min(members[n]), len(n), min(members[n[:-1]]) if n else -(10**9), len(members[n]), len(children[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if rebuilt[c] == n))).encode()).hexdigest())
        for n in members
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_trie(spark, seed):
    rows = _rows(seed)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = prefix_trie.rebuilt_trie(table).select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-(10**9))), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect())) == _plain(rows)


def test_parts_of_end_lists_and_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    monkeypatch.setattr(prefix_trie, "IDS_PER_PART", 7)
    rows = _rows(3)
    got = prefix_trie.rebuilt_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    got = got.select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-(10**9))), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect())) == _plain(rows)
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
