"""Repair against trying all edits, and against a plain search from the end."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, step int, action string, cost string, seen int"
SHAPE = re.compile(r"(s?(ua)+)?")


def _fault(rows):
    out = []
    for k, (role, text) in enumerate(rows):
        ink = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in rows[:k] else "truncated" if ink[-1] not in ".!?" else None)
    return out


def _all_edits(rows):
    """The least (cost, audit) over every way with at most three inserts at a place."""
    faults, best = _fault(rows), None
    inserts = ["".join(x) for n in range(4) for x in itertools.product("ua", repeat=n)]
    per_row = []
    for (role, _), found in zip(rows, faults, strict=True):
        extra = 5 if found == "truncated" else 0
        per_row.append([(2, "D", "")] + ([] if found in ("blank", "duplicate") else [(extra, "K", role[:1] or "-"), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    for ways in itertools.product(*per_row):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            shape = "".join(a + w[2] for a, w in zip(added, [*ways, (0, "", "")], strict=True))
            if SHAPE.fullmatch(shape):
                cost = sum(w[0] for w in ways) + 5 * sum(map(len, added))
                audit = "".join("I" * len(a) + w[1] for a, w in zip(added, [*ways, (0, "", "")], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def _plain(rows):
    """The least (cost, audit) by a search from the end over four states."""
    faults = _fault(rows)
    sys.setrecursionlimit(20000)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            for t in "ua":
                if t in after[state]:
                    found.append((best(i, after[state][t], inserted + 1), 5, "I"))
        if i < len(rows):
            found.append((best(i + 1, state, 0), 2, "D"))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] else 0
                for t in {rows[i][0][:1], "u", "a"}:
                    if t in after[state]:
                        for edit in {"K" if t == rows[i][0][:1] else "R"}:
                            found.append((best(i + 1, after[state][t], 0), extra + (edit == "R"), edit))
        found = [f if len(f) == 2 else (f[0][0] + f[1], f[2] + f[0][1]) for f in found if len(f) == 2 or f[0]]
        return min(found) if found else None

    return best(0, "", 0)


def _run(rows):
    steps = repair.Repair()
    out = []
    for (role, text), found in zip(rows, _fault(rows), strict=True):
        out += steps.add((None, role, text, found, False), role, found)
    out += steps.end()
    audit = "".join(edit for edit, _, _ in out)
    cost = sum(repair.COSTS[e] + (5 if e != "D" and row and row[3] == "truncated" else 0) for e, row, _ in out)
    turns = [(role or row[1], "" if row is None else row[2]) for e, row, role in out if e != "D"]
    assert SHAPE.fullmatch("".join(role[:1] for role, _ in turns))
    assert [row[2] for _, row, _ in out if row] == [text for _, text in rows]
    return cost, audit


def _random(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "", " ", "usher", "Lead", "Court", "$"]), rng.choice(["one.", "two!", "three", "", " ", "four?", f"n{rng.random()}.", f"n{rng.random()}."])) for _ in range(n)]


def test_equals_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 2, 3, 3):
        for _ in range(1 if n < 1 else 12 if n < 3 else 4):
            rows = _random(rng, n)
            assert _run(rows) == _all_edits(rows) == _plain(rows), rows


def test_equals_a_plain_search():
    rng = random.Random(2)
    for n in [*range(1, 40)] * 12 + [150, 200]:
        rows = _random(rng, n)
        assert _run(rows) == _plain(rows), rows
    # long runs on which ways differ for long
    for rows in ([("user", f"{k}") for k in range(300)], [("user", "a.")] * 300, [("assistant", f"{k}.") for k in range(200)] + [("system", "x")] * 100):
        assert _run(rows) == _plain(rows)


def test_a_long_conversation_waits_for_nothing():
    steps = repair.Repair()
    given = 0
    for k in range(20000):
        role = ("user", "assistant")[k % 2] if k % 97 else "user"
        given += sum(1 for _ in steps.add((k, role, f"{k}.", None, False), role, None))
    assert len(steps.rows) < 200 and given > 19000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for conv in range(60):
        for k in range(rng.randint(1, 9)):
            out.append((conv, k * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a b.", "c d!", "e", None, "", "\t", f"t{k}."])))
    out += [(70, None, "user", "a."), (70, None, "user", "a."), (70, 3, "assistant", "b."), (71, None, None, None), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, None, "system", "z.")]
    out += [(72, 5, "user", "same."), (72, 5, "assistant", "same."), (72, 5, "assistant", "same."), (73, 1, "user", "long " * 100000 + "."), (73, 2, "assistant", "ok.")]
    alone = [next(t for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0) for c in (80, 81)]
    return out + [(80, alone[0], "user", "gone."), (81, alone[1], None, None)]


def _expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(key.encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        convs.setdefault(conv, []).extend([(turn is not None, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in found if r[0]]
        pairs = [r[2:] for r in found]
        faults = _fault(pairs)
        cost, audit = _plain(pairs)
        left, state, done = list(pairs), "", []
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            done.append(f"{role}:{text}")
            state = role[0]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def test_repair_damaged(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5)
    got = repair.repair_damaged(table).collect()
    want = _expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r
    assert {r.conv_id for r in got if r.audit == ""} >= {80, 81}
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    edits = repair.repair(table).where("action is not null")
    assert edits.where("action <> 'I'").count() == len(rows)
    assert edits.where("action = 'I' and (text <> '' or role not in ('user', 'assistant'))").isEmpty()
    assert edits.groupBy("conv_id").agg(F.sum("cost")).count() == len({r[0] for r in rows})
