"""Conversation repair by generalised LR parsing with weighted edits.

``GRAMMAR`` says which role initials make a conversation. Its LR(0) states, with reductions allowed where the next initial
can follow, are built from the productions. A row may be kept, deleted or given another role, and turns may be inserted; all
ways are followed at once on a graph of stacks: stacks with equal tails share them, and of the ways that reach equal
stacks only the least (cost, audit) is kept. The audit is the edits' initials in order, so ties go to the ASCII-least one.

* An insert right before a delete is never followed: the delete first costs the same and is less.
* Any stack can go on as any other one does for at most ``SLACK`` more, so ways that cost more than that above the
  cheapest are left. Edits on which all remaining ways agree are written at once; rows wait only while ways differ.

Rows of a conversation are read in order of turn (nulls first), then role, then text. A row's first fault counts: blank,
duplicate (role and text seen earlier in the conversation), truncated.

Defined cases: a null role or text is one space (so such a text is blank and such a role must change). Null turns come
first and count in no gap; repeated rows are duplicates; rows with a null conv_id are one conversation; a conversation
whose rows are all absent is empty and needs no edit; an empty table gives no rows; other columns are ignored. One
conversation is read in one stream, as the digest of its whole text demands; duplicates are found and rows sorted by
Spark, which spills.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch

# C: a conversation; L: a list of pairs; P: a pair; s, u, a: role initials
GRAMMAR = (("C", ""), ("C", "L"), ("C", "sL"), ("L", "P"), ("L", "LP"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
# the dearest change of stacks: two inserted turns
SLACK = 10
AGREE_EVERY = 64

SPACE = " \t\n\x0b\x0c\r"
_END = "$"


class Parser:
    """The LR automaton of ``GRAMMAR`` over shared stacks; a stack is the number of an interned (state, stack below)."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("S", grammar[0][0]), *grammar)
        self.heads = {head for head, _ in self.rules}
        self.terminals = {x for _, body in self.rules for x in body} - self.heads
        self._follow = self._follows()
        self._goto: dict[tuple[frozenset, str], frozenset] = {}
        self._stacks: list[tuple[frozenset, int]] = []
        self._numbers: dict[tuple[frozenset, int], int] = {}
        self.start = self._push(self._closure({(0, 0)}), -1)

    def _follows(self) -> dict[str, set]:
        empty: set[str] = set()
        first: dict[str, set] = {head: set() for head in self.heads}
        follow: dict[str, set] = {head: set() for head in self.heads}
        follow["S"].add(_END)
        while True:
            before = (len(empty), *map(len, first.values()), *map(len, follow.values()))
            for head, body in self.rules:
                if all(x in empty for x in body):
                    empty.add(head)
                for x in body:
                    first[head] |= first.get(x, {x})
                    if x not in empty:
                        break
                after = set(follow[head])
                for x in reversed(body):
                    if x in self.heads:
                        follow[x] |= after
                        after = after | first[x] if x in empty else set(first[x])
                    else:
                        after = {x}
            if before == (len(empty), *map(len, first.values()), *map(len, follow.values())):
                return follow

    def _closure(self, items) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            if dot < len(body):
                new = {(k, 0) for k, (head, _) in enumerate(self.rules) if head == body[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def _next(self, state: frozenset, symbol: str) -> frozenset:
        if (state, symbol) not in self._goto:
            self._goto[state, symbol] = self._closure({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == symbol})
        return self._goto[state, symbol]

    def _push(self, state: frozenset, below: int) -> int:
        key = (state, below)
        if key not in self._numbers:
            self._numbers[key] = len(self._stacks)
            self._stacks.append(key)
        return self._numbers[key]

    def _reduced(self, stack: int, ahead: str) -> list[int]:
        """``stack`` and all that reductions make of it before ``ahead``."""
        found, todo = [stack], [stack]
        while todo:
            top = todo.pop()
            for rule, dot in self._stacks[top][0]:
                head, body = self.rules[rule]
                if rule and dot == len(body) and ahead in self._follow[head]:
                    below = top
                    for _ in body:
                        below = self._stacks[below][1]
                    new = self._push(self._next(self._stacks[below][0], head), below)
                    if new not in found:
                        found.append(new)
                        todo.append(new)
        return found

    @functools.lru_cache(maxsize=None)  # noqa: B019 - one parser per worker
    def shift(self, stack: int, terminal: str) -> tuple[int, ...]:
        """The stacks after reading ``terminal``; a top with nothing but one finished rule is reduced at once."""
        out = []
        if terminal not in self.terminals:
            return ()
        for top in self._reduced(stack, terminal):
            state = self._next(self._stacks[top][0], terminal)
            if state:
                new = self._push(state, top)
                while len(items := self._stacks[new][0]) == 1 and (rule := next(iter(items)))[1] == len(self.rules[rule[0]][1]):
                    below = new
                    for _ in self.rules[rule[0]][1]:
                        below = self._stacks[below][1]
                    new = self._push(self._next(self._stacks[below][0], self.rules[rule[0]][0]), below)
                out.append(new)
        return tuple(out)

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def accepts(self, stack: int) -> bool:
        return any((0, 1) in self._stacks[top][0] for top in self._reduced(stack, _END))

    def missing(self, stack: int) -> tuple[str, int]:
        """The turn that a rerole or an insert gives at ``stack``, and the stack after it."""
        for initial in ROLES:
            if after := self.shift(stack, initial):
                return initial, after[0]
        raise ValueError("no turn fits")


@functools.lru_cache(maxsize=1)
def parser() -> Parser:
    return Parser()


def fault(text: str, seen: bool) -> str | None:
    ink = text.rstrip(SPACE)
    if not ink:
        return "blank"
    return "duplicate" if seen else "truncated" if ink[-1] not in ".!?" else None


class Repair:
    """Reads the rows of one conversation and gives edits (action, row, role) as soon as they are certain."""

    def __init__(self):
        self.lr = parser()
        self.ways: dict[int, tuple[int, str]] = {self.lr.start: (0, "")}
        self.deletes = 0  # of rows that must go, not yet in the audits
        self.rows: deque = deque()
        self.at = self.lr.start  # the stack after the edits given so far

    @staticmethod
    def _least(ways: dict, stack: int, way: tuple[int, str]) -> bool:
        if stack in ways and ways[stack] <= way:
            return False
        ways[stack] = way
        return True

    def _with_inserts(self) -> dict[int, tuple[int, str]]:
        ways, todo = dict(self.ways), list(self.ways)
        while todo:
            stack = todo.pop()
            cost, audit = ways[stack]
            for initial in ROLES:
                for after in self.lr.shift(stack, initial):
                    if self._least(ways, after, (cost + COSTS["I"], audit + "I")):
                        todo.append(after)
        return ways

    def _settle(self) -> None:
        if self.deletes:
            run, cost = "D" * self.deletes, COSTS["D"] * self.deletes
            self.ways = {stack: (c + cost, audit + run) for stack, (c, audit) in self.ways.items()}
            self.deletes = 0

    def add(self, row, role: str, found: str | None):
        self.rows.append(row)
        if found in ("blank", "duplicate"):
            self.deletes += 1
            return
        self._settle()
        extra = TRUNCATED if found == "truncated" else 0
        new: dict[int, tuple[int, str]] = {}
        for stack, (cost, audit) in self.ways.items():
            self._least(new, stack, (cost + COSTS["D"], audit + "D"))
        own = role[:1]
        for stack, (cost, audit) in self._with_inserts().items():
            for initial in {own, *ROLES}:
                edit = "K" if initial == own else "R"
                for after in self.lr.shift(stack, initial):
                    self._least(new, after, (cost + COSTS[edit] + extra, audit + edit))
        limit = min(cost for cost, _ in new.values()) + SLACK
        self.ways = {stack: way for stack, way in new.items() if way[0] <= limit}
        if len(self.rows) >= AGREE_EVERY and len(self.rows) % AGREE_EVERY == 0:
            agreed = len(os.path.commonprefix([audit for _, audit in self.ways.values()]))
            yield from self._give(next(iter(self.ways.values()))[1][:agreed])
            self.ways = {stack: (cost, audit[agreed:]) for stack, (cost, audit) in self.ways.items()}

    def _give(self, audit: str):
        for edit in audit:
            row = None if edit == "I" else self.rows.popleft()
            role = None
            if edit in "IR":
                initial, self.at = self.lr.missing(self.at)
                role = ROLES[initial]
            elif edit == "K":
                self.at = self.lr.shift(self.at, row[1][:1])[0]
            yield edit, row, role

    def end(self):
        self._settle()
        done = [way for stack, way in self._with_inserts().items() if self.lr.accepts(stack)]
        yield from self._give(min(done)[1])


EDITS = "step long, action string, turn long, role string, text string, fault string, illegal boolean, cost long"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
_NAMES = ("step", "action", "turn", "role", "text", "fault", "illegal", "cost")


def _repair(batches):
    """Edits of conversations whose rows arrive in order; a conversation begins with a row without an action."""
    conv, started, repair, step, last = None, False, None, 0, None
    out: list[tuple] = []

    def put(edits):
        nonlocal step
        for action, row, role in edits:
            step += 1
            if action == "I":
                out.append((conv, step, action, None, role, "", None, None, COSTS["I"]))
            else:
                turn, own, text, found, illegal = row
                extra = TRUNCATED if found == "truncated" and action != "D" else 0
                out.append((conv, step, action, turn, role or own, text, found, illegal, COSTS[action] + extra))

    def flush(kind):
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *_KINDS), strict=True)], names=["conv_id", *_NAMES])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for who, turn, role, text, seen, absent in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "absent")), strict=True):
            if not started or who != conv:
                if started:
                    put(repair.end())
                conv, started, repair, step, last = who, True, Repair(), 0, None
                out.append((conv, 0, None, None, None, None, None, None, 0))
            if absent:
                continue
            found = fault(text, seen)
            put(repair.add((turn, role, text, found, last is not None and last + role[:1] not in LEGAL), role, found))
            last = role[:1]
            if len(out) >= 4096:
                yield flush(kind)
        if out:
            yield flush(kind)
    if started:
        put(repair.end())
        if out:
            yield flush(kind)


def repair(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """Edits of (conv_id, turn, role, text): conv_id, step, action (K, R, D, I), turn, role, text, fault, illegal, cost.

    Step 0 of every conversation has no action. Rows where ``absent`` holds only name their conversation. ``illegal``
    says that a row's role can't follow the one before; role and text are those after the edit (of a deleted row, its own).
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *own, F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"))
    first = Window.partitionBy("conv_id", "role", "text", "absent").orderBy("turn")
    marked = rows.repartition("conv_id").withColumn("seen", F.row_number().over(first) > 1)
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text", "seen").select("conv_id", "turn", "role", "text", "seen", "absent")
    return ordered.mapInArrow(_repair, f"conv_id {kind}, {EDITS}")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.any = conv, [], hashlib.sha256(), False
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = None

    def add(self, action, turn, role, text, found, illegal, cost) -> None:
        if action is None:
            return
        self.audit.append(action)
        self.cost += cost
        self.illegal += bool(illegal)
        if found:
            self.count[found] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if action != "D":
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digest(batches):
    kind, reading, done = None, None, []

    def flush():
        kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", *re.findall(r"(\w+) \w+", DIGEST)])
        done.clear()
        return out

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for who, step, *edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *_NAMES)), strict=True):
            if step == 0:
                if reading is not None:
                    done.append(reading.row())
                reading = _Digest(who)
            reading.add(*edit)
        if done:
            yield flush()
    if reading is not None:
        done.append(reading.row())
        yield flush()


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: faults, cost, audit and the digest of the repaired conversation."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "step").select("conv_id", *_NAMES)
    return ordered.mapInArrow(_digest, f"conv_id {kind}, {DIGEST}")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent): rows damaged by the crc32 of ``conv_id:turn``, nulls as one space."""
    some = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.crc32(F.concat(some["conv_id"], F.lit(":"), some["turn"]).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(some["text"], "[.!?]", "")).otherwise(some["text"])
    role = F.when(code == 4, F.lit("user")).otherwise(some["role"])
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("absent"), F.when(code == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_time", F.explode(F.expr("sequence(1, _times)"))).drop("_times", "_time")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation of (conv_id, turn, role, text) after damage and repair."""
    scratch = Scratch(conversations.sparkSession, "repair")
    return digest(scratch.table(repair(damage(conversations), F.col("absent")), "edits"))


# The same repair as a search over four states (empty, s, u, a): each the least (cost, audit, text) per row, inserts first.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT for c in string_split({0}, '')]),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

ORACLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS words,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations
), coded AS (SELECT *, {_CRC.format("place")} % 20 AS code FROM given),
hurt AS (
  SELECT k, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(words, '[.!?]', '', 'g') ELSE words END AS words,
    unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, words) AS n,
    regexp_replace(words, '[\\x20\\x09-\\x0D]', '', 'g') AS ink FROM hurt
), judged AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, words ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(ink, '[.!?]$') THEN 'truncated' END AS fault,
    lag(role) OVER (PARTITION BY k ORDER BY n) AS earlier FROM numbered
), walk AS (
  SELECT DISTINCT k, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS s,
    {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS u, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS a FROM given
  UNION ALL
  SELECT k, n, {{'c': e.c + 2, 'a': e.a || 'D', 't': e.t}},
    CASE WHEN must OR i <> 's' THEN {{'c': s.c + 2, 'a': s.a || 'D', 't': s.t}}
      ELSE least({{'c': s.c + 2, 'a': s.a || 'D', 't': s.t}}, {{'c': e.c + extra, 'a': e.a || 'K', 't': e.t || line}}) END,
    CASE WHEN must THEN {{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}}
      ELSE least({{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}}, {{'c': p.c + extra + CASE WHEN i = 'u' THEN 0 ELSE 1 END, 'a': p.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END,
        't': p.t || CASE WHEN i = 'u' THEN line ELSE chr(10) || 'user:' || words END}}) END,
    CASE WHEN must THEN {{'c': a.c + 2, 'a': a.a || 'D', 't': a.t}}
      ELSE least({{'c': a.c + 2, 'a': a.a || 'D', 't': a.t}}, {{'c': q.c + extra + CASE WHEN i = 'a' THEN 0 ELSE 1 END, 'a': q.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END,
        't': q.t || CASE WHEN i = 'a' THEN line ELSE chr(10) || 'assistant:' || words END}}) END
  FROM (
    SELECT *, least(e, s, {{'c': m.c, 'a': m.a, 't': m.t}}) AS p FROM (
      SELECT *, least(a, {{'c': q.c + 5, 'a': q.a || 'I', 't': q.t || chr(10) || 'assistant:'}}) AS m FROM (
        SELECT w.k, j.n, w.e, w.s, w.u, w.a, j.words, left(j.role, 1) AS i, chr(10) || j.role || ':' || j.words AS line,
          coalesce(j.fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END AS extra,
          least(w.u, {{'c': least(w.e, w.s, w.a).c + 5, 'a': least(w.e, w.s, w.a).a || 'I', 't': least(w.e, w.s, w.a).t || chr(10) || 'user:'}}) AS q
        FROM walk w JOIN judged j ON j.k = w.k AND j.n = w.n + 1))) x
), last AS (
  SELECT k, least(e, a, {{'c': q.c + 5, 'a': q.a || 'I', 't': q.t || chr(10) || 'assistant:'}}) AS best FROM (
    SELECT *, least(u, {{'c': least(e, s, a).c + 5, 'a': least(e, s, a).a || 'I', 't': least(e, s, a).t || chr(10) || 'user:'}}) AS q
    FROM walk WHERE n = (SELECT count(*) FROM judged WHERE judged.k = walk.k))
), counted AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY k
)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM given) g JOIN last USING (k) LEFT JOIN counted USING (k)
"""
