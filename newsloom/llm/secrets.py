"""Secrets by fixed patterns and by automata inferred from what the patterns found.

The patterns (assign, access, hex) find labelled credentials in all texts. A bounded sample of their distinct values (``SAMPLE``
of each kind, the smallest hashes) trains one probabilistic automaton a kind: a prefix tree over character classes whose
states are merged where their outgoing and ending frequencies agree within the Hoeffding bound; steps not seen in a state
fall back to the classes' overall shares. What is left of a text's runs of credential characters after the patterns' spans
are taken out, from ``LEAST`` characters (the least that a pattern labels), are candidates, and all are scored.

A further automaton is inferred from ordinary tokens: of the ``ORDINARY`` distinct candidates with the smallest hashes, counted
over all texts, those that stand in ``RECURRING`` texts or more, and of the others those that no credential automaton takes
for its own format (as long as labelled values are, and a mean log-likelihood not below theirs by ``OUTSIDE`` standard deviations). So
unlabelled credentials, even if most tokens are such, don't teach what is ordinary. Its likelihood is averaged with that of
a chain over the same tokens that knows only the class before, for forms too rare to have states. A candidate becomes a span of kind
``format`` if the credential automata's mean likelihood is at least ``1 / FALSE_ALARMS`` times the ordinary one's: by Markov's
inequality at most a share ``FALSE_ALARMS`` of tokens of the ordinary model exceed that.

Positions are code points, end exclusive. Defined cases: null or empty text has no spans; without labelled credentials
or ordinary tokens no span is added; values of more than ``LONGEST`` characters teach nothing, but are found and scored like
others; repeated rows give repeated results; null ids stay; an empty table gives no rows; ``scan`` ignores other columns,
``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch, ship
from newsloom.llm.tokens import slices, span_hashes, utf8

# The patterns and least lengths of the base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_OF = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEAST = min(LEAST_OF.values())
SAMPLE = 400
ORDINARY = 20000
TAUGHT = 3000
RECURRING = 3
LONGEST = 200
FALSE_ALARMS = 1e-6
OUTSIDE = 4.0
CONFIDENCE = 0.05
BACKOFF = 1.0
TOGETHER = 32

_MARKS = "+/_.=-"
_IN_TOKEN = np.zeros(256, dtype=bool)
_HEX = np.zeros(256, dtype=bool)
_CLASS = np.zeros(256, dtype=np.int64)
CLASSES = ["0", "a", "g", "A", "G", *_MARKS]
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + _MARKS:
    _IN_TOKEN[ord(_c)] = True
    _HEX[ord(_c)] = _c in "0123456789abcdef"


def symbol(c: str) -> str:
    """Character class: digit, hexadecimal letter, other letter by case; anything else is itself."""
    if c.isdigit():
        return "0"
    if c.isalpha():
        return ("a" if c in "abcdef" else "g") if c.islower() else ("A" if c in "ABCDEF" else "G")
    return c


for _c in np.flatnonzero(_IN_TOKEN):
    _CLASS[_c] = CLASSES.index(symbol(chr(_c)))


class Automaton:
    """A probabilistic automaton inferred by state merging."""

    def __init__(self, samples: list[str], confidence: float = CONFIDENCE):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for word in samples:
            state = 0
            for c in map(symbol, word):
                self.visits[state] += 1
                self.seen[state][c] = self.seen[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    for column, empty in ((self.next, {}), (self.seen, {}), (self.ends, 0), (self.visits, 0)):
                        column.append(empty)
                state = self.next[state][c]
            self.visits[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / confidence))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            n1, n2 = self.visits[x], self.visits[y]
            if not n1 or not n2 or x == y:
                continue
            if self._differ(self.ends[x], n1, self.ends[y], n2):
                return False
            for c in self.seen[x].keys() | self.seen[y].keys():
                if self._differ(self.seen[x].get(c, 0), n1, self.seen[y].get(c, 0), n2):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    stack.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add tree state ``b`` and what hangs below it to state ``a``."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for c, n in self.seen[y].items():
                self.seen[x][c] = self.seen[x].get(c, 0) + n
                if c in self.next[x]:
                    stack.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def _infer(self) -> None:
        settled = [0]
        while True:
            known = set(settled)
            open_ = sorted({(-self.visits[t], t, s, c) for s in settled for c, t in self.next[s].items() if t not in known})
            if not open_:
                break
            _, state, source, c = open_[0]
            for target in settled:
                if self._compatible(target, state):
                    self.next[source][c] = target
                    self._fold(target, state)
                    break
            else:
                settled.append(state)
        self.states = len(settled)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log-probability per state and class, and the log-probability of ending; unknown steps go to the start."""
        n = len(self.next)
        to, step, stop = np.zeros((n, len(CLASSES)), dtype=np.int64), np.zeros((n, len(CLASSES))), np.zeros(n)
        overall = np.ones(len(CLASSES) + 1)
        live, todo = {0}, [0]
        while todo:
            state = todo.pop()
            for c, target in self.next[state].items():
                to[state, CLASSES.index(c)] = target
                if target not in live:
                    live.add(target)
                    todo.append(target)
            for c, k in self.seen[state].items():
                overall[CLASSES.index(c)] += k
                step[state, CLASSES.index(c)] = k
            overall[-1] += self.ends[state]
        overall /= overall.sum()
        visits = np.array(self.visits, dtype=np.float64)[:, None] + BACKOFF
        step = np.log((step + BACKOFF * overall[:-1]) / visits)
        stop = np.log((np.array(self.ends, dtype=np.float64) + BACKOFF * overall[-1]) / visits[:, 0])
        return to, step, stop


def chain(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the automaton that only knows the class before; state 0 is the start."""
    n = len(CLASSES)
    counts = np.full((n + 1, n + 1), 0.5 / (n + 1))
    for word in words:
        places = [0, *(CLASSES.index(symbol(c)) + 1 for c in word)]
        for a, b in zip(places, [*places[1:], 0], strict=True):
            counts[a, b - 1] += 1  # the last column is the end
    counts = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.tile(np.arange(1, n + 1), (n + 1, 1)), counts[:, :n], counts[:, n]


def mean_likelihood(models: list[tuple], classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log of the models' mean likelihood of each span."""
    each = np.stack([likelihoods(t, classes, starts, ends) for t in models])
    best = each.max(axis=0)
    return best + np.log(np.exp(each - best).mean(axis=0))


def likelihoods(tables: tuple[np.ndarray, np.ndarray, np.ndarray], classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-likelihood of each span of ``classes``: all spans step together, the last long ones one by one."""
    to, step, stop = tables
    order = np.argsort(starts - ends, kind="stable")
    at, lengths = starts[order], (ends - starts)[order]
    state, total = np.zeros(len(at), dtype=np.int64), np.zeros(len(at))
    k, active = 0, len(at)
    while active >= TOGETHER or (active and lengths[0] - k < 4 * TOGETHER):
        c = classes[at[:active] + k]
        total[:active] += step[state[:active], c]
        state[:active] = to[state[:active], c]
        k += 1
        active = int(np.searchsorted(-lengths, -k, side="left"))
    if active:
        next_, gain = to.tolist(), step.tolist()
        for i in range(active):
            s, t = int(state[i]), float(total[i])
            for c in classes[at[i] + k : at[i] + lengths[i]].tolist():
                t += gain[s][c]
                s = next_[s][c]
            state[i], total[i] = s, t
    out = np.empty(len(at))
    out[order] = total + stop[state]
    return out


def score_words(tables, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word."""
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return likelihoods(tables, _CLASS[data], np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the patterns' matches."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(name in low for name in NAMES):
            found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_OF["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_OF["access"]]
    return found


def hex_spans(text: str) -> list[tuple[int, int, int, int]]:
    return [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_OF["hex"]]


def runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the runs of ``mask`` that are ``least`` long; a run ends where its text does."""
    inside = np.zeros(len(mask) + 2, dtype=np.int8)
    inside[1:-1] = mask
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    borders = np.unique(off[1:-1])
    cut = borders[(np.searchsorted(starts, borders, side="left") > np.searchsorted(ends, borders, side="right"))] if len(starts) else borders[:0]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    far = ends - starts >= least
    starts, ends = starts[far], ends[far]
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


class Candidates:
    """Base spans and candidates of a slice of texts."""

    def __init__(self, column):
        data, off = utf8(column)
        texts = column.to_pylist()
        hexes = set(runs(_HEX[data], off, LEAST_OF["hex"])[2].tolist())
        mask = _IN_TOKEN[data]
        self.texts, self.base = texts, []
        for i, text in enumerate(texts):
            found = base_spans(text) if text else []
            if i in hexes:
                found += hex_spans(text)
            self.base.append(sorted(found))
            for start, _, end, _ in found:
                low = int(off[i]) + len(text[:start].encode())
                mask[low : low + len(text[start:end].encode())] = False
        self.data, self.off = data, off
        self.starts, self.ends, self.owner = runs(mask, off, LEAST)

    def place(self, k: int) -> tuple[int, int]:
        """Candidate ``k`` in code points of its text."""
        low = int(self.off[self.owner[k]])
        a = len(self.data[low : self.starts[k]].tobytes().decode("utf-8", "replace"))
        return a, a + int(self.ends[k] - self.starts[k])


def _labelled(batches):
    """(kind, value) of labelled credentials, distinct per slice."""
    for batch in slices(batches):
        found = Candidates(batch.column("text"))
        rows = sorted({(kind, text[value:end]) for text, base in zip(found.texts, found.base, strict=True) for _, kind, end, value in base if end - value <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["kind", "value"])


def _ordinary(batches):
    """(hash, token, texts) of the ``ORDINARY`` distinct candidates of the partition with the smallest hashes; texts: in how many they stand."""
    held: dict[int, list] = {}
    bound = np.uint64(0xFFFFFFFFFFFFFFFF)
    for batch in slices(batches):
        found = Candidates(batch.column("text"))
        short = np.flatnonzero(found.ends - found.starts <= LONGEST)
        hashes = span_hashes(found.data, found.starts, found.ends)[short]
        low = hashes <= bound
        short, hashes = short[low], hashes[low]
        each = np.unique(np.stack([hashes, found.owner[short].astype(np.uint64)], axis=1), axis=0)
        keys, n = np.unique(each[:, 0], return_counts=True)
        where = short[np.unique(hashes, return_index=True)[1]]
        for key, count, k in zip(keys[:ORDINARY].tolist(), n[:ORDINARY].tolist(), where[:ORDINARY].tolist(), strict=True):
            if key in held:
                held[key][1] += count
            else:
                held[key] = [found.data[found.starts[k] : found.ends[k]].tobytes().decode(), count]
        if len(held) > ORDINARY:
            for key in sorted(held)[ORDINARY:]:
                del held[key]
            bound = np.uint64(max(held))
    kept = sorted(held)
    bound = kept[-1] - (1 << 63) if len(kept) == ORDINARY else (1 << 63) - 1  # up to here the partition has given all it holds
    yield pa.RecordBatch.from_arrays(
        [pa.array([k - (1 << 63) for k in kept], pa.int64()), pa.array([held[k][0] for k in kept], pa.string()), pa.array([held[k][1] for k in kept], pa.int64()), pa.array([bound] * len(kept), pa.int64())],
        names=["hash", "token", "texts", "bound"],
    )


def _smallest(scratch: Scratch, rows: DataFrame) -> list:
    """The ``ORDINARY`` tokens of all texts with the smallest hashes, with their numbers of texts.

    Hashes are even, so how many lie below the least bound of the partitions tells where the smallest end; little more than
    those comes to the driver, however many partitions there are.
    """
    parts = scratch.table(rows.mapInArrow(_ordinary, "hash long, token string, texts long, bound long"), "tokens")
    bound = parts.agg(F.min("bound")).first()[0]
    if bound is None:
        return []
    whole = scratch.table(parts.where(F.col("hash") <= bound).groupBy("hash", "token").agg(F.sum("texts").alias("texts")), "counted")
    scratch.drop(parts)
    n, width = whole.count(), bound + (1 << 63)
    cut = bound if n <= 2 * ORDINARY else int(width * 1.5 * ORDINARY / n) - (1 << 63)
    if whole.where(F.col("hash") <= cut).count() < min(n, ORDINARY):
        cut = bound
    return whole.where(F.col("hash") <= cut).orderBy("hash", "token").limit(ORDINARY).collect()


def infer(docs: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Tables of the credential kinds' automata, and of those of ordinary tokens, from all texts."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col("text").cast("string").alias("text"))
    values = scratch.table(rows.mapInArrow(_labelled, "kind int, value string").distinct(), "values")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    sample = values.withColumn("k", F.row_number().over(order)).where(f"k <= {SAMPLE}").select("kind", "value").collect()  # 3 * SAMPLE short values
    by: dict[int, list[str]] = {}
    for r in sorted(sample):
        by.setdefault(r.kind, []).append(r.value)
    formats = [(Automaton(by[k]).tables(), by[k]) for k in sorted(by)]
    if not formats:
        return [], []
    tokens = _smallest(scratch, rows)  # short ones
    often = [r.token for r in tokens if r.texts >= RECURRING]
    once = [r.token for r in tokens if r.texts < RECURRING]
    for tables, own in formats:
        if once:
            lengths = [np.array([len(w) + 1 for w in words]) for words in (own, once)]
            known, tried = (score_words(tables, words) / n for words, n in zip((own, once), lengths, strict=True))
            low = known.mean() - OUTSIDE * max(known.std(), 0.05)
            once = [w for w, x, n in zip(once, tried, lengths[1], strict=True) if x < low or not lengths[0].min() <= n <= lengths[0].max()]
    taught = often[:TAUGHT] + once[:TAUGHT]
    return [tables for tables, _ in formats], [Automaton(taught).tables(), chain(taught)] if taught else []


def added(found: Candidates, formats: list[tuple], ordinary: list[tuple]) -> np.ndarray:
    """The candidates that are spans."""
    if not formats or not ordinary or not len(found.starts):
        return np.empty(0, dtype=np.int64)
    spans = _CLASS[found.data], found.starts, found.ends
    return np.flatnonzero(mean_likelihood(formats, *spans) - mean_likelihood(ordinary, *spans) >= -math.log(FALSE_ALARMS))


def _said(rows) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def _all_spans(column, formats, ordinary) -> tuple[list[list], list[list]]:
    """Per text the base spans and all spans (start, kind, end), sorted."""
    found = Candidates(column)
    base = [[(s, k, e) for s, k, e, _ in spans] for spans in found.base]
    every = [list(spans) for spans in base]
    for k in added(found, formats, ordinary).tolist():
        a, b = found.place(k)
        every[found.owner[k]].append((a, 3, b))
    return base, [sorted(spans) for spans in every]


def _scan(formats, ordinary):
    def scan(batches):
        for batch in slices(batches):
            base, every = _all_spans(batch.column("text"), formats, ordinary)
            counts = [[sum(x[1] == k for x in spans) for spans in base] for k in range(3)]
            digests = [hashlib.sha256(_said(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(list(map(_said, every)), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return scan


def _redact(formats, ordinary):
    def redact(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(_all_spans(batch.column("text"), formats, ordinary)[1]):
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if b > at:
                            if a >= at:
                                parts += [texts[i][at:a], MASK]
                            at = b
                    texts[i] = "".join(parts) + texts[i][at:]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return redact


MASK = "[SECRET]"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(*infer(rows)), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``MASK``; all rows and columns stay."""
    return docs.mapInArrow(_redact(*infer(docs)), docs.schema)
