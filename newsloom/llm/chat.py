"""Conversations as formatted text segments with loss flags, and back.

``TEMPLATE`` states per role how a turn begins and ends and whether its text is under the loss; any other role is
written out between ``[ROLE]``, ``[TEXT]`` and ``[/ROLE]``. A state machine over roles validates the order of turns
(``ORDER``): a conversation is valid if every turn's role may follow the one before and it ends with an assistant.
A control string inside a text gets a backslash after its first character, a backslash is doubled, so no text can
look like markup and every text comes back as it was.

Rows of a conversation are read in order of turn (then role, then text) in one stream, one at a time, so memory
does not grow with a conversation. Segments are written as a table, and everything returned is parsed from it.
Defined cases: null text is the empty text, a null role the empty role; repeated rows are turns of their own; null
turns come first; rows with a null conv_id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import Scratch

# role: (before the text, after the text, under the loss)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
ANY = ("[ROLE]", "[TEXT]", "[/ROLE]")
# role before (None: the start): roles that may follow
ORDER = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}

CONTROLS = tuple(x for before, after, _ in TEMPLATE.values() for x in (before, after)) + ANY
_CONTROL = re.compile("|".join(re.escape(x) for x in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_LONGEST = max(map(len, CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """A turn's text segments, each with its loss flag."""
    if role in TEMPLATE:
        before, after, loss = TEMPLATE[role]
        return [(before, False), (escape(text), loss), (after, False)]
    return [(ANY[0], False), (escape(role), False), (ANY[1], False), (escape(text), False), (ANY[2], False)]


class Turns:
    """Parses formatted text as it comes and gives complete turns (role, text)."""

    _BEGIN = {before: (role, after) for role, (before, after, _) in TEMPLATE.items()}

    def __init__(self):
        self.parts: list[str] = []
        self.role: str | None = None
        self.until: str | None = None  # the control string that ends what is being read
        self.rest = ""

    def feed(self, piece: str):
        buffer, at = self.rest + piece, 0
        while m := _CONTROL.search(buffer, at):
            self.parts.append(buffer[at : m.start()])
            at, control = m.end(), m[0]
            held, self.parts = "".join(self.parts), []
            if self.until is None:
                if held:
                    raise ValueError("text outside a turn")
                self.role, self.until = (None, ANY[1]) if control == ANY[0] else self._BEGIN[control]
            elif control != self.until:
                raise ValueError("a control string inside a turn")
            elif control == ANY[1]:
                self.role, self.until = unescape(held), ANY[2]
            else:
                yield self.role, unescape(held)
                self.role = self.until = None
        # a control string may continue in the next piece
        keep = max(at, len(buffer) - _LONGEST + 1)
        self.parts.append(buffer[at:keep])
        self.rest = buffer[keep:]

    def end(self) -> None:
        if self.until is not None or self.rest or any(self.parts):
            raise ValueError("an unfinished turn")


def _format(batches):
    """Segments of conversations that arrive in order."""
    conv, number, last, started = None, 0, None, False
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for who, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not started or who != conv:
                conv, number, last, started = who, 0, None, True
            role = role or ""
            fits = role in ORDER.get(last, ())
            for k, (piece, loss) in enumerate(segments(role, text or "")):
                for column, x in zip(out, (who, number * 5 + k, piece, loss, fits), strict=True):
                    column.append(x)
            last, number = role, number + 1
        kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["conv_id", "segment", "text", "loss", "in_order"])


class _Reading:
    def __init__(self, conv):
        self.conv, self.turns, self.parser = conv, 0, Turns()
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0
        self.valid, self.last = True, None

    def add(self, piece: str, loss: bool, in_order: bool) -> None:
        self.chars += len(piece)
        self.valid &= in_order
        if loss:
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        for role, text in self.parser.feed(piece):
            self.turns += 1
            self.last = role
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        self.parser.end()
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last == "assistant"


def _read(batches):
    kind, reading = None, None
    done: list[tuple] = []

    def flush():
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for who, piece, loss, in_order in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "in_order")), strict=True):
            if reading is None or who != reading.conv:
                if reading is not None:
                    done.append(reading.row())
                reading = _Reading(who)
            reading.add(piece, loss, in_order)
        if done:
            yield flush()
            done = []
    if reading is not None:
        done.append(reading.row())
        yield flush()


def format_turns(conversations: DataFrame) -> DataFrame:
    """Segments of (conv_id, turn, role, text): conv_id, segment, text, loss, in_order."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format, f"conv_id {kind}, segment long, text string, loss boolean, in_order boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its segments."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def round_trip(conversations: DataFrame) -> DataFrame:
    scratch = Scratch(conversations.sparkSession, "chat")
    return read_back(scratch.table(format_turns(conversations), "segments"))
