"""Chat formatting: a state machine over roles, and a declarative template that marks turns.

``TEMPLATE`` says what stands before and after a text of each role and whether the text bears loss; ``TURNS`` is the state machine.
Rows of a conversation are taken in order of turn (ties: role, then text; nulls first). Each row becomes segments: mark,
text, mark. Control strings inside texts are broken by a backslash after their first character and backslashes are doubled, so
a control string in the output is always a mark and ``read_turns`` gets every text back.

A task streams through its rows in order and holds one turn and the state of one conversation at a time; a conversation of any
length passes through in constant memory (one task has to read it, because the digests that are made of it are sequential).

Defined results: null text is empty; a null or unknown role is written with its name in the ``other`` mark (null as empty), bears
no loss and is out of turn; a null conv_id is a conversation of its own; repeated rows are turns of their own; an empty table
gives no segment. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role: (mark before, mark after, loss on the text). {role} holds the name of a role that has no entry.
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s> ", " </s>", True),
    "other": ("[ROLE] {role} [TEXT] ", " [/ROLE]", False),
}
#: state: {role: next state}. A role that is missing is out of turn; the machine then goes on as after that role.
TURNS = {
    "start": {"system": "asked for a user", "user": "asked"},
    "asked for a user": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
AFTER = {"system": "asked for a user", "user": "asked", "assistant": "answered"}
FINAL = ("answered",)

Segment = tuple[str, bool]


class Template:
    """Writes turns as segments and reads them back."""

    def __init__(self, marks: dict[str, tuple[str, str, bool]]):
        self.marks = marks
        spans = [part for before, after, _ in marks.values() for part in (*before.split("{role}"), after)]
        self.controls = sorted({x.strip() for x in spans if x.strip()}, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, ["\\", *self.controls])))
        self._escaped = re.compile(r"\\(\\|(?=.))", re.S)

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[1], text)

    def segments(self, role: str | None, text: str | None) -> list[Segment]:
        before, after, loss = self.marks[role if role in self.marks and role != "other" else "other"]
        return [(before.replace("{role}", self.escape(role or "")), False), (self.escape(text or ""), loss), (after, False)]

    def read(self, segments: list[Segment]) -> tuple[str, str, bool]:
        """(role, text, loss) of one turn's segments."""
        opening, (text, loss) = segments[0][0], segments[1]
        for role, (before, _, _) in self.marks.items():
            if role != "other" and opening == before:
                return role, self.unescape(text), loss
        left, right = self.marks["other"][0].split("{role}")
        return self.unescape(opening[len(left) : len(opening) - len(right)]), self.unescape(text), loss


def _ordered(conversations: DataFrame, columns: list[str]) -> DataFrame:
    rows = conversations.select(*[F.col(c).alias(a) for c, a in zip(columns, ("conv_id", "turn", "role", "text"))])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _values(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(c).to_pylist() for c in names))


def _batch(rows: list[tuple], like: pa.RecordBatch, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows that begin with the conversation's id, of the type that it has in ``like``."""
    kinds = {"conv_id": like.schema.field("conv_id").type, **kinds}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def format_turns(
    conversations: DataFrame, template: dict = TEMPLATE, turns: dict = TURNS, columns: list[str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """(conv_id, turn_no, segment, text, loss, state, in_turn): three segments a turn, in order within each partition.

    ``state`` is that of the machine after the turn, ``in_turn`` false where the role was not due.
    """
    marks = Template(template)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n = object(), "start", 0
        for batch in batches:
            out = []
            for own, role, text in _values(batch, "conv_id", "role", "text"):
                if own != conv:
                    conv, state, n = own, "start", 0
                due = turns[state].get(role)
                state = due or AFTER.get(role, state)
                for k, (piece, loss) in enumerate(marks.segments(role, text)):
                    out.append((own, n, k, piece, loss, state, due is not None))
                n += 1
            yield _batch(out, batch, {"turn_no": pa.int64(), "segment": pa.int32(), "text": pa.string(), "loss": pa.bool_(), "state": pa.string(), "in_turn": pa.bool_()})

    kind = conversations.schema[columns[0]].dataType.simpleString()
    schema = f"conv_id {kind}, turn_no long, segment int, text string, loss boolean, state string, in_turn boolean"
    return _ordered(conversations, list(columns)).mapInArrow(write, schema)


def read_turns(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """A row per conversation, read back from ``format_turns``: counts, digests of turns and of the text under the loss mask.

    ``valid`` tells that every turn was due and the last state is final.
    """
    marks = Template(template)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, turn = object(), None, []
        for batch in batches:
            out = []
            last = batch
            for own, text, loss, state, in_turn in _values(batch, "conv_id", "text", "loss", "state", "in_turn"):
                if open_ is None or own != conv:
                    if open_ is not None:
                        out.append(open_.row())
                    conv, open_ = own, _Digest(own)
                open_.chars += len(text)
                turn.append((text, bool(loss)))
                if len(turn) == 3:
                    open_.add(*marks.read(turn), in_turn, state)
                    turn = []
            yield _batch(out, batch, _Digest.COLUMNS)
        if open_ is not None:
            yield _batch([open_.row()], last, _Digest.COLUMNS)

    kind = segments.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return segments.mapInArrow(digest, schema)


class _Digest:
    COLUMNS = {
        "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_(),
    }

    def __init__(self, conv):
        self.conv, self.n, self.loss_chars, self.chars, self.valid, self.state = conv, 0, 0, 0, True, None
        self.turns, self.losses = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, loss: bool, in_turn: bool, state: str) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.valid, self.state = self.valid and bool(in_turn), state
        if loss:
            self.loss_chars += len(text)
            self.losses.update(text.encode())

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.losses.hexdigest(), self.chars, self.valid and self.state in FINAL)
