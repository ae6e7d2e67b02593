"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns come sorted by conversation and turn. The machine walks over the roles, judges the order, and emits the formatted
conversation as segments of text, each with a flag that says whether it counts in the loss. The template marks where turns
begin and end. In a text, every second character of a control string is escaped wherever it stands, so no control string
is left in a text, also not one that overlaps another, and reading back is exact.

Conversations are dealt out by id and walked in order, batch by batch. Memory is bounded by a batch, whatever the length
of a conversation; one conversation is walked by one task, as its digest can only be taken in order.

Defined cases: a null text or role is empty. Roles that the template does not name get a heading of their own and are out
of order. Rows with the same turn are ordered by role and text, nulls first; repeated rows are turns of their own. A null
conversation id is one conversation. Other columns are not read. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import arrow_schema, text_of

SEGMENTS = "conv_id bigint, turn_no bigint, text string, loss boolean, in_order boolean"
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "valid_order boolean"
)


@dataclass(frozen=True)
class Template:
    """``after`` has, for each state, the roles that may follow; a conversation begins in state ``""``."""

    opens: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: tuple[str, str] = ("### Role ", ": ")
    close: str = "</turn>\n"
    escape: str = "\\"
    control: tuple[str, ...] = ("###", "</turn>")
    loss: frozenset[str] = frozenset({"assistant"})
    after: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: frozenset[str] = frozenset({"assistant"})


def escaped(text: Column, t: Template = Template(), more: tuple[str, ...] = ()) -> Column:
    """The escape sign doubled, then put before whatever may be the second (or only) character of a control string."""
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for sign in sorted({mark[:2][-1] for mark in (*t.control, *more)}):
        text = F.replace(text, F.lit(sign), F.lit(t.escape + sign))
    return text


def unescaped(text: str, t: Template = Template()) -> str:
    return re.sub(f"(?s){re.escape(t.escape)}(.)", r"\1", text) if t.escape in text else text


def segments(turns: DataFrame, t: Template = Template(), **names: str) -> DataFrame:
    """The formatted conversations in ``SEGMENTS``: heading, text and end mark of each turn, in order.

    ``names`` renames the columns conv_id, turn, role and text. ``in_order`` says whether the machine could take the turn.
    Rows of a conversation follow each other in one partition.
    """
    at = {k: names.get(k, k) for k in ("conv_id", "turn", "role", "text")}
    role, text = text_of(at["role"]), text_of(at["text"])
    heading = F.concat(F.lit(t.other[0]), escaped(role, t, (t.other[1].strip(),)), F.lit(t.other[1]))
    for name, mark in t.opens.items():
        heading = F.when(role == name, F.lit(mark)).otherwise(heading)
    rows = turns.select(
        F.col(at["conv_id"]).cast("bigint").alias("conv_id"), F.col(at["turn"]).alias("turn"), role.alias("role"),
        heading.alias("heading"), escaped(text, t).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = arrow_schema(SEGMENTS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, n = object(), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, heading, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if conv != current:
                    current, state, n = conv, "", 0
                legal = role in t.after.get(state, ())
                out += [(conv, n, heading, False, legal), (conv, n, text, role in t.loss, legal), (conv, n, t.close, False, legal)]
                state, n = role, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)] if out else
                                             [pa.array([], k) for k in schema.types], schema=schema)

    return rows.mapInArrow(walk, SEGMENTS)


class Reader:
    """Reads one formatted conversation back, segment by segment; holds one turn at most."""

    def __init__(self, t: Template):
        self.t, self.rest, self.role = t, "", ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True
        mark, end = map(re.escape, t.other)
        sign = re.escape(t.escape)
        self.named = re.compile(f"(?s){mark}((?:[^{sign}{end[0] if end[0] != chr(92) else end[:2]}]|{sign}.)*+){end}")

    def take(self, text: str, loss: bool, legal: bool) -> None:
        self.chars += len(text)
        self.valid &= legal
        if loss:
            own = unescaped(text, self.t)
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        self.rest += text
        while (stop := self.rest.find(self.t.close)) >= 0:
            self.turn(self.rest[:stop])
            self.rest = self.rest[stop + len(self.t.close) :]

    def turn(self, text: str) -> None:
        for role, mark in self.t.opens.items():
            if text.startswith(mark):
                self.role, body = role, text[len(mark) :]
                break
        else:
            found = self.named.match(text)
            self.role, body = unescaped(found[1], self.t), text[found.end() :]
        self.n += 1
        self.turns.update(f"{self.role}\n{unescaped(body, self.t)}\n".encode())

    def result(self, conv: int | None) -> tuple:
        valid = self.valid and self.role in self.t.ends
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """One row of ``DIGESTS`` for each conversation of :func:`segments`, from the formatted text and its flags alone."""
    schema = arrow_schema(DIGESTS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, out = None, None, []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[] for _ in schema.types]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for conv, text, loss, legal in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if reader is None or conv != current:
                    if reader is not None:
                        out.append(reader.result(current))
                    current, reader = conv, Reader(t)
                reader.take(text, loss, legal)
            yield table()
            out = []
        if reader is not None:
            out.append(reader.result(current))
            yield table()

    return formatted.mapInArrow(walk, DIGESTS)
