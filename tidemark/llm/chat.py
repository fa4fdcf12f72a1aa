"""Chat formatting by a finite-state machine over roles.

A declarative template names the marks around a turn, the roles that bear loss and the turns
that may follow each other. Conversations are dealt out by id, sorted by turn and streamed
through the machine, which emits text segments: the opening mark with the role, the escaped
text, the closing mark. Each segment has a loss flag; only texts of loss roles have it set.
The machine also judges the turn order; ill-ordered conversations are formatted all the same
and marked with the first error.

Escaping is reversible: ``<|`` never occurs in an escaped text, because every run of
backslashes between ``<`` and ``|`` (none included) gets one more, which reading takes away.
Line ends and backslashes inside roles are escaped too.

Memory holds one turn at a time, so a conversation may have any number of turns.

Defined results: null texts and roles count as empty; turns with the same number are ordered by
role, then text; a null turn comes last; rows with a null id form one conversation; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChatTemplate:
    """Marks must have the form ``<|name|>``."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: Turns that may follow a state; the state before the first turn is "".
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    finals: frozenset[str] = frozenset({"assistant"})


CHATML = ChatTemplate()

_HIDE = re.compile(r"<(\\*)\|")
_SHOW = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _HIDE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of so many rows, or of fewer when their texts are long."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or weight > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def format_conversations(df: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """(conv_id, place, segment, loss, error): the segments of each conversation, in order within their partition.

    The last segment of a conversation carries the first error of its turn order, if any.
    """
    turns = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    key = turns.schema["conv_id"]
    schema = T.StructType(
        [key, T.StructField("place", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("error", T.StringType())]
    )

    def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
        nothing = object()
        current, state, place, error, last = nothing, "", 0, None, None

        def finish() -> tuple:
            return (*last, error or (None if state in template.finals else f"ends after {state or 'nothing'}"))

        for conv, _, role, text in rows:
            if conv != current:
                if last is not None:
                    yield finish()
                current, state, place, error, last = conv, "", 0, None, None
            elif last is not None:
                yield (*last, None)
            if error is None and role not in template.follows.get(state, ()):
                error = f"{role or 'no role'} after {state or 'nothing'}"
            state = role
            yield conv, place, template.start + _escape_role(role) + template.after_role, False, None
            yield conv, place + 1, escape(text), role in template.loss_roles, None
            last = (conv, place + 2, template.end + template.after_turn, False)
            place += 3
        if last is not None:
            yield finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out = pa.schema([(key.name, first.schema.field(0).type), ("place", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("error", pa.string())])

        def rows() -> Iterator[tuple]:
            yield from _rows(iter([first]))
            yield from _rows(batches)

        yield from _batches(segments(rows()), out)

    return turns.mapInArrow(run, schema)


def read_back(segments: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Digests of each conversation, parsed from the segments in the order they were emitted.

    Only the formatted text and the loss flags are used: marks split the text into turns, and
    escaped texts are turned back.
    """
    key = segments.schema["conv_id"]
    schema = T.StructType(
        [
            key,
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )
    marks = re.compile(f"({re.escape(template.start)}|{re.escape(template.end)})")

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        nothing = object()
        current, state = nothing, "outside"
        n_turns = loss_chars = chars = 0
        turns, loss, error, role = hashlib.sha256(), hashlib.sha256(), None, ""
        for conv, _, segment, flag, problem in rows:
            if conv != current:
                if current is not nothing:
                    yield current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, error
                current, state, n_turns, loss_chars, chars, error, role = conv, "outside", 0, 0, 0, None, ""
                turns, loss = hashlib.sha256(), hashlib.sha256()
            chars += len(segment)
            error = error or problem
            for part in marks.split(segment):
                if part == template.start:
                    state, role, n_turns = "role", "", n_turns + 1
                elif part == template.end:
                    turns.update(b"\n")
                    state = "outside"
                elif state == "role":
                    role += part
                    if template.after_role in role:
                        name, _, part = role.partition(template.after_role)
                        turns.update(_unescape_role(name).encode() + b"\n")
                        state = "text"
                if state == "text" and part != template.start and part:
                    shown = unescape(part)
                    turns.update(shown.encode())
                    if flag:
                        loss.update(shown.encode())
                        loss_chars += len(shown)
        if current is not nothing:
            yield current, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        out = pa.schema([(key.name, first.schema.field(0).type), *zip(schema.names[1:], kinds)])

        def rows() -> Iterator[tuple]:
            yield from _rows(iter([first]))
            yield from _rows(batches)

        yield from _batches(digests(rows()), out)

    return segments.mapInArrow(run, schema).withColumn("valid", F.col("error").isNull())
