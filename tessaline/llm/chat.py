"""Chat formatting: event logs folded into final messages, then rendered with a loss mask.

A log has a row per event of a conversation, in order of seq:

- message: a whole message; msg may be null, then it is a message of its own
- delta: a piece that is added to message msg
- edit: a new text for message msg, which keeps its place
- regenerate: message msg is emptied and all messages after it go; deltas fill it anew

Logs are dealt out by conversation, sorted by seq and read as a stream, so a task holds
one conversation's messages at a time and never a whole partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What opens and closes a turn of each role; any other role is named in its opening.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("<|role:", "|> ", " <|end|>")
#: These never stand in an escaped text.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|role:", "|>", "<|end|>"]

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARK = re.compile(r"\\(\\?)")
_OPEN = re.compile(r"\[INST\] |<s> |<<SYS>> |<\|role:(.*?)\|> ", re.DOTALL)


def escape(text: str) -> str:
    r"""Doubles each backslash and puts a single one behind the first character of a control string.

    Control strings can overlap, so it is repeated until none is left; a control string has
    no backslash, so each round breaks what it finds for good.
    """
    text = text.replace("\\", "\\\\")
    while (broken := _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)) != text:
        text = broken
    return text


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text)


def render(messages: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans in it (escaped texts of assistant turns) that bear loss."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        role = role or ""
        opening, closing = TURNS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; a null role reads back as ''."""
    roles, turns, at = {v[0]: (k, v[1]) for k, v in TURNS.items()}, [], 0
    while at < len(formatted):
        opening = _OPEN.match(formatted, at)
        role, closing = roles.get(opening[0]) or (unescape(opening[1]), OTHER[2])
        end = formatted.index(closing, opening.end())
        turns.append((role, unescape(formatted[opening.end() : end])))
        at = end + len(closing)
    return turns


class Messages:
    """A conversation's messages as its events leave them, each event in constant time but for the messages that it takes away."""

    def __init__(self) -> None:
        self._order: list = []
        self._place: dict = {}

    def __iter__(self) -> Iterator[tuple[str | None, str]]:
        return ((role, "".join(pieces)) for _, role, pieces in self._order)

    def apply(self, seq: int | None, event: str | None, msg: int | None, role: str | None, text: str | None) -> None:
        text, at = text or "", self._place.get(msg) if msg is not None else None
        if event == "edit" and at is not None:
            self._order[at][2] = [text]
        elif event == "delta" and at is not None:
            self._order[at][2].append(text)
        elif event == "regenerate" and at is not None:
            while len(self._order) > at + 1:
                self._place.pop(self._order.pop()[0], None)
            self._order[at][1:] = [role if role is not None else self._order[at][1], [text]]
        elif at is not None:
            self._order[at][1:] = [role, [text]]
        else:
            if msg is not None:
                self._place[msg] = len(self._order)
            self._order.append([msg, role, [text]])


_SCHEMA = "conv_id long, formatted string, loss array<struct<start: long, end: long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[str, list] = {"conv_id": [], "formatted": [], "loss": []}
    chars, now, messages = 0, object(), None

    def close() -> int:
        formatted, mask = render(list(messages))
        for column, value in zip(done.values(), (now, formatted, [{"start": a, "end": b} for a, b in mask]), strict=True):
            column.append(value)
        return len(formatted)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "seq", "event", "msg", "role", "text")]
        for conv, *event in zip(*columns, strict=True):
            if conv != now:
                if messages:
                    chars += close()
                now, messages = conv, Messages()
                if chars > 4_000_000:
                    yield pa.RecordBatch.from_pydict(done, schema=_ARROW)
                    done, chars = {c: [] for c in done}, 0
            messages.apply(*event)
    if messages:
        close()
    yield pa.RecordBatch.from_pydict(done, schema=_ARROW)


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of code points in formatted, end exclusive) of each conversation.

    events: conv_id long, seq long, event, msg (null or long), role, text; other columns are
    not read. Events of one seq are ordered by event, role and text. A null conv_id is a
    conversation of its own; a null text is empty; a null or unknown event is a message; an
    edit or delta of a message that isn't there starts it. Repeated message rows without
    msg are messages each. No events give no rows.

    One conversation is formatted by one task, as its text is one value; its rows are
    streamed and only its messages are held.
    """
    order = ["conv_id", "seq", "event", "msg", "role", "text"]
    rows = events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("event").cast("string"), F.col("msg").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_conversations, _SCHEMA)


def turns_as_events(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): a message each."""
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"), F.lit(None).cast("long").alias("msg"), "role", "text")


def turns_as_log(turns: DataFrame) -> DataFrame:
    """A log of which format_log() makes the turns (conv_id, turn, role, text), as a chat client would write it.

    An assistant's turn is begun, generated anew and streamed in two deltas; any other is
    sent as a draft and edited. Turns are in the order of turn (null first), then role and
    text, and each has a message of its own, repeated rows too.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    event = lambda no, name, piece: F.struct(F.lit(no).alias("no"), F.lit(name).alias("event"), piece.alias("piece"))
    streamed = F.array(event(0, "message", F.lit("")), event(1, "delta", F.reverse(text)), event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", F.substring(text, F.lit(1), half)), event(4, "delta", F.substr(text, half + 1)))
    drafted = F.array(event(0, "message", F.reverse(text)), event(1, "edit", text))
    rows = turns.select("conv_id", "role", place.alias("msg"), text.alias("text")).select("conv_id", "role", "msg", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(drafted)).alias("e"))
    return rows.select("conv_id", (F.col("msg") * 8 + F.col("e.no")).alias("seq"), "e.event", "msg", "role", F.col("e.piece").alias("text"))
