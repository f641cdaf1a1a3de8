"""State that waits: changes that settle before they go out, and lines cut across chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a change waits, by what it was, in milliseconds.
FAST_MS, OPEN_MS = 300, 750
#: Fixed value: events that are kept of a stream.
KEPT = 200
#: Bytes that an unfinished line may have.
MOST_PENDING = 1 << 20


def debounced(changes: DataFrame, key: str, generation: str, document: str, delay_ms: str) -> DataFrame:
    """key, generation, document of each change after which nothing newer came for its delay.

    A newer generation of a key takes the place of the one that waits and starts the clock
    anew, with its own delay; one that is the same, older, or older than what went out last
    changes nothing. When the clock has run out the newest document goes out once. Time is
    processing time, so it runs on without input. document is a string; nulls are kept.
    Append mode.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, waiting, text, due = state.get if state.exists else (None, None, None, 0)
        if state.hasTimedOut:
            state.update((waiting, None, None, 0))
            yield pd.DataFrame({"key": [k[0]], "generation": [waiting], "document": [text]})
            return
        now = state.getCurrentProcessingTimeMs()
        for batch in batches:
            for g, document, ms in zip(batch["generation"].tolist(), batch["document"].tolist(), batch["delay"].tolist(), strict=True):
                if all(x is None or g > x for x in (sent, waiting)):
                    waiting, text, due = g, document, now + int(ms)
        state.update((sent, waiting, text, due))
        if waiting is not None:
            state.setTimeoutDuration(max(1, due - now))  # a call without it would stop the clock

    rows = changes.where(F.col(generation).isNotNull()).select(F.col(key).alias("key"), F.col(generation).cast("long").alias("generation"), F.col(document).cast("string").alias("document"), F.coalesce(F.col(delay_ms).cast("long"), F.lit(OPEN_MS)).alias("delay"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, generation long, document string", "sent long, waiting long, document string, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def split_lines(pending: bytes, chunk: bytes, last: bool) -> tuple[list[str], bytes]:
    """The lines that a chunk ends, and what is left of it for the next; the last chunk ends its line."""
    *lines, rest = (pending + chunk).split(b"\n")
    if last and rest:
        lines, rest = [*lines, rest], b""
    return [line.decode("utf-8", "replace").strip() for line in lines], rest


def event_lines(chunks: DataFrame, key: str, seq: str, chunk: str, last: str, kept: int = KEPT, most: int = MOST_PENDING) -> DataFrame:
    """key, total, dropped, truncated, failed, latest: the JSON events of each stream of chunks, the last of them kept.

    Chunks (binary, in order of seq, which must not fall from one micro-batch to the next)
    may cut lines and characters anywhere; the unfinished end waits in the state for the
    next one. last marks the end of a stream, which ends its line. Blank lines count for
    nothing, lines that aren't JSON objects are dropped and counted, and of all others total
    is the number and latest the last ones, oldest first. A line of more than most bytes
    fails its stream: failed is true and what follows is not read. Null chunks are empty.
    Update mode.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, total, dropped, failed, latest = state.get if state.exists else (b"", 0, 0, False, [])
        latest = list(latest)
        rows = sorted((row for b in batches for row in zip(b["seq"].tolist(), b["chunk"].tolist(), b["last"].tolist(), strict=True)), key=lambda r: r[0])
        for _, data, end in rows:
            if failed:
                break
            lines, pending = split_lines(pending, data or b"", bool(end))
            for line in filter(None, lines):
                try:
                    good = isinstance(json.loads(line), dict)
                except ValueError:
                    good = False
                total, dropped = total + good, dropped + (not good)
                latest = [*latest, line][-kept:] if good else latest
            failed = len(pending) > most
        state.update((b"" if failed else pending, total, dropped, failed, latest))
        yield pd.DataFrame({"key": [k[0]], "total": [total], "dropped": [dropped], "truncated": [total > len(latest)], "failed": [failed], "latest": [latest]})

    rows = chunks.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(chunk).cast("binary").alias("chunk"), F.coalesce(F.col(last), F.lit(False)).alias("last"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, total long, dropped long, truncated boolean, failed boolean, latest array<string>", "pending binary, total long, dropped long, failed boolean, latest array<string>", "update", GroupStateTimeout.NoTimeout)
