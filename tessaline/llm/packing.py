"""Vector bin packing of tokenised texts into training sequences.

Each task tokenises its rows, cuts off whole sequences and packs what is left under three
limits at once: tokens, segments and tokens that bear loss. The next piece for a sequence
is the one with the largest dot product of its demands and what the sequence has left.
Nothing is shuffled: a task holds one batch and the pieces it carries over.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
MAX_SEGMENTS = 64
END = 1
#: Chunks of text whose ids a worker remembers.
REMEMBERED = 600_000
#: A piece is cut to fill a sequence up only where at least so many tokens are left.
LEAST_CUT = 16


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    ranks, if given, is a tiktoken file of the same vocabulary, which is several times
    faster. The pattern of both starts a new token at a single space that something other
    than white space follows, so texts are cut at spaces and the ids of each chunk are
    remembered up to a bound. Other texts, and those with the end-of-text string, are
    encoded whole.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._known, self._special = Tokenizer.from_file(path), {}, None
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import tiktoken

            pairs = (line.split() for line in open(ranks, "rb"))  # noqa: SIM115
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._fast or any(s in text for s in self._special):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self._known
        try:
            ids = b"".join([known[x] for x in rest])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for x in rest:
                if x not in known:
                    if not x or x[0].isspace():
                        return array("I", self._fast(text)).tobytes()
                    known[x] = array("I", self._fast(f" {x}")).tobytes()
            ids = b"".join([known[x] for x in rest])
        return array("I", self._fast(first)).tobytes() + ids


@cache
def _ids(path: str, ranks: str | None) -> Ids:
    """The worker's own, kept from task to task."""
    return Ids(path, ranks)


class Packer:
    """Packs pieces (doc, start, end) of documents (doc_id, ids, loss_from) into sequences.

    Tokens of a document from loss_from on bear loss.
    """

    def __init__(self, length: int, max_segments: int, max_loss: int) -> None:
        self.limits = np.array([length, max_segments, max_loss], float)
        self.docs: dict[int, tuple] = {}
        self.open: list[tuple[int, int, int]] = []

    def _loss(self, doc: int, start: int, end: int) -> int:
        return max(0, end - max(start, self.docs[doc][2]))

    def _cut(self, doc: int, start: int, tokens: float, loss: float) -> int:
        """Where a piece from start must end to stay within so many tokens and loss tokens."""
        return int(min(start + tokens, max(start, self.docs[doc][2]) + loss))

    def add(self, doc: int, value: tuple) -> Iterator[list[tuple[int, int, int]]]:
        """Takes a document up and yields the sequences that it fills by itself."""
        self.docs[doc] = value
        start, end = 0, len(value[1]) // 4
        while end - start >= self.limits[0] or self._loss(doc, start, end) > self.limits[2]:
            yield [(doc, start, middle := self._cut(doc, start, self.limits[0], self.limits[2]))]
            start = middle
        if start < end:
            self.open.append((doc, start, end))

    def fill(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Yields sequences of the open pieces; unless it is the last call, those with room stay open."""
        pieces = self.open
        demands = np.array([(e - s, 1, self._loss(d, s, e)) for d, s, e in pieces], float).reshape(-1, 3)
        free, self.open = np.ones(len(pieces), bool), []
        while free.any():
            room, taken = self.limits.copy(), []
            while free.any():
                fits = free & (demands <= room).all(1)
                if fits.any():
                    best = int(np.where(fits, demands @ (room / self.limits**2), -1.0).argmax())
                    taken.append(pieces[best])
                    room -= demands[best]
                    free[best] = False
                elif room[0] >= LEAST_CUT and room[1] >= 1 and room[2] >= 1:
                    best = int(np.where(free, demands[:, 0], -1.0).argmax())
                    doc, start, end = pieces[best]
                    middle = self._cut(doc, start, room[0], room[2])
                    taken.append((doc, start, middle))
                    room -= (middle - start, 1, self._loss(doc, start, middle))
                    pieces[best] = (doc, middle, end)
                    demands[best] = (end - middle, 1, self._loss(doc, middle, end))
                else:
                    break
            if room[0] < LEAST_CUT:
                yield taken
            elif last or free.any() or room[1] < 1 or room[2] < 1:  # another limit closes it
                yield from _powers_of_two(taken)
            else:
                self.open += taken
        held = {doc for doc, _, _ in self.open}
        self.docs = {k: v for k, v in self.docs.items() if k in held}


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces in sequences whose lengths are powers of two, which need no padding."""
    left = sum(end - start for _, start, end in pieces)
    while left:
        size, taken = 1 << left.bit_length() - 1, []
        left -= size
        while size:
            doc, start, end = pieces[0]
            middle = min(end, start + size)
            taken.append((doc, start, middle))
            size -= middle - start
            pieces = ([] if middle == end else [(doc, middle, end)]) + pieces[1:]
        yield taken


_FIELDS = ("doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset")
_ARROW = pa.schema([(f, pa.binary() if f == "ids" else pa.int64()) for f in _FIELDS])
_SCHEMA = ", ".join(f"`{f}` {'binary' if f == 'ids' else 'long'}" for f in _FIELDS)
#: Documents that are packed together, besides the pieces carried over.
WINDOW = 512


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset.

    A document's ids are those of its prompt, if a column is named, then of its text, then
    END; those of the prompt bear no loss. ids are little-endian unsigned 32-bit numbers.
    Each id lies in one piece. Sequences hold at most length tokens, max_segments pieces
    and max_loss tokens that bear loss (all of them unless given). Cuts fall anywhere. The last
    sequence of a task and one that another limit than length closes are split into powers
    of two, which need no padding.

    A null text or prompt is empty, so its document is END alone. Repeated ids and rows are packed each.
    An empty table gives no rows. sequence_id is unique and holds the task's number; other
    columns are not read. tokenizer is the path of a tokenizers file on every
    worker, ranks that of the same vocabulary for tiktoken, which gives the same ids sooner.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = _ids(tokenizer, ranks), Packer(length, max_segments, max_loss or length)
        end, sequence, number = np.array([END], "<u4").tobytes(), TaskContext.get().partitionId() << 40, 0
        out: list[tuple] = []

        def emit(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, stop in pieces:
                key, data, _ = packer.docs[doc]
                out.append((key, start, stop - start, data[4 * start : 4 * stop], len(data) // 4, packer._loss(doc, start, stop), sequence, at))
                at += stop - start
            sequence += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(dict(zip(_FIELDS, zip(*out, strict=True), strict=True)) if out else {f: [] for f in _FIELDS}, schema=_ARROW)
            out.clear()
            return batch

        for batch in batches:
            for key, text, before in zip(*(batch.column(c) for c in ("doc_id", "text", "prompt")), strict=True):
                head = ids(before.as_py()) if before.as_py() else b""
                for pieces in packer.add(number, (key.as_py(), head + ids(text.as_py()) + end, len(head) // 4)):
                    emit(pieces)
                number += 1
                if number % WINDOW == 0:
                    for pieces in packer.fill(last=False):
                        emit(pieces)
                    yield flush()
        for pieces in packer.fill(last=True):
            emit(pieces)
        yield flush()

    return rows.mapInArrow(run, _SCHEMA)
