"""Periodic runs of words by a harmonic grid over each text.

A run of period q that repeats at least four times covers, for its smallest multiple jq of
q, the words from jq up to (j + 3)q. So for each period p the grid pairs jp and (j + 1)p are
asked how far their words agree onward and back (longest common extensions), and every run
shows at one of them. Extensions are minima of neighbouring common prefixes between two
places of a suffix array; those backward are the same on the reversed words. Pairs whose
words already differ within the next 2p words at a few probed places can't be in such a
run and are not asked, and texts without a pair left need no suffix array. Texts are
sorted together up to a number of words, each behind a separator of its own, so that no
extension leaves its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shortest run in words, and how often its period fits at least.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words of texts that share a suffix array; a longer text has one of its own.
TOGETHER = 1 << 16
#: Grid pairs that are held at once.
PAIRS = 1 << 20
#: Entries of a block of common prefixes; minima over whole blocks come from a sparse table.
RMQ_BLOCK = 16


class Extensions:
    """Longest common extensions of words (numbers) between two different places.

    The last word must be found nowhere else. Suffixes are sorted by prefix doubling; the
    ranks of each round, from the longest down, give the common prefixes of neighbours.
    """

    def __init__(self, words: np.ndarray) -> None:
        n, levels, width = len(words), [], 1
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
        while True:
            levels.append(rank.astype(np.int32))
            if int(rank.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            width *= 2
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n, np.int64)  # of each suffix in order and the one before it
        for k in range(len(levels) - 2, -1, -1):
            same = np.flatnonzero(levels[k][a] == levels[k][b])
            common[same + 1] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        blocks = np.full(-(-n // RMQ_BLOCK) * RMQ_BLOCK, n, np.int64)
        blocks[:n] = common
        self.common, by_block = blocks, blocks.reshape(-1, RMQ_BLOCK)
        self.before = np.minimum.accumulate(by_block, 1).ravel()
        self.behind = np.minimum.accumulate(by_block[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [by_block.min(1)]
        while 2 << len(self.table) - 1 <= len(by_block):
            last, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of places how many words from there on agree."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        first, last = low // RMQ_BLOCK, high // RMQ_BLOCK
        out = np.minimum(self.behind[low], self.before[high])
        gap = last - first - 1
        far = np.flatnonzero(gap > 0)
        level = np.log2(gap[far]).astype(np.int64)
        for k in np.unique(level):
            at = far[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.table[k][first[at] + 1], self.table[k][last[at] - (1 << k)]))
        near = np.flatnonzero(gap < 0)
        if len(near):
            out[near] = self.common[low[near]]
            for k in range(1, RMQ_BLOCK):
                at = low[near] + k
                out[near] = np.where(at <= high[near], np.minimum(out[near], self.common[np.minimum(at, high[near])]), out[near])
        return out


def _pairs(words: np.ndarray, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid pairs of a text that may be in a run."""
    n, starts, periods = len(words), [], []
    every = np.arange(1, n // least_exponent + 1)
    many = n // every - (least_exponent - 2)  # so that the next (least_exponent - 1) p words are in the text
    group = np.cumsum(many) // PAIRS
    for g in range(int(group[-1]) + 1 if len(group) else 0):
        p, k = every[group == g], many[group == g]
        first = np.cumsum(k) - k
        period = np.repeat(p, k)
        place = (np.arange(len(period)) - np.repeat(first, k)) * period
        for probe in (lambda p: 0 * p, lambda p: p, lambda p: 2 * p - 1, lambda p: p // 2, lambda p: p + p // 2, lambda p: p - 1, lambda p: p // 4):
            at = place + probe(period)
            kept = words[at] == words[at + period]
            place, period = place[kept], period[kept]
        starts.append(place)
        periods.append(period)
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64),) * 2


def _found(texts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], least_words: int, least_exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """number, runs (start, length, period) of texts (number, words, places, periods), with one suffix array for all."""
    sizes = np.array([len(w) for _, w, _, _ in texts])
    offsets = np.cumsum(sizes + 1) - sizes  # a separator stands before each text and one behind the last
    together = np.full(int(sizes.sum()) + len(sizes) + 1, -1, np.int64)
    for at, (_, words, _, _) in zip(offsets, texts, strict=True):
        together[at : at + len(words)] = words
    separators = np.flatnonzero(together < 0)
    together[separators] = -1 - np.arange(len(separators))
    of = np.repeat(np.arange(len(texts)), [len(p) for _, _, p, _ in texts])
    place, period = (np.concatenate([t[k] for t in texts]) for k in (2, 3))
    place = place + offsets[of]
    last = len(together) - 1
    onward = Extensions(together)(place, place + period)
    back = Extensions(together[::-1])(last - (place - 1), last - (place + period - 1))
    start, length = place - back, back + onward + period
    kept = length >= np.maximum(least_words, least_exponent * period)
    of, start, length, period = of[kept], start[kept] - offsets[of[kept]], length[kept], period[kept]
    order = np.lexsort((period, length, start, of))  # of equal stretches the smallest period stays
    of, start, length, period = (x[order] for x in (of, start, length, period))
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, runs = of[new], np.stack((start[new], length[new], period[new]), 1)
    for k, (number, _, _, _) in enumerate(texts):
        own = runs[np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
        yield number, own[np.lexsort((own[:, 2], own[:, 0]))]


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> dict[int, np.ndarray]:
    """The runs (start, length, period), by start and period, of those texts (arrays of word numbers >= 0) that have any."""
    if least_exponent < 4:
        raise ValueError("runs that repeat less than four times may lie between the grid pairs that are probed")
    out, held, size = {}, [], 0
    for number, words in enumerate(texts):
        places, periods = _pairs(words, least_exponent)
        if len(places):
            held.append((number, words, places, periods))
            size += len(words)
        if held and (size >= TOGETHER or number == len(texts) - 1):
            out |= dict(_found(held, least_words, least_exponent))
            held, size = [], 0
    if held:
        out |= dict(_found(held, least_words, least_exponent))
    return {k: v for k, v in out.items() if len(v)}


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _collapsed(words: pa.Array, ends: np.ndarray, runs: dict[int, np.ndarray]) -> pa.Array:
    """The texts' words, joined by a space, less those that a run repeats."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for number, found in runs.items():
        np.add.at(dropped, ends[number] + found[:, 0] + found[:, 2], 1)
        np.add.at(dropped, ends[number] + found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    new_ends = np.concatenate(([0], np.cumsum(kept)))[ends]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(new_ends, pa.int64()), words.filter(pa.array(kept))), " ")


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", words: str = "words", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed of each row of docs.

    words is an array of strings. A run is a stretch of words with smallest period q, of at
    least least_words and least_exponent * q words (an exponent of 4 or more), that no
    neighbouring word extends; runs are in order of start, then period, and start counts
    from 0. collapsed has the words joined by a space without those that some run holds
    behind its first q words.

    A null or empty array has no runs and collapses to the empty text; a null word is a word
    that equals other null words and is dropped from collapsed like an empty one. Repeated
    ids and rows are texts of their own; an empty table gives no rows; other columns are not
    read. A text is one task's work, in memory that grows with its words (some 200 bytes a
    word while it has runs); nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.transform(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit(""))).alias("words") if docs.schema[words].dataType.containsNull else F.col(words).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.slice(ends[0], ends[-1] - ends[0]) if len(ends) else lists.values
            ends = ends - ends[0]
            codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = runs_of([codes[a:b] for a, b in zip(ends, ends[1:], strict=False)], least_words, least_exponent)
            none = np.zeros((0, 3), np.int64)
            by_text = [runs.get(k, none) for k in range(len(batch))]
            of = np.concatenate(([0], np.cumsum([len(r) for r in by_text])))
            flat = np.concatenate([none, *by_text])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(of, pa.int32()), structs), _collapsed(values, ends, runs)], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, _SCHEMA)


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest exact length / period; ties go to the smallest start, then period. Null if there is none."""
    more = lambda a, b: F.when(F.isnull(a) | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.reduce(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), more)
