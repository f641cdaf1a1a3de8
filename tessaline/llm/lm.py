"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of words and word pairs are quantised to a logarithmic scale; an entry of level q
is put into the filter q times, each time with its level. Reading a count means probing
level after level until a probe fails. The filter is cut into shards by hash, each built by
one task from its own entries, with bits in proportion to them: no entry stays out. Shards
are broadcast together up to PART_BYTES; a larger filter is broadcast part after part, with
a pass over the texts for each, and what is read so far is kept as a byte for each token.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline import storage

#: Levels go up by this factor of the count.
BASE = 1.5
PROBES = 4
BITS_PER_INSERT = 8
#: Bytes of the filter that are broadcast at once (one shard at least).
PART_BYTES = 64 << 20
SHARD_BITS = 12
#: The words whose exact counts are broadcast, the most frequent ones; others are joined.
HEAD = 1 << 18
#: Words of a context's count that the word's own probability is worth.
PRIOR = 2.0
ADDED = 0.1
HELD_OUT = 10
SEED = 42
#: Counts that a task holds before it adds them up.
COUNTS = 1 << 22
#: Texts tokenised together.
TOGETHER = 1000

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ONE = np.uint64(1)
#: The end token; no word hashes the empty string.
_END = np.uint64(xxhash.xxh64_intdigest(b"", SEED)) & ~_ONE


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, end tokens included, and how many each has. The lowest bit is 0."""
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        sizes[i] = len(words) + 1
        hashed = np.full(len(words) + 1, _END, np.uint64)
        hashed[:-1] = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(SEED))), ">u8")
        out.append(hashed)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)) & ~_ONE, sizes


def pairs(hashed: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before; a text follows upon an end. The lowest bit is 1."""
    before = np.concatenate(([_END], hashed[:-1]))
    with np.errstate(over="ignore"):
        return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + _mixed(hashed)) | _ONE


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part, *tokens(part.column("text").to_pylist())


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens and pairs, added up within a task as far as COUNTS of them go."""
    held, n = [], 0
    row = lambda keys, counts: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "c"])
    for _, hashed, _ in _texts(batches):
        for x in (hashed, pairs(hashed)):
            held.append(np.unique(x, return_counts=True))
            n += len(held[-1][0])
        if n > COUNTS:
            held = [_merged(held)]
            n = len(held[0][0])
            if n > COUNTS // 2:
                yield row(*held[0])
                held, n = [], 0
    if held:
        yield row(*_merged(held))


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _places(keys: np.ndarray, levels: np.ndarray, probe: int, bits: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(keys + (levels * PROBES + probe).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % bits


def _shard(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SHARD_BITS)).astype(np.int64)


def build_shard(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A shard's filter, with bits in proportion to what is put in."""
    levels = level(counts)
    size = max(1, math.ceil(levels.sum() * BITS_PER_INSERT / 8))
    bits, n = np.zeros(8 * size, bool), np.uint64(8 * size)
    for q in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= q], levels[levels >= q]
        for probe in range(PROBES):
            bits[_places(keys, np.full(len(keys), q), probe, n)] = True
    return np.packbits(bits, bitorder="little")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes word counts on and adds a row for each shard's filter; rows come in the order of shards."""
    held, now = [], -1

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _rows(np.array([now]), np.array([len(keys)]), [build_shard(keys, counts).tobytes()])
            held.clear()

    for batch in batches:
        keys, counts = batch.column("key").to_numpy().view(np.uint64), batch.column("c").to_numpy()
        single = (keys & _ONE) == 0
        yield _rows(keys[single].view(np.int64), counts[single], None)
        shards = _shard(keys)
        starts = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if shards[a] != now:
                yield from close()
                now = int(shards[a])
            held.append((keys[a:b], counts[a:b]))
    yield from close()


def _rows(keys: np.ndarray, counts: np.ndarray, blocks: list | None) -> pa.RecordBatch:
    blocks = pa.nulls(len(keys), pa.binary()) if blocks is None else pa.array(blocks, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), blocks], names=["key", "c", "block"])


@dataclass
class Part:
    """A part of the filter: its bytes, and each shard's first byte and bits (0 for shards of other parts)."""

    filter: np.ndarray
    first: np.ndarray
    bits: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated probes, 0 if the first is not there.

        Sorted keys ask one shard after the other, which stays in the processor's cache.
        """
        out = np.zeros(len(keys), np.uint8)
        shard = _shard(keys)
        active = np.flatnonzero(self.bits[shard] > 0)
        keys, shard = keys[active], shard[active]
        bits, first = self.bits[shard], self.first[shard]
        q = 1
        while len(active):
            for probe in range(PROBES):
                at = _places(keys, np.int64(q), probe, bits).astype(np.int64)
                there = np.flatnonzero((self.filter[first + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1)
                if len(there) < len(active):
                    active, keys, bits, first = active[there], keys[there], bits[there], first[there]
            out[active] = q
            q += 1
        return out


@dataclass
class Model:
    """Where the filter's blocks are, its parts as lists of shards, and exact counts of the head's words."""

    blocks: DataFrame
    parts: list[list[int]]
    head_keys: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int

    def part(self, shards: list[int]) -> Part:
        """The shards' blocks brought together: PART_BYTES at most, or one shard."""
        found = self.blocks.where(F.col("shard").between(min(shards, default=0), max(shards, default=-1))).orderBy("shard").toArrow()
        data = [np.frombuffer(b.as_buffer(), np.uint8) for b in found.column("block")]
        sizes, at = np.array([len(b) for b in data], np.int64), found.column("shard").to_numpy()
        first, bits = np.zeros(1 << SHARD_BITS, np.int64), np.zeros(1 << SHARD_BITS, np.uint64)
        first[at], bits[at] = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)[: len(at)], sizes * 8
        return Part(np.concatenate(data) if data else np.zeros(0, np.uint8), first, bits)


@dataclass
class Head:
    """Exact counts of the most frequent words, and the sums that base scores take."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the head's words, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], -1)


def _levels(batches: Iterator[pa.RecordBatch], part: Part) -> Iterator[tuple]:
    """Batches with their token hashes and the levels, found so far, of each token and each pair."""
    for batch, hashed, sizes in _texts(batches):
        own, pair = (np.unique(x, return_inverse=True) for x in (hashed, pairs(hashed)))
        found = tuple(part.levels(keys)[place] for keys, place in (own, pair))
        for known, column in zip(found, ("own", "pair"), strict=True):
            if batch.column(column).null_count < len(batch):
                known |= np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8)
        yield batch, hashed, sizes, *found


def _probed(part):
    """Adds the levels that this part of the filter has to the columns own and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, sizes, *found in _levels(batches, part.value):
            ends = np.cumsum(sizes)
            cut = [pa.array([x[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary()) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_no", "doc_id", "held_out", "text")), *cut], names=["row_no", "doc_id", "held_out", "text", "own", "pair"])

    return run


def _scored(part, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = head.value
        below = known_words.total + ADDED * (known_words.distinct + 1)
        for batch, hashed, sizes, own, pair in _levels(batches, part.value):
            words, place = np.unique(hashed, return_inverse=True)
            counts = known_words.exact(words)[place]
            read = count_of(own.astype(np.int64))
            context = np.concatenate((read[-1:], read[:-1]))  # a text follows upon an end, and the last token is one
            both = np.minimum(count_of(pair.astype(np.int64)), context)
            score = np.log10((both + PRIOR * (read + ADDED) / below) / (context + PRIOR))
            known = counts >= 0
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            base = np.where(known, np.log10((np.maximum(counts, 0) + ADDED) / below), 0.0)
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (known.astype(np.int64), base, score)]
            rest = np.add.reduceat((~known).astype(np.int64), starts) if len(starts) else sizes
            tail = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(rest))).astype(np.int32), hashed[~known].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_no", "doc_id", "held_out")), pa.array(sizes), *map(pa.array, sums), tail], names=["row_no", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


_PROBED = "row_no long, doc_id long, held_out boolean, text string, own binary, pair binary"
_SCORED = "row_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"


def train(docs: DataFrame, part_bytes: int = PART_BYTES, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of all texts of docs (text), and the exact counts (key, c) of all words.

    Counts are added up in each task before they are dealt out by shard, then sorted by it, so a task holds the entries of one shard at a time. The driver gets the size of
    each shard and the head, both bounded.
    """
    counted = docs.select("text").mapInArrow(_counted, "key long, c long").withColumn("shard", F.shiftrightunsigned("key", 64 - SHARD_BITS))
    summed = counted.repartition("shard").groupBy("shard", "key").agg(F.sum("c").alias("c")).sortWithinPartitions("shard").select("key", "c")
    built = storage.save(summed.mapInArrow(_built, "key long, c long, block binary"), "counts")
    single = built.where("block is null").select("key", "c")
    blocks = built.where("block is not null").select(F.col("key").alias("shard"), "block")
    total, distinct = single.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = single.orderBy(F.desc("c"), "key").limit(head).toArrow()
    keys, counts = top.column("key").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    parts, room = [[]], part_bytes
    for shard, size in blocks.select("shard", F.length("block")).orderBy("shard").collect():  # 1 << SHARD_BITS rows at most
        if size > room and parts[-1]:
            parts.append([])
            room = part_bytes
        parts[-1].append(shard)
        room -= size
    return Model(blocks, parts, keys[order], counts[order], total, distinct), single


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Trains on the rows that are not held out. score is the log10 probability of the text,
    token after token: a pair's count out of its first word's, with the word's own
    probability as prior, all counts from the filter. Counts are quantised and read with a
    few false probes, so over all next words the probabilities sum to about one, not to one.
    base_score is that of single words by exact counts; the most frequent ones are
    broadcast, others are joined to their counts.

    A null text is empty and has the end token alone. Repeated ids and rows are trained on
    and scored each. Other columns are not read; an empty table gives no rows. Words are
    told apart by 63 bits of a hash.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    model, single = train(rows.where("not held_out"), part_bytes, head)
    context = docs.sparkSession.sparkContext
    rows = rows.select("*", F.lit(None).cast("binary").alias("own"), F.lit(None).cast("binary").alias("pair"))
    for shards in model.parts[:-1]:
        before, rows = rows, storage.save(rows.mapInArrow(_probed(context.broadcast(model.part(shards))), _PROBED), "levels")
        storage.drop(before)
    part, exact = context.broadcast(model.part(model.parts[-1])), context.broadcast(Head(model.head_keys, model.head_counts, model.total, model.distinct))
    scored = storage.save(rows.mapInArrow(_scored(part, exact), _SCORED), "scores")
    below = model.total + ADDED * (model.distinct + 1)
    count = F.coalesce("c", F.lit(0))
    tail = scored.select("row_no", F.explode("tail").alias("key")).groupBy("row_no", "key").agg(F.count("*").alias("n")).join(single, "key", "left")
    tail = tail.groupBy("row_no").agg(F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((count + ADDED) / below)).alias("rest"))
    out = scored.drop("tail").join(tail, "row_no", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
