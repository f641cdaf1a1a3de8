"""Ranked lexical search as a blocked sparse matrix product.

Documents are read once and cut into blocks. A block is a sparse term-document matrix in
rows by term: which of its documents hold a term and how often, kept for the terms that
some item asks for. Blocks are written to the shared folder; the statistics (documents,
their terms, document frequencies) are sums over them. In the second pass a block's counts
become int64 impacts, and each row of the item-term matrix merges the impact rows of its
terms into one accumulator (Gustavson's order of a sparse product). A task keeps the k best
of each item over its blocks, and those are reduced in two further levels.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage

#: How many documents an item gets.
TOP = 10
#: Percent of the length normalisation, and the factor of a document's length against a term's count.
LENGTH_PERCENT, LENGTH_FACTOR = 90, 8
#: Item-term entries that are broadcast at once; further items are a block of their own with a pass of its own.
ENTRIES = 1_000_000
#: A block of documents ends at so many documents or occurrences of asked terms.
BLOCK_DOCS, BLOCK_HITS = 16_384, 2_000_000
#: Tasks whose best documents meet in the second level of the reduction.
FAN_IN = 64

#: Bytes of terms in lower case, and blanks for all others; bytes of characters above ASCII belong to terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(texts: pa.Array) -> Iterator[list[bytes]]:
    """The terms of each text: maximal runs of ASCII letters and digits and characters above ASCII."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = texts.buffers()[2]
    data = data[ends[0] : ends[-1]].to_pybytes().translate(_TERM_BYTES) if data is not None and ends else b""
    for start, end in zip(ends, ends[1:], strict=False):
        yield data[start - ends[0] : end - ends[0]].split()


_ENTRIES = pa.schema([("item_no", pa.int64()), ("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(no, key, term.decode(), times) for no, key, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), terms(batch.column(2)), strict=True) for term, times in Counter(found).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _ENTRIES, strict=True)], schema=_ENTRIES)


_MATRIX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("docs", pa.binary()), ("tf", pa.binary())])
_MATRIX_SQL = "doc_ids array<long>, sizes binary, n_docs long, n_terms long, terms array<int>, counts array<int>, docs binary, tf binary"


class _Block:
    """Documents of a block as they come: ids, numbers of terms, and the asked terms found in each."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.hits, self.found = [], [], [], array("i")

    def matrix(self) -> pa.RecordBatch:
        """The block in rows by term: the numbers of its documents and their counts."""
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int64), self.hits)
        cells, tf = np.unique(np.array(self.found, np.int64) << 32 | doc, return_counts=True)
        rows, counts = np.unique(cells >> 32, return_counts=True)
        sizes = np.array(self.sizes, "<i8")
        values = [[self.ids], [sizes.tobytes()], [int((sizes > 0).sum())], [int(sizes.sum())], [rows], [counts], [(cells & 0xFFFFFFFF).astype("<i4").tobytes()], [tf.astype("<i4").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _MATRIX, strict=True)], schema=_MATRIX)


def _index(docs: DataFrame, vocabulary) -> DataFrame:
    """The written blocks of docs (doc_id, text) over a broadcast vocabulary (term to number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = vocabulary.value.get, _Block()
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), terms(batch.column(1)), strict=True):
                before = len(block.found)
                block.found.extend([n for n in map(number, words) if n is not None])
                block.ids.append(key)
                block.sizes.append(len(words))
                block.hits.append(len(block.found) - before)
                if len(block.ids) >= BLOCK_DOCS or len(block.found) >= BLOCK_HITS:
                    yield block.matrix()
                    block = _Block()
        if block.ids:
            yield block.matrix()

    return storage.save(docs.mapInArrow(run, _MATRIX_SQL), "postings")


class _Best:
    """The k best documents of an item so far: scores, ids and whether an id is null, best first."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.nulls = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        least = max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1
        at = np.flatnonzero(scores >= least)
        if len(at) > self.k:
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        if len(at):
            s, i, n = (np.concatenate(x) for x in ((self.scores, scores[at]), (self.ids, ids[at]), (self.nulls, nulls[at])))
            order = np.lexsort((i, n, -s))[: self.k]
            self.scores, self.ids, self.nulls = s[order], i[order], n[order]


_FOUND = pa.schema([("item_no", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("task", pa.int64())])


def _products(blocks: DataFrame, items, docs: int, all_terms: int, top: int) -> DataFrame:
    """item_no, item_id, doc_id, score, task: each task's best documents of each item.

    items is a broadcast of (numbers, ids, row ends, term numbers, multiplicities, weights).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers, keys, ends, columns, times, weights = items.value
        best = [_Best(top) for _ in numbers]
        for row in (r for b in batches for r in b.to_pylist()):
            sizes = np.frombuffer(row["sizes"], "<i8")
            ids, nulls = np.array([i or 0 for i in row["doc_ids"]], np.int64), np.array([i is None for i in row["doc_ids"]])
            at, tf = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tf"], "<i4").astype(np.int64)
            rows, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
            if not len(rows):
                continue
            norm = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * sizes * docs) // all_terms
            impacts = np.repeat(weights[rows], counts) * ((1_000_000_000 * tf) // (1000 * tf + LENGTH_FACTOR * norm[at]))
            stop = np.zeros(len(weights) + 1, np.int64)
            stop[rows + 1] = counts
            stop = np.cumsum(stop).tolist()
            for item, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                total = np.zeros(len(ids), np.int64)
                for term, many in zip(columns[a:b], times[a:b], strict=True):
                    if (x := stop[term]) < (y := stop[term + 1]):
                        total[at[x:y]] += impacts[x:y] if many == 1 else many * impacts[x:y]
                best[item].add(total, ids, nulls)
        task = TaskContext.get().partitionId()
        out = {f.name: [] for f in _FOUND}
        for no, key, b in zip(numbers, keys, best, strict=True):
            for score, doc, null in zip(b.scores.tolist(), b.ids.tolist(), b.nulls.tolist(), strict=True):
                for column, value in zip(out.values(), (no, key, None if null else doc, score, task), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return blocks.select("doc_ids", "sizes", "terms", "counts", "docs", "tf").mapInArrow(run, "item_no long, item_id long, doc_id long, score long, task long")


def _ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, repeats: bool = False, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the top documents of each item with a score above 0.

    Terms are maximal runs of ASCII letters and digits and of characters above ASCII, with
    only A to Z lower-cased. With N documents that have a term, L terms in all, n terms in a
    document and df documents that hold a term, a term weighs
    w = floor(1000 * ln((2N + 2) / (2 df + 1))), a document's length is
    m = 10 + (90 n N) div L, and an item scores the sum of
    w * ((10^9 tf) div (1000 tf + 8 m)) over its terms, once each, or with repeats as often
    as the item holds them. All but the logarithm is in 64-bit integers.

    A null or empty text has no terms: such a document counts for nothing, such an item gets
    no rows. Equal scores go by doc_id, null last. Repeated rows are documents, or items, of
    their own. Empty tables give no rows; other columns are not read. Items whose entries
    exceed the bound are searched in blocks, each with a pass over docs; the hash of the
    item's number deals them out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    asked = storage.save(asked.mapInArrow(_entries, "item_no long, item_id long, term string, times long"), "items")
    n_blocks, found = -(-asked.count() // entries), None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == b).orderBy("item_no", "term").collect()
        if not block:
            continue
        words = {term: i for i, term in enumerate(sorted({r.term for r in block}))}
        blocks = _index(rows, spark.sparkContext.broadcast({w.encode(): i for w, i in words.items()}))
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        cells = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy("c.terms").agg(F.sum("c.counts").alias("df"))
        weights = np.zeros(len(words), np.int64)
        for term, df in cells.collect():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        numbers = list(dict.fromkeys((r.item_no, r.item_id) for r in block))
        sizes = Counter(r.item_no for r in block)
        ends = [0, *np.cumsum([sizes[no] for no, _ in numbers]).tolist()]
        matrix = ([no for no, _ in numbers], [key for _, key in numbers], ends, [words[r.term] for r in block], [r.times if repeats else 1 for r in block], weights)
        part = _products(blocks, spark.sparkContext.broadcast(matrix), n_docs, n_terms, top)
        part = _ranked(part.withColumn("task", F.floor(F.col("task") / FAN_IN)), ["item_no", "task"], top)
        part = _ranked(part.drop("rank"), ["item_no"], top).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
