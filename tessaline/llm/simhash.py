"""SimHash near-duplicates found by covering locality-sensitive hashing.

For a radius r each bit is given a nonzero vector of r + 1 bits; each nonzero vector v
makes a mask of the bits whose vectors have odd parity with v. Any r bits leave a v to
which all their vectors are orthogonal, so two fingerprints that differ in r bits or fewer
agree under some mask: no link is missed (R. Pagh, CoveringLSH, 2016).
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessaline import storage
from tessaline.llm import lines
from tessaline.llm.words import lower_ascii, words
from tessaline.operators.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: For keep_one(): words of the shingles that are compared, their least similarity, and the
#: radius within which fingerprints are sure to meet. Measured over sf0.1 that holds for 0.58 of
#: the pairs of similarity 0.8 to 0.85, 0.95 of those to 0.9 and 0.999 of those above.
WORDS, SIMILARITY, KEEP_RADIUS = 5, 0.8, 6
#: Texts that meet are compared up to so many differing bits; a pair of similarity 0.8 differs in some 7.
FAR = 12
#: Rows of one long that may be broadcast.
IDS = 1_000_000
#: Fingerprints of one bucket that are compared with each other; larger ones go by flipped bits.
BUCKET = 8192

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash as a signed number: a bit is 1 if set in over half the shingles' hashes.

    Shingles are size words, joined by a space; a text with fewer has one, a text without
    words has fingerprint zero. bytes.split() splits at the same six white-space characters.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashed = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 4096):
        part = hashed[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t, s) for t, s in zip(texts, sizes, strict=True)], dtype="int64")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed 64-bit numbers."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    found = [sum(((vectors[i] & v).bit_count() & 1) << i for i in range(64)) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this boolean adjacency matrix."""
    unseen, edges = np.ones(len(near), bool), []
    for root in range(len(near)):
        if unseen[root]:
            unseen[root], queue = False, [root]
            while queue:
                at = queue.pop()
                for other in np.flatnonzero(near[at] & unseen).tolist():
                    unseen[other] = False
                    edges.append((at, other))
                    queue.append(other)
    return edges


def _bucket_edges(radius: int):
    """Links of a bucket's fingerprints, as a spanning forest: the rest says nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column("members"):
                x = np.asarray(bucket.values).view(np.uint64)
                near = np.vstack([np.bitwise_count(x[i : i + 256, None] ^ x) <= radius for i in range(0, len(x), 256)])
                for i, j in forest(near):
                    a.append(x[i].astype(np.int64))
                    b.append(x[j].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _flips(radius: int) -> list[tuple[int, int, bool]]:
    """(mask number, bits to flip, whether few): few are half the radius at most, all the rest of it.

    Two fingerprints that differ in radius bits outside a mask meet where one has flipped
    the smaller half of them and the other the rest.
    """
    out = []
    for no, mask in enumerate(masks(radius)):
        free = [1 << i for i in range(64) if not (mask >> i) & 1]
        for n in range(radius - radius // 2 + 1):
            for bits in combinations(free, n):
                x = sum(bits)
                out.append((no, x - (1 << 64) if x >> 63 else x, n <= radius // 2))
    return out


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) that differ in radius bits or fewer.

    Buckets of two, nearly all there are, are settled by an aggregate. Buckets of up to
    bucket members are compared in one go. In larger ones every member tries the flips of
    its free bits: members that meet at a flipped value join the smallest one there that
    has flipped few bits, so rows grow with the members and not with their pairs.
    """
    spark = prints.sparkSession
    keys = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)))).alias("mask_no", "key"))
    shared = keys.groupBy("mask_no", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    shared = storage.save(shared.where("n > 1"), "buckets")
    edges = shared.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = keys.join(storage.broadcast_if_small(shared.where("n > 2").select("mask_no", "key", "n")), ["mask_no", "key"])
    some = members.where(F.col("n") <= bucket).groupBy("mask_no", "key").agg(F.collect_list("fp").alias("members"))
    edges = edges.union(some.select("members").mapInArrow(_bucket_edges(radius), "a long, b long"))
    if shared.where(F.col("n") > bucket).limit(1).count():
        flips = F.broadcast(spark.createDataFrame(_flips(radius), "mask_no int, flip long, few boolean"))
        tried = members.where(F.col("n") > bucket).join(flips, "mask_no").select("mask_no", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"), "fp", "few")
        centre = tried.where("few").groupBy("mask_no", "at").agg(F.min("fp").alias("centre"))
        edges = edges.union(tried.join(centre, ["mask_no", "at"]).where("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")))
    return edges.distinct()


def _named(prints: DataFrame, radius: int, bucket: int) -> DataFrame:
    """fp, least (doc_id), root of the distinct fingerprints of prints (doc_id, fp); a root is a component's."""
    classes = storage.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = connected_components(links(classes.select("fp"), radius, bucket))
    named = classes.join(storage.broadcast_if_small(joined), classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    return storage.save(named, "named")


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links lead to).

    One row per row of docs, repeated ids and rows included. Copies share a fingerprint, so
    links are sought between distinct fingerprints only. Null and empty texts and texts of
    white space have fingerprint zero and are linked like any other. A null doc_id never
    names a component of others; a component of null ids alone has a null name. Other
    columns are not read; an empty table gives no rows.
    """
    prints = storage.save(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text), F.lit(size)).alias("fp")), "simhash")
    named = _named(prints, radius, bucket)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = storage.save(named.join(names, "root").select("fp", "component_id"), "names")
    return prints.join(storage.broadcast_if_small(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_shingles(text: Column, size: int = WORDS) -> Column:
    """The hashes of a text's distinct shingles of size words, A to Z in lower case; a text with fewer words has one."""
    # the outer transform binds the words, which the inner one would work out anew for each shingle
    cut = lambda w: F.when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))))
    return F.get(F.transform(F.array(words(lower_ascii(text))), cut), F.lit(0))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = KEEP_RADIUS) -> DataFrame:
    """One row of docs for each group of near copies, with the columns it had.

    Texts whose fingerprints agree under a covering mask are candidates, which all that
    differ in radius bits or fewer do and some of up to FAR; they are near copies if the Jaccard similarity of their shingles of
    WORDS words is similarity or more, and groups are what these links connect. Equal
    texts, null and empty ones being equal, are always of one group. The row that stays has
    the smallest id, null last, and of those the columns that hash lowest. Rows of one id,
    null or not, that are in groups of their own all stay. An empty table gives no rows.
    """
    row, value = storage.fresh(docs, "_row", "_value")
    hashed, body = F.xxhash64(*docs.columns), F.coalesce(F.col(text), F.lit(""))
    with storage.passing() as stays:
        prints = storage.save(docs.select(F.col(doc_id).alias("doc_id"), hashed.alias("row"), F.xxhash64(body).alias("id"), _fingerprints(body, F.lit(SHINGLE)).alias("fp")), "simhash")
        distinct = storage.save(prints.groupBy("id").agg(F.min("fp").alias("fp")), "distinct")
        keys = F.transform(F.array(*(F.lit(m) for m in masks(radius))), lambda m, no: F.xxhash64(no, F.col("fp").bitwiseAND(m)))
        near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= FAR
        # a text is kept as its set of shingles, by which it is judged and, where buckets are large (one mask has a
        # single bit, so all texts of a large table are in one), banded anew
        judged = lines.Judged(word_shingles, lambda kept: kept, lambda sets: sets.select("id", F.explode("line").alias("h0")), near, 2)
        edges = lines.similar(distinct.select("id", F.col("fp").alias("mark"), keys.alias("bands")), docs.select(body.alias("line")), similarity, judged)
        roots = storage.broadcast_if_small(connected_components(edges))
        rooted = prints.join(roots, prints.id == roots.node, "left").select("doc_id", "row", F.coalesce("component", "id").alias("root"))
        keep = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias(row)).select(row)
        stays.append(storage.save(keep, "keep"))
    kept = docs.withColumn(row, hashed).join(storage.broadcast_if_small(stays[0], IDS), row, "left_semi")
    return kept.groupBy(row).agg(F.min(F.struct(*docs.columns)).alias(value)).select(*(F.col(f"{value}.`{c}`") for c in docs.columns))
