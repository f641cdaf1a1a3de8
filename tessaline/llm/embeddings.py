"""Near-duplicate vectors by random hyperplanes in several tables and exact cosines.

A vector's key in a table is the signs of its products with that table's hyperplanes. Only
vectors of one bucket are compared, in double precision; a pair counts in the first table
where it meets. Buckets are cut into blocks, and pairs of blocks are the unit of work, so
no task holds a bucket whole. What leaves a task is a row per vector, not one per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm.simhash import forest
from tessaline.operators.components import connected_components

COSINE = 0.95
#: Share of the pairs right at the threshold that some table finds; closer pairs are found more often.
RECALL = 0.999
#: Vectors of a block.
BLOCK = 512
SEED = 7


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes of a table and tables for n vectors: buckets of random vectors hold about 32."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / 32 + 1))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _keys(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            out = np.zeros((len(batch), tables), np.int64)
            for i, vector in enumerate(batch.column("embedding")):
                x = np.asarray(vector.values, np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((len(x), bits * tables))
                signs = (x / np.abs(x).max()) @ planes[len(x)] >= 0
                out[i] = signs.reshape(tables, bits) @ (1 << np.arange(bits))
            keys = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])

    return run


def _compare(cosine: float):
    """Streams groups (table_no, dims, key, i, j), sorted, and yields rows (a, b, links)."""

    def pairs(group: list[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int]]:
        rows = pa.Table.from_batches(group)
        if len(rows) < 2:
            return
        table_no, i, j = (rows.column(c)[0].as_py() for c in ("table_no", "i", "j"))
        ids, n, block = (rows.column(c).to_numpy() for c in ("cid", "n", "block"))
        x = np.array(rows.column("embedding").to_pylist(), np.float64)
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        x /= np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        near = (x @ x.T) / np.outer(norm, norm) >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block
        for earlier in range(table_no):
            near &= keys[:, earlier, None] != keys[:, earlier]
        for a, links in zip(ids.tolist(), (near * n).sum(1).tolist(), strict=True):
            if links:
                yield a, None, links
        for a, b in forest(near):
            yield int(ids[a]), int(ids[b]), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("table_no", "dims", "key", "i", "j")), strict=True))
            at = 0
            while at < len(groups):
                end = at
                while end < len(groups) and groups[end] == groups[at]:
                    end += 1
                if groups[at] != now:
                    out += pairs(held) if held else []
                    held, now = [], groups[at]
                held.append(batch.slice(at, end - at))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "links"])
            out = []
        out += pairs(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "links"])

    return run


def links(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, links) of classes (cid, n, dims, embedding) of equal vectors.

    With b: an edge of a spanning forest of the links met in one place. Without: a has so
    many more links, each member of the other class counted.
    """
    bits, tables = plan(classes.count(), cosine, recall)
    keyed = storage.save(classes.mapInArrow(_keys(bits, tables), "cid long, n long, dims int, embedding array<double>, keys array<long>"), "keyed")
    members = keyed.select("*", F.posexplode("keys").alias("table_no", "key"))
    sizes = storage.save(members.groupBy("table_no", "dims", "key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = members.join(storage.broadcast_if_small(sizes), ["table_no", "dims", "key"])
    blocks = F.ceil(F.col("size") / block)
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    units = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    units = members.select("table_no", "dims", "key", "cid", "n", "block", "embedding", "keys", F.explode(units).alias("u")).select("*", "u.i", "u.j").drop("u")
    group = ["table_no", "dims", "key", "i", "j"]
    dealt = units.repartition(*group).sortWithinPartitions(*group)
    return storage.save(dealt.mapInArrow(_compare(cosine), "a long, b long, links long"), "cosines")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id that links lead to), kept (vec_id names it).

    One row per row of vectors. Vectors that are null, empty, zero or hold a null or a
    number that isn't finite link with nothing, nor do vectors of different lengths. Equal
    vectors are one class: they are linked, counted in n_links, and never paired. Repeated
    ids are vectors of their own; a null vec_id names no component but its own. Other
    columns are not read; an empty table gives no rows.
    """
    e = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("embedding", e)
    sound = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("k1", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(1), "embedding")))
    classes = rows.where("sound").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    classes = storage.save(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "n", "least", F.size("embedding").alias("dims"), "embedding"), "vectors")
    found = links(classes.select("cid", "n", "dims", "embedding"), cosine, recall, block)
    degrees = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("cid", "k1", "k2", "n", "least").join(degrees, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    named = storage.save(named, "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = storage.save(named.join(names, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "names")
    out = rows.select("vec_id", "sound", "k1", "k2").join(storage.broadcast_if_small(named), ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
