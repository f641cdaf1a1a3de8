"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The whole part is
given; the fraction is rounded by the pivotal method: two documents pass mass to each
other at random until one of them has none or a whole copy, so the sum never changes.
Documents are paired in the order of their sizes, so words hardly change either. A block
has documents of one source and of sizes close to each other; blocks are rounded apart,
each leaves one fraction at most, and the fractions of up to 64 blocks meet in the next
level of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm.words import words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 4096
FAN_IN = 64
#: Size classes of a block for each doubling of the size.
CLASSES = 4
#: Decisions (two longs) that draw() may broadcast.
DECISIONS = 1_000_000
SEED = 11


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n, target of rows (source, size).

    Sources in code-point order, null last, have the weights in turn. Together they get
    share times all words; none more than most times its own, the excess being shared
    again by weight. That is: sources sorted by most * source_size / weight are filled up
    one after the other while an equal level of the rest would exceed their bound. The
    windows run over a row per source.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = found.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights)).cast("int"))).withColumn("bound", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = weighted.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("bound"))
    common = F.min(F.when(F.col("free"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_)["level"]
    return filled.withColumn("common", common).select("source", "source_size", "n", F.when(F.coalesce(F.col("bound") / F.col("weight") <= F.col("common"), F.lit(True)), F.col("bound")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _chance(ids: Column, seed: int) -> Column:
    """Uniform in [0, 1), the same for the same id in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), ids), 11) / float(1 << 53)


def pivot(parts: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in order; returns what each has at the end and the place of the one left, or -1."""
    out, at = parts.astype(float).copy(), -1
    for i, u in enumerate(chances):
        if out[i] <= 1e-12 or out[i] >= 1 - 1e-12:
            out[i] = round(out[i])
        elif at < 0:
            at = i
        else:
            a, b = out[at], out[i]
            if a + b < 1:
                winner, loser = (i, at) if u < b / (a + b) else (at, i)
                out[winner], out[loser] = a + b, 0
            else:
                winner, loser = (at, i) if u < (1 - b) / (2 - a - b) else (i, at)
                out[winner], out[loser] = 1, a + b - 1
            at = winner if a + b < 1 else loser
            if out[at] <= 1e-12 or out[at] >= 1 - 1e-12:
                out[at], at = round(out[at]), -1
    return out, at


_SCHEMA = "row_no long, doc_id long, key long, source string, size long, source_size long, target double, whole long, part double, chance double, block long, open boolean"


def _round(last: bool):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["size", "key", "row_no"], kind="stable").reset_index(drop=True)
        parts, at = pivot(batch["part"].to_numpy(), batch["chance"].to_numpy())
        if last and at >= 0:
            parts[at], at = float(batch["chance"].iloc[at] * (1 << 20) % 1 < parts[at]), -1  # later digits of the same number
        batch["part"], batch["open"] = parts, np.arange(len(batch)) == at
        return batch

    return run


def _sized(rows: DataFrame, row_no: str, doc_id: str, text: str, source: str) -> DataFrame:
    """row_no, doc_id, key (of the id and the text), source, size, class of rows."""
    size = F.size(words(F.col(text))).cast("long")
    narrow = rows.select(F.col(row_no).alias("row_no"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"))
    return storage.save(narrow, "sizes").withColumn("class", F.floor(CLASSES * F.log2(F.col("size") + 1)))


def _decided(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int, block: int) -> DataFrame:
    """sized's rows with source_size, target and copies."""
    one = lambda df: df.withColumn("s", F.struct("source")).drop("source")
    by_class = sized.groupBy("source", "class").agg(F.ceil(F.count("*") / block).alias("blocks"))
    of_source = Window.partitionBy("source")
    before = F.coalesce(F.sum("blocks").over(of_source.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_class = by_class.select("*", before.alias("offset"), F.sum("blocks").over(of_source).alias("all_blocks"))
    shares = storage.save(one(by_class).join(one(targets(sized, weights, share, most).drop("n")), "s"), "targets")
    rows = sized.withColumn("s", F.struct("source")).join(storage.broadcast_if_small(shares), ["s", "class"])
    # rows that agree in all are alike; where they would overfill a block they are dealt out by their numbers
    alike = storage.save(sized.groupBy("key", "source").agg(F.count("*").alias("alike")).where(F.col("alike") > block).select("key", F.struct("source").alias("s"), F.lit(True).alias("many")), "alike")
    rows = rows.join(storage.broadcast_if_small(alike), ["s", "key"], "left")
    dealt = F.xxhash64(F.lit(seed + 1), "key", F.when(F.col("many"), F.col("row_no")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("part", copies - F.floor(copies)).withColumn("open", F.lit(False))
    rows = rows.withColumn("chance", _chance(F.col("key"), seed)).withColumn("block", F.col("offset") + F.pmod(dealt, F.col("blocks")))
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    most_blocks = shares.agg(F.max("all_blocks")).first()[0] or 1
    level = storage.save(rows.select(*columns).groupBy("source", "block").applyInPandas(_round(most_blocks == 1), _SCHEMA), "rounded")
    done = level.where("not open")
    while most_blocks > 1:
        most_blocks = -(-most_blocks // FAN_IN)
        left = level.where("open").withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("chance", _chance(F.col("key"), seed + 2 + most_blocks))
        level = storage.save(left.groupBy("source", "block").applyInPandas(_round(most_blocks == 1), _SCHEMA), "rounded")
        done = done.union(level.where("not open"))
    return done.withColumn("copies", F.col("whole") + F.round("part").cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size (words), source_size, target, copies, taken (words) of each row of docs.

    A null text has no words; a document without words is rounded like others and takes
    none. A null source is a source. Repeated ids and rows are rounded each. Chances come
    from id and text, so reruns agree whatever the partitions; rows that agree in these are
    alike, and only where they are more than a block holds do their row numbers spread them.
    An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    decided = _decided(_sized(rows, "row_no", "doc_id", "text", "source"), weights, share, most, seed, block)
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def draw(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with their columns.

    Rows are numbered in a written copy of docs, so every row meets its own decision,
    whatever it shares with others: nulls, repeated ids and repeated rows are no special
    case. An empty table gives no rows. Texts are shuffled only where the decisions are too
    many to be broadcast.
    """
    no, copies, copy = storage.fresh(docs, "_no", "_copies", "_copy")
    rows = storage.save(docs.withColumn(no, F.monotonically_increasing_id()), "numbered")
    decided = _decided(_sized(rows, no, doc_id, text, source), weights, share, most, seed, block)
    taken = storage.save(decided.where("copies > 0").select(F.col("row_no").alias(no), F.col("copies").alias(copies)), "taken")
    drawn = rows.join(storage.broadcast_if_small(taken, DECISIONS), no)
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).drop(copy)
