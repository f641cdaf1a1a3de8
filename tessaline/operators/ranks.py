"""Ranks, positions and running totals over whole tables without a window that holds them.

Rows are dealt out by ranges of their order, so that each range is sorted by itself. The
totals of the ranges are summed up in order (a number for each partition of the shuffle)
and added to what each range counts for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage


def running(df: DataFrame, order: list[str | Column], weight: Column, out: str = "before") -> DataFrame:
    """df, written, with out: the sum of weight (a long, never null) over all rows that come before a row.

    order has column names and desc() or asc() of them; nulls come where Spark sorts them.
    Rows that are equal in all of it come in any order, but one range holds them.
    """
    spark = df.sparkSession
    at, total = storage.fresh(df, "_range", "_weight")
    spread = storage.save(df.withColumn(total, weight.cast("long")).repartitionByRange(*order).withColumn(at, F.spark_partition_id()), "ranges")
    sums, starts, so_far = spread.groupBy(at).agg(F.sum(total).alias("s")).collect(), [], 0
    for r in sorted(sums):
        starts.append((r[0], so_far))
        so_far += r[1]
    first = storage.fresh(spread, "_first")[0]
    offsets = spark.createDataFrame(starts, f"`{at}` int, `{first}` long")
    within = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spread.withColumn(out, F.coalesce(F.sum(total).over(within), F.lit(0)))
    return rows.join(F.broadcast(offsets), at).withColumn(out, F.col(out) + F.col(first)).drop(at, first, total)


def _same(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its keys in one struct, in which nulls are equal."""
    return df.withColumn(name, F.struct(*(F.col(k) for k in keys), F.lit(1).alias("_one")))


def positions(df: DataFrame, order: list[str | Column], cohort: list[str] = (), out: str = "position") -> DataFrame:
    """df with out, the place from 1 of each row in its cohort by order; equal rows are placed in any order."""
    cohort = list(cohort)
    before, start, key = storage.fresh(df, "_before", "_start", "_key")
    placed = storage.save(running(df, [*cohort, *order], F.lit(1), before), "positions")
    if not cohort:
        return placed.withColumn(out, (F.col(before) + 1).cast("int")).drop(before)
    starts = storage.save(_same(placed, cohort, key).groupBy(key).agg(F.min(before).alias(start)), "starts")
    rows = _same(placed, cohort, key).join(storage.broadcast_if_small(starts), key)
    return rows.withColumn(out, (F.col(before) - F.col(start) + 1).cast("int")).drop(before, start, key)


def percentiles(df: DataFrame, signals: list[str], cohort: list[str] = (), prefix: str = "p_") -> DataFrame:
    """df with the average-rank percentile from 0 to 100 of each signal in its cohort (p_...), and whether it varies there (v_...).

    The smallest value has 0 and the largest 100 if no others equal them; equal values share
    the mean of their ranks, and where all are equal they have 0. A null counts as a value
    below all others but doesn't make a signal vary. Only the different values of all signals
    and their counts are sorted, together; they come back by joins. Whole numbers are compared
    as longs, if all signals are whole, else all as doubles. An empty df gives no rows.
    """
    cohort, kinds = list(cohort), dict(df.dtypes)
    kind = "long" if all(kinds[s] in ("tinyint", "smallint", "int", "bigint") for s in signals) else "double"
    values = F.array(*(F.struct(F.lit(k).alias("_no"), F.col(s).cast(kind).alias("_value")) for k, s in enumerate(signals)))
    counts = df.select(F.struct(*(F.col(c) for c in cohort), F.lit(1).alias("_one")).alias("_cohort"), F.explode(values).alias("_v")).groupBy("_v._no", "_cohort", "_v._value").agg(F.count("*").alias("_n"))
    placed = storage.save(running(counts, ["_no", "_cohort", "_value"], F.col("_n"), "_before"), "values")
    totals = placed.groupBy("_no", "_cohort").agg(F.sum("_n").alias("_all"), F.min("_before").alias("_start"), (F.min("_value") < F.max("_value")).alias("_varies"))
    of = placed.join(storage.broadcast_if_small(storage.save(totals, "totals")), ["_no", "_cohort"])
    varies = F.coalesce(F.col("_varies"), F.lit(False))
    rank = F.when(varies, 100.0 * (F.col("_before") - F.col("_start") + (F.col("_n") - 1) / 2) / (F.col("_all") - 1)).otherwise(0.0)
    table = storage.save(of.select("_no", F.struct("_cohort", "_value").alias("_key"), rank.alias("_p"), varies.alias("_varies")), "percentiles")
    key = storage.fresh(df, "_key")[0]
    for k, s in enumerate(signals):
        of_signal = storage.broadcast_if_small(table.where(F.col("_no") == k).select(F.col("_key").alias(key), F.col("_p").alias(f"{prefix}{s}"), F.col("_varies").alias(f"v_{s}")))
        own = F.struct(F.struct(*(F.col(c) for c in cohort), F.lit(1).alias("_one")).alias("_cohort"), F.col(s).cast(kind).alias("_value"))
        df = df.withColumn(key, own).join(of_signal, key).drop(key)
    return df
