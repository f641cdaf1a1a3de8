"""Scores, retention and other choices by rank, partitioned by the caller's keys; ranks.py has what runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.ranks import percentiles, positions


def hotspots(df: DataFrame, signals: list[str], ties: list[str], cohort: list[str] = ()) -> DataFrame:
    """Adds a percentile per signal (p_...), score and position.

    The score is the mean percentile of the signals that vary in the cohort, rounded to two
    places, 0 if none does; the position follows the score, then the ties. An empty df gives
    no rows.
    """
    df = percentiles(df, signals, cohort)
    total = sum((F.col(f"p_{s}") for s in signals[1:]), F.col(f"p_{signals[0]}"))
    n = sum((F.col(f"v_{s}").cast("int") for s in signals[1:]), F.col(f"v_{signals[0]}").cast("int"))
    scored = df.withColumn("score", F.round(F.when(n > 0, total / n).otherwise(0.0), 2)).drop(*(f"v_{s}" for s in signals))
    return positions(scored, [F.desc("score"), *ties], cohort)


def top_or_threshold(ranked: DataFrame, top: int, threshold: float) -> DataFrame:
    """The first rows by position and those with enough score, with what let them in."""
    by_top, by_score = F.col("position") <= top, F.col("score") >= threshold
    return ranked.where(by_top | by_score).withColumn("by_top", by_top).withColumn("by_score", by_score)


def overlay(df: DataFrame, key: list[str], priority: str, arrival: list[str]) -> DataFrame:
    """The row of the highest priority of each key; of equals the last to arrive."""
    w = Window.partitionBy(*key).orderBy(F.desc(priority), *(F.desc(c) for c in arrival))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_wins(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*arrival))).where("_rn = 1").drop("_rn")


def newest_numbers(df: DataFrame, cohort: list[str], newest: list[str]) -> DataFrame:
    """Adds recency (1 is the newest by these columns) in each cohort."""
    return df.withColumn("recency", F.row_number().over(Window.partitionBy(*cohort).orderBy(*(F.desc(c) for c in newest))))


def keep_last(df: DataFrame, cohort: list[str], newest: list[str], n: int) -> DataFrame:
    return newest_numbers(df, cohort, newest).where(F.col("recency") <= n)


def size_budget(df: DataFrame, cohort: list[str], oldest: list[str], size: str, protected: str, budget: int) -> DataFrame:
    """What to remove, oldest first and skipping the protected, until the rest fits the budget.

    A row goes if what would be left without the earlier ones is still above the budget.
    """
    everyone = Window.partitionBy(*cohort)
    before = Window.partitionBy(*cohort).orderBy(*oldest).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(~F.col(protected), F.col(size)).otherwise(0)).over(before), F.lit(0))
    left = F.sum(size).over(everyone) - gone
    return df.withColumn("_left", left).where(~F.col(protected) & (F.col("_left") > budget)).drop("_left")


def removal_totals(removed: DataFrame, size: str, failed: str) -> DataFrame:
    """matched, failed, freed: of what was to be removed how many rows, how many of them couldn't be, and the size of the others. One row, of zeros if there are none."""
    good = ~F.coalesce(F.col(failed), F.lit(False))
    return removed.agg(F.count("*").alias("matched"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col(size))), F.lit(0)).alias("freed"))


def last_n(df: DataFrame, cohort: list[str], newest: list[str], n: int) -> DataFrame:
    """The last n rows of a cohort with how many there were and whether some are missing.

    Rows are counted apart from their order, so each task keeps its last n of a cohort before
    they meet. Null keys are a cohort.
    """
    totals = df.groupBy(*cohort).agg(F.count("*").alias("total")).select(F.struct(*cohort).alias("_cohort"), "total")
    kept = keep_last(df, cohort, newest, n).withColumn("_cohort", F.struct(*cohort))
    out = kept.join(storage.broadcast_if_small(storage.save(totals, "totals")), "_cohort").drop("_cohort")
    return out.withColumn("truncated", F.col("total") > n)


def latest(df: DataFrame, key: list[str], value: list[str], newest: list[str]) -> DataFrame:
    """The newest row's values of each key; aggregated before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*newest)).alias("_v")).select(*key, "_v.*")


def redeclared(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of a scope, with a struct (first_...) of the order of the first."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).withColumn("first_at", F.first(F.struct(*order)).over(w)).where("occurrence > 1")


def numbered_names(df: DataFrame, base: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Names made unique: the first keeps its base, later ones get -2, -3 and so on."""
    no = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(out, F.when(no == 1, F.col(base)).otherwise(F.concat_ws("-", base, no.cast("string"))))


def nearby(df: DataFrame, scope: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """Adds context, the values of the rows at most radius places away."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn("context", F.collect_list(value).over(w))


def rotated(cycle: Column) -> Column:
    """A cycle of keys turned so that its smallest key comes first."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def rank_of(column: str, order: list[str]) -> Column:
    """The place of a value in a stated order, from 0; null and unknown values come after all."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column)) - 1
    return F.when(place >= 0, place.cast("int")).otherwise(len(order))


def total_and_first(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of df in that order, with the total of its rows beside each.

    The total is one aggregate, the first rows are kept by each task before they meet. An
    empty df gives no rows.
    """
    return df.orderBy(*order).limit(limit).withColumn("total", df.agg(F.count("*")).scalar())
