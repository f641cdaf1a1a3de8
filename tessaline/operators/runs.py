"""Run-length regions of keyed sequences and their outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, group: list[str], order: list[str], key: list[str], position: str | None = None) -> DataFrame:
    """Maximal runs of equal keys in the order of each group.

    Returns group, key, run_no (from 1), first and last (structs of order), n. With
    position, a run also ends where position does not go up by exactly one.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for c in key:
        same &= F.lag(c).over(w).eqNullSafe(F.col(c))
    if position:
        same &= F.coalesce(F.lag(position).over(w) + 1 == F.col(position), F.lit(False))
    numbered = df.withColumn("_starts", F.when(same, 0).otherwise(1)).withColumn("run_no", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    return numbered.groupBy(*group, "run_no", *key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def outliers(regions: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Adds is_outlier to runs: a run of one between two longer runs whose equal key is not its own.

    Neighbours are the runs before and after in run order, so a gap between them does not count.
    """
    w = Window.partitionBy(*group).orderBy("run_no")
    here, before, after = (F.struct(*key), F.lag(F.struct(*key)).over(w), F.lead(F.struct(*key)).over(w))
    longer = (F.lag("n").over(w) > 1) & (F.lead("n").over(w) > 1)
    found = (F.col("n") == 1) & longer & before.eqNullSafe(after) & ~before.eqNullSafe(here)
    return regions.withColumn("is_outlier", F.coalesce(found, F.lit(False)))
