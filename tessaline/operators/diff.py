"""Comparison of two snapshots: by key, by cell, by line number and as multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.functions.scalars import text_lines
from tessaline.operators.ranks import positions


def added_removed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, with kind 'added' or 'removed'."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    removed = a.join(b, key, "left_anti").withColumn("kind", F.lit("removed"))
    return removed.unionByName(b.join(a, key, "left_anti").withColumn("kind", F.lit("added")))


def _sides(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    a, b = (df.select(*key, F.struct(*values).alias(side)) for df, side in ((before, "before"), (after, "after")))
    on = [a[k].eqNullSafe(b[k]) for k in key]
    return a.join(b, on, "full_outer").select(*(F.coalesce(a[k], b[k]).alias(k) for k in key), "before", "after")


def cell_diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """key, kind (the value's name), before, after of all cells that differ; absent equals ''."""
    text = lambda side, v: F.coalesce(F.col(f"{side}.{v}").cast("string"), F.lit(""))
    cells = F.array(*(F.struct(F.lit(v).alias("kind"), text("before", v).alias("before"), text("after", v).alias("after")) for v in values))
    rows = _sides(before, after, key, values).select(*key, F.explode(cells).alias("c")).select(*key, "c.*")
    return rows.where("before <> after")


def changed_keys(before: DataFrame, after: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """key and kind (added, removed, changed) where a side is missing or fingerprints differ."""
    both = _sides(before, after, key, [fingerprint])
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*key, kind.alias("kind")).where("kind is not null")


def line_diff(before: DataFrame, after: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, line_no (from 1), before, after of the lines that differ at the same number.

    Lines are compared by number, not aligned; one past a side's end is ''. Line ends are
    made equal first.
    """
    sides = [df.select(*key, F.posexplode(text_lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1) for df in (before, after)]
    return cell_diff(*sides, [*key, "line_no"], ["line"]).drop("kind")


def multiset_delta(want: DataFrame, got: DataFrame) -> DataFrame:
    """Rows with how many more of them one side has: missing (in want) or unexpected (in got).

    One aggregate with partial sums instead of two differences; equal to EXCEPT ALL both
    ways, each row with its count.
    """
    columns = want.columns
    signed = want.withColumn("_n", F.lit(1)).unionByName(got.select(*columns).withColumn("_n", F.lit(-1)))
    out = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return out.select(*columns, F.when(F.col("_n") > 0, "missing").otherwise("unexpected").alias("kind"), F.abs("_n").alias("n"))


def delta_by(delta: DataFrame, group: list[str]) -> DataFrame:
    """group with the counts of missing and unexpected rows of a multiset_delta."""
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return delta.groupBy(*group).agg(count("missing").alias("missing"), count("unexpected").alias("unexpected"))


def delta_rows(delta: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows of a multiset_delta with the missing and unexpected totals of their group, and their place in the group's list of their kind.

    Both lists stay rows, so a group may be as long as it is; nulls are a group.
    """
    totals = delta_by(delta, group).select(F.struct(*group).alias("_g"), "missing", "unexpected")
    placed = positions(delta, order, [*group, "kind"], "place").withColumn("_g", F.struct(*group))
    return placed.join(totals, "_g").drop("_g")


def summary(diff: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind, and the total under the kind 'total'."""
    return diff.rollup(kind).agg(F.count("*").alias("n")).select(F.coalesce(kind, F.lit("total")).alias("kind"), "n")
