"""Aggregations: status counts, grouped rollups, fan-in and fan-out, evidence, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.ranks import positions


def status_summary(df: DataFrame, group: list[str], status: str, known: list[str], default: str) -> DataFrame:
    """Rows per group and over all (group null, total true) of each known status; others count as the default."""
    clean = F.when(F.col(status).isin(known), F.col(status)).otherwise(F.lit(default))
    counts = [F.count_if(clean == s).alias(s) for s in known]
    return df.rollup(*group).agg(*counts, F.grouping_id().alias("_g")).withColumn("total", F.col("_g") > 0).where(F.col("_g").isin(0, 2 ** len(group) - 1)).drop("_g")


def by_sets(df: DataFrame, columns: list[str], sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates for each grouping set, with level, the number of columns in the set."""
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates, F.grouping_id().alias("_g"))
    return out.withColumn("level", F.lit(len(columns)) - F.bit_count("_g")).drop("_g")


def pivoted_counts(df: DataFrame, group: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def counters(df: DataFrame, group: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each group fulfil each condition."""
    return df.groupBy(*group).agg(*(F.count_if(c).alias(k) for k, c in conditions.items()))


def fans(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, fan_in (distinct sources), fan_out (distinct targets), self-edges left out."""
    pairs = edges.where(F.col(source) != F.col(target)).select(source, target).distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def rolled_up(df: DataFrame, group: list[str], sums: list[str], highest: list[str], flags: list[str]) -> DataFrame:
    """Sums, maxima and counts of true flags per group, as from members to their module."""
    return df.groupBy(*group).agg(*(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.max(c).alias(f"max_{c}") for c in highest), *(F.count_if(c).alias(f"n_{c}") for c in flags))


def summaries(df: DataFrame, group: list[str], size: str, sets: list[str]) -> DataFrame:
    """Per group: rows, summed size, and the distinct sorted members of array columns."""
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(size).alias("size"), *merged)


def with_evidence(edges: DataFrame, key: list[str], evidence: list[str]) -> DataFrame:
    """One row per key with the distinct evidence structs in order."""
    return edges.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(*evidence))).alias("evidence"))


def stage_totals(stages: DataFrame, name: str, sums: list[str], outcome: str, ranks: dict[str, int], order: str) -> DataFrame:
    """Sums per stage, its worst outcome by rank and its place by first appearance."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col(outcome)), F.lit(-1))
    out = stages.groupBy(name).agg(*(F.sum(c).alias(c) for c in sums), F.max_by(outcome, rank).alias(outcome), F.min(order).alias("_first"))
    return out.withColumn("place", F.row_number().over(Window.orderBy("_first", name))).drop("_first")


def compared_counts(actual: DataFrame, declared: DataFrame, key: list[str], n: str) -> DataFrame:
    """key, actual, declared where counts differ or a side is missing."""
    a, d = actual.select(*key, F.col(n).alias("actual")), declared.select(*key, F.col(n).alias("declared"))
    return a.join(d, key, "full_outer").where(~F.col("actual").eqNullSafe(F.col("declared")))


#: Hashes that are joined into one on each level of a digest.
CHUNK = 256


def digest(df: DataFrame, group: list[str], order: list[str], value: str, chunk: int = CHUNK) -> DataFrame:
    """group, digest of each group's values in order: the root of a tree of SHA-256 hashes.

    A value's leaf is its hash, "" for a null. On each level the hashes of so many places in
    order are joined by line feeds and hashed, until a group has one; a group of one value
    goes through one level too. So no row is longer than a chunk, and a changed value changes
    the hashes on its path alone. order tells the rows of a group apart; null keys are a group.
    """
    leaf = F.coalesce(F.sha2(F.col(value).cast("string"), 256), F.lit(""))
    level = positions(df.select(*group, leaf.alias("_h"), *(c for c in order if c not in group)), list(order), group, "_at")
    level, done = level.select(F.struct(*group).alias("_g"), (F.col("_at") - 1).cast("long").alias("_at"), "_h"), None
    while True:
        rows = F.sort_array(F.collect_list(F.struct("_at", "_h")))
        parts = level.groupBy("_g", F.floor(F.col("_at") / chunk).alias("_up")).agg(F.array_join(F.transform(rows, lambda r: r["_h"]), "\n").alias("_l"))
        level = storage.save(parts.select("_g", F.col("_up").alias("_at"), F.sha2("_l", 256).alias("_h")), "digest")
        open_ = level.where("_at > 0").select("_g").distinct()
        roots = level.join(open_, "_g", "left_anti").select("_g.*", F.col("_h").alias("digest"))
        done = roots if done is None else done.union(roots)
        level = storage.save(level.join(open_, "_g", "left_semi"), "digest")
        if not level.limit(1).count():
            return done
