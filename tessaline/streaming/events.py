"""Incremental operators: newest-generation upserts, sessions and last-n, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessaline.operators.ranking import overlay


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap_minutes: int) -> DataFrame:
    """key, start_ts, end_ts, n of a key's sessions; one starts after a gap of more than so many minutes."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    starts = F.coalesce(F.col(ts) > F.lag(ts).over(w) + F.make_dt_interval(mins=F.lit(gap_minutes)), F.lit(True))
    numbered = events.withColumn("_b", starts.cast("int")).withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_s").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n")).drop("_s")


def streamed_sessions(events: DataFrame, key: str, ts: str, gap_minutes: int, late_minutes: int) -> DataFrame:
    """key, start_ts, end_ts (last event plus gap), n; append mode gives sessions the watermark has closed."""
    watched = events.withWatermark(ts, f"{late_minutes} minutes")
    out = watched.groupBy(key, F.session_window(ts, f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def publish(batch: DataFrame, path: str, key: list[str], generation: str, complete: str | None = None) -> None:
    """Merges a batch into the Parquet table at path: per key the row of the highest generation.

    An older generation never replaces a newer one. Rows whose complete flag is false are
    left out, so a partial snapshot never becomes the base. The merged table is written
    beside the old one and its name put into a pointer last, so a batch that is run again
    after a failure ends in the same table.
    """
    spark, columns = batch.sparkSession, batch.columns
    rows = batch.where(complete) if complete else batch
    now = current(spark, path)
    if now is not None:
        rows = rows.unionByName(now.select(*columns))
    merged = overlay(rows, key, generation, [c for c in columns if c not in (*key, generation)])
    version = _version(spark, path) + 1
    merged.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").json(f"{path}/current-{version:012d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current-*/_SUCCESS")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(int(s.getPath().getParent().getName().rpartition("-")[2]) for s in found or [])


def _version(spark: SparkSession, path: str) -> int:
    return (_versions(spark, path) or [0])[-1]


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that publish() has left at path; None before the first batch."""
    version = _version(spark, path)
    return spark.read.parquet(f"{path}/v{version}") if version else None


def upsert_stream(stream: DataFrame, path: str, key: list[str], generation: str, complete: str | None = None) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(lambda batch, _: publish(batch, path, key, generation, complete))


def parsed(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Rows of JSON lines; those that aren't JSON are dropped."""
    return lines.select(F.from_json(value, schema).alias("_e"), F.col(value).alias("_v")).where("_e is not null AND get_json_object(_v, '$') is not null").select("_e.*")


def last_n_stream(events: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """key, total, truncated, latest (values, oldest first): the last n of each key, kept as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, orders, values = state.get if state.exists else (0, [], [])
        rows = list(zip(orders, values, strict=True))
        for batch in batches:
            total += len(batch)
            rows = sorted([*rows, *zip(batch["place"].tolist(), batch["value"].tolist(), strict=True)])[-n:]
        state.update((total, [r[0] for r in rows], [r[1] for r in rows]))
        yield pd.DataFrame({"key": [k[0]], "total": [total], "truncated": [total > n], "latest": [[r[1] for r in rows]]})

    rows = events.select(F.col(key).alias("key"), F.col(order).cast("long").alias("place"), F.col(value).cast("string").alias("value"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, total long, truncated boolean, latest array<string>", "total long, orders array<long>, vals array<string>", "update", GroupStateTimeout.NoTimeout)


def dependents(changes: DataFrame, calls: DataFrame, name: str, target: str) -> DataFrame:
    """Changes of a stream joined to the table of what depends on each name, without case."""
    known = calls.select(F.lower(name).alias("_name"), F.col(target))
    return changes.withColumn("_name", F.lower(name)).join(known, "_name").drop("_name")


def file_changes(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """key, change (created, changed or deleted) between two listings of files; equal stamps, nulls too, are no change."""
    old, new = (df.groupBy(key).agg(F.max(stamp).alias(name), F.lit(True).alias(f"_{name}")) for df, name in ((before, "was"), (after, "is")))
    change = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return old.join(new, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def settled_changes(changes: DataFrame, key: str, change: str, order: str) -> DataFrame:
    """key, action, n of a batch of file changes: deleted files go (remove), all others are read anew (refresh).

    The last change by order counts, and of those of one order the largest change by name.
    """
    last = F.max(F.struct(order, change))[change]
    return changes.groupBy(key).agg(F.when(last == "deleted", "remove").otherwise("refresh").alias("action"), F.count("*").alias("n"))


def apply_changes(table: DataFrame, actions: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table without the rows of files that were removed or refreshed, with fresh's rows of the refreshed ones."""
    kept = table.join(actions.select(key), key, "left_anti")
    return kept.unionByName(fresh.join(actions.where("action = 'refresh'").select(key), key, "left_semi").select(*kept.columns))
