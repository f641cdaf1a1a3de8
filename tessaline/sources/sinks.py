"""Sinks: JSON lines, one folder per sheet, checked snapshots, text reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions.scalars import sheet_slug
from tessaline.operators.ranking import numbered_names


def publish(path: str, spark: SparkSession, write: Callable[[str], None]) -> None:
    """Lets write() fill a folder beside path and moves it to path when it is complete.

    If writing fails the old folder stays as it was. The old one is moved aside before the
    new one comes in, moved back if that fails, and deleted at the end.
    """
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    at = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old)}
    files = at[path].getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new)
    except Exception:
        files.delete(at[new], True)
        raise
    there = files.exists(at[path])
    if there and not files.rename(at[path], at[old]):
        raise OSError(f"{path} can't be moved aside; the new folder is {new}")
    if not files.rename(at[new], at[path]):
        if there:
            files.rename(at[old], at[path])
        raise OSError(f"{new} can't be moved to {path}")
    files.delete(at[old], True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A row per line, null fields left out; an old table is replaced when the new one is complete."""
    publish(path, df.sparkSession, lambda new: df.write.option("ignoreNullFields", "true").json(new))


def sheet_paths(sheets: DataFrame) -> DataFrame:
    """sheets with path '000-Name', numbered and made unique."""
    base = sheets.withColumn("_base", F.concat(F.lpad(F.col("index").cast("string"), 3, "0"), F.lit("-"), sheet_slug(F.col("name"))))
    return numbered_names(base, "_base", ["index", "name"], "path").drop("_base")


def write_by_sheet(rows: DataFrame, sheets: DataFrame, path: str) -> None:
    """JSON lines in a folder per sheet; the sheets' table is small and joined by name."""
    named = rows.join(sheet_paths(sheets).select(F.col("name").alias("sheet"), F.col("path").alias("sheet_path")), "sheet")
    publish(path, rows.sparkSession, lambda new: named.write.partitionBy("sheet_path").json(new))


def write_checked(df: DataFrame, path: str, problems: DataFrame) -> None:
    """Writes df only if there are no problems, else raises with the first few."""
    if found := problems.limit(5).collect():
        raise ValueError(f"not written: {[r.asDict() for r in found]}")
    write_jsonl(df, path)


def write_checked_set(tables: dict[str, tuple[DataFrame, DataFrame]], path: str) -> None:
    """Writes tables (name: rows, problems) as JSON lines into folders of path, all of them or none.

    All problems are looked at before anything is written, and the set takes the place of the
    old one when the last table is complete. An empty set writes nothing.
    """
    found = {name: [r.asDict() for r in problems.limit(5).collect()] for name, (_, problems) in tables.items()}
    if found := {name: rows for name, rows in found.items() if rows}:
        raise ValueError(f"not written: {found}")

    def write(new: str) -> None:
        for name, (df, _) in tables.items():
            df.write.option("ignoreNullFields", "true").json(f"{new}/{name}")

    if tables:
        publish(path, next(iter(tables.values()))[0].sparkSession, write)


def report_line(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def envelope(df: DataFrame, command: str) -> DataFrame:
    """A JSON text per row: {"command": …, "row": …}."""
    return df.select(F.to_json(F.struct(F.lit(command).alias("command"), F.struct("*").alias("row"))).alias("json"))
