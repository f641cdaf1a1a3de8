"""Strict JSON lines: every fault is named by file and line, also in files that are read in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessaline import storage

#: Fixed value: the longest line in bytes.
MOST_BYTES = 8 << 20


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where the piece of the file begins that the line was read in), line_no (from 1), line.

    A file is read in as many pieces as Spark likes. The lines of each piece are counted
    first; what stands before a piece is the sum of the pieces before it. Both reads see the
    same pieces, as they depend on the files and the settings alone.
    """
    at = F.monotonically_increasing_id().alias("_at")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at, F.col("value").alias("line"))
    pieces = storage.save(lines.groupBy("file", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = lines.join(storage.broadcast_if_small(starts), ["file", "block"])
    return rows.select("file", "block", (F.col("_start") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def _misplaced(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows (file, block, line_no, _row) with _order, what is wrong with the keys that don't come after the one before them."""
    named = rows.withColumn("_key", F.struct(*(F.col("_row")[k].alias(k) for k in key)))
    lasts = storage.save(named.groupBy("file", "block").agg(F.max_by("_key", "line_no").alias("_last"), F.max("line_no").alias("_last_no")), "lasts")
    files, piece = Window.partitionBy("file").orderBy("block"), Window.partitionBy("file", "block").orderBy("line_no")
    before = lasts.select("file", "block", F.lag("_last").over(files).alias("_last"), F.lag("_last_no").over(files).alias("_last_no"))
    joined = named.join(storage.broadcast_if_small(before), ["file", "block"])
    previous, line = F.coalesce(F.lag("_key").over(piece), F.col("_last")), F.coalesce(F.lag("line_no").over(piece), F.col("_last_no"))
    problem = F.when(previous.eqNullSafe(F.col("_key")), F.concat(F.lit("repeats the key of line "), line.cast("string"))).when(previous > F.col("_key"), F.concat(F.lit("belongs before line "), line.cast("string")))
    return joined.withColumn("_order", problem).drop("_key", "_last", "_last_no")


def checked_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, key: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of schema, and file, line_no, problem (null if the line is sound) of each line that isn't blank.

    A line is faulty if it has more than most_bytes bytes, isn't a JSON object that fits the
    schema, has a field that schema doesn't name, or, with a key, doesn't come after the line
    before it in its file by that key, nulls first, each key once. Empty files give no rows.
    Each file has an order of its own.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, bad = [f.name for f in schema], "_corrupt"
    read = StructType([*schema.fields]).add(bad, StringType())
    lines = numbered_lines(spark, path).where(F.trim("line", F.lit(" \t\r")) != "")
    rows = lines.withColumn("_row", F.from_json("line", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    strange = F.array_except(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), F.array(*(F.lit(n) for n in names)))
    problem = F.when(F.octet_length("line") > most_bytes, f"has more than {most_bytes} bytes")
    problem = problem.when(F.col("_row").isNull() | F.col(f"_row.{bad}").isNotNull() | ~F.startswith(F.ltrim("line"), F.lit("{")), "isn't a JSON object of the schema")
    problem = problem.when(F.size(strange) > 0, F.concat(F.lit("has a field that isn't known: "), F.get(strange, F.lit(0))))
    rows = rows.withColumn("_problem", problem)
    if key:
        rows = _misplaced(rows, key)
    return rows.select(*(F.col("_row")[n].alias(n) for n in names), "file", "line_no", (F.coalesce("_problem", "_order") if key else F.col("_problem")).alias("problem"))


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, key: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of checked_jsonl(), without its further columns; the first fault that is met fails the read and says where it is."""
    rows = checked_jsonl(spark, path, schema, key, most_bytes)
    names = [c for c in rows.columns if c not in ("file", "line_no", "problem")]
    fault = F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": the line "), F.col("problem")))
    first = F.when(F.col("problem").isNull(), F.col(f"`{names[0]}`")).otherwise(fault.cast(rows.schema[names[0]].dataType)).alias(names[0])
    return rows.select(first, *(f"`{n}`" for n in names[1:]))
