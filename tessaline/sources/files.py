"""Text sources: strict JSON lines, source files, backup catalogues, canonical snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessaline.functions.scalars import normal_text


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def source_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("bas", "cls", "frm")) -> DataFrame:
    """file (relative), text (line ends made LF) of the files with these extensions, case ignored."""
    both = [e for x in extensions for e in (x.lower(), x.upper())]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(both)}}}").text(path, wholetext=True)
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:(//)?", "")
    return files.select(F.substring(name, len(root) + 2, 100_000).alias("file"), normal_text(F.col("value")).alias("text"))


def canonical(rows: DataFrame, key: list[str], expected: DataFrame) -> DataFrame:
    """key, problem: expected keys that are missing and keys that are unexpected; no rows if all is well."""
    there = rows.select(*key).distinct()
    missing = expected.select(*key).distinct().join(there, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(there.join(expected.select(*key).distinct(), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def catalogue(records: DataFrame) -> DataFrame:
    """Backup records with state: valid, legacy (without a manifest) or invalid (without time or size)."""
    state = F.when(F.col("manifest").isNull(), "legacy").when(F.col("created_at").isNull() | F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "invalid").otherwise("valid")
    return records.withColumn("state", state)


def test_cases(symbols: DataFrame) -> DataFrame:
    """Test procedures of standard modules, one row per case, with whether their id repeats."""
    found = symbols.where("module_kind = 'standard' AND kind = 'sub'").where(F.lower("name").startswith("test"))
    rows = found.withColumn("case", F.explode_outer("cases")).withColumn("id", F.concat_ws("/", "module", "name", "case"))
    repeats = rows.groupBy("id").agg((F.count("*") > 1).alias("duplicate"))
    return rows.join(repeats, "id")
