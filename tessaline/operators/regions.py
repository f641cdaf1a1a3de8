"""Formula snapshots: cells to regions with outliers, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions import formulas
from tessaline.functions.scalars import column_letters, range_info
from tessaline.operators.ranking import overlay
from tessaline.operators.resolve import expand
from tessaline.operators.runs import outliers, runs


def shared_cells(cells: DataFrame) -> DataFrame:
    """cells (sheet, row, col, kind, shared_index, shared_ref, formula) with followers filled in.

    An anchor's formula is copied to every cell of its rectangle, shifted; explicit
    formulas win over copies. A follower without an anchor, or whose anchor's rectangle is
    malformed, stays with a null formula and status failed.
    """
    shared = cells.where("kind = 'shared'")
    anchors = shared.where("coalesce(formula, '') <> ''").withColumn("i", range_info(F.col("shared_ref")))
    sound = anchors.where("i.cells is not null").select("sheet", "shared_index", "formula", F.col("row").alias("row0"), F.col("col").alias("col0"), "i.r0", "i.r1", "i.c0", "i.c1")
    copies = expand(sound, "r0", "r1", "c0", "c1").select("sheet", "row", "col", formulas.shifted(F.col("formula"), F.col("row") - F.col("row0"), F.col("col") - F.col("col0")).alias("formula"), F.lit("shared").alias("storage"), F.lit(1).alias("priority"))
    explicit = cells.where("kind <> 'shared' AND coalesce(formula, '') <> ''").select("sheet", "row", "col", "formula", F.col("kind").alias("storage"), F.lit(2).alias("priority"))
    orphans = shared.select("sheet", "row", "col", F.when(F.col("formula") != "", F.col("formula")).alias("formula"), F.lit("shared").alias("storage"), F.lit(0).alias("priority"))
    return overlay(copies.union(explicit).union(orphans), ["sheet", "row", "col"], "priority", ["storage", "formula"])


def regions(cells: DataFrame) -> DataFrame:
    """Regions of cells (sheet, row, col, formula, storage): one per run of equal patterns down a column.

    Returns sheet, range, formula_r1c1 (if ok), formula (if not), example_cell,
    example_formula, count, parse_status, features, functions, depends_on_sheets,
    storage_kinds and is_outlier.
    """
    p = F.col("p")
    made = cells.withColumn("p", formulas.pattern_of(F.coalesce("formula", F.lit("")), F.col("row"), F.col("col"))).withColumn("status", F.when(F.col("formula").isNull(), "failed").otherwise(p["status"]))
    keyed = made.select("sheet", "col", "row", "formula", "storage", F.col("status").alias("parse_status"), F.when(F.col("status") == "ok", p["formula_r1c1"]).alias("formula_r1c1"), F.when(F.col("status") != "ok", F.col("formula")).alias("raw"), p["features"].alias("features"))
    key = ["formula_r1c1", "raw", "parse_status", "features"]
    found = outliers(runs(keyed, ["sheet", "col"], ["row", "formula", "storage"], key, "row"), ["sheet", "col"], key)
    inside = keyed.select("sheet", "col", "row", "storage").alias("k")
    kinds = found.alias("f").join(inside, (F.col("f.sheet") == F.col("k.sheet")) & (F.col("f.col") == F.col("k.col")) & F.col("k.row").between(F.col("f.first.row"), F.col("f.last.row")))
    kinds = kinds.groupBy(F.col("f.sheet").alias("sheet"), F.col("f.col").alias("col"), F.col("f.run_no").alias("run_no")).agg(F.array_sort(F.collect_set("k.storage")).alias("storage_kinds"))
    cell = lambda row: F.concat(column_letters(F.col("col")), row.cast("string"))
    first, last = F.col("first.row"), F.col("last.row")
    area = F.when(first == last, cell(first)).otherwise(F.concat_ws(":", cell(first), cell(last)))
    text = F.coalesce("first.formula", F.lit(""))
    return found.join(kinds, ["sheet", "col", "run_no"]).select(
        "sheet", area.alias("range"), "formula_r1c1", F.col("raw").alias("formula"), cell(first).alias("example_cell"), F.col("first.formula").alias("example_formula"), F.col("n").alias("count"), "parse_status", "features",
        formulas.functions(text).alias("functions"), formulas.sheets(text).alias("depends_on_sheets"), "storage_kinds", "is_outlier", "col", first.alias("start_row"), last.alias("end_row"),
    )


def used_ranges(cells: DataFrame) -> DataFrame:
    """sheet, first and last row and column, and how many cells there are."""
    return cells.groupBy("sheet").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("cells"))


def window_of(cells: DataFrame, sheet: str, address: str, max_rows: int, max_cols: int) -> DataFrame:
    """The cells of a sheet's range, at most so many rows and columns, with truncated."""
    rows = cells.where(F.col("sheet") == sheet).withColumn("i", range_info(F.lit(address)))
    inside = rows.where("row BETWEEN i.r0 AND i.r1 AND col BETWEEN i.c0 AND i.c1")
    cut = (F.col("i.r1") - F.col("i.r0") >= max_rows) | (F.col("i.c1") - F.col("i.c0") >= max_cols)
    return inside.where((F.col("row") < F.col("i.r0") + max_rows) & (F.col("col") < F.col("i.c0") + max_cols)).withColumn("truncated", cut).drop("i")


def region_at(found: DataFrame, sheet: str, address: str) -> DataFrame:
    """The first region, in order of row, column and range, that holds a cell, with its formula there."""
    at = range_info(F.lit(address))
    hits = found.where(F.col("sheet") == sheet).where((at["c0"] == F.col("col")) & at["r0"].between(F.col("start_row"), F.col("end_row")))
    first = hits.orderBy("start_row", "col", "range").limit(1)
    return first.withColumn("formula_here", F.coalesce(formulas.expanded(F.col("formula_r1c1"), at["r0"], at["c0"]), "formula"))


def regions_in(found: DataFrame, sheet: str, address: str) -> DataFrame:
    """The regions that overlap a range."""
    at = range_info(F.lit(address))
    return found.where(F.col("sheet") == sheet).where(F.col("col").between(at["c0"], at["c1"]) & (F.col("start_row") <= at["r1"]) & (F.col("end_row") >= at["r0"]))


def summary(found: DataFrame) -> DataFrame:
    """Per sheet: regions, cells, status counts, and distinct features and sheets depended on."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return found.groupBy("sheet").agg(F.count("*").alias("regions"), F.sum("count").alias("cells"), *(F.count_if(F.col("parse_status") == s).alias(s) for s in ("ok", "partial", "failed")), merged("features"), merged("depends_on_sheets"))


def ordered_names(names: DataFrame) -> DataFrame:
    """Defined names with their place: of the workbook first, then by sheet, malformed scopes last."""
    scope = F.when(F.col("local_sheet_id_raw").isNull(), -1).otherwise(F.coalesce(F.col("local_sheet_id_raw").try_cast("int"), F.lit(1 << 30)))
    return names.withColumn("place", F.row_number().over(Window.partitionBy("workbook").orderBy(scope, F.lower("name"), "name")))
