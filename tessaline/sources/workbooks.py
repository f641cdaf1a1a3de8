"""Workbook files (zipped XML) as DataFrames: parts, sheets, names, cells, styles."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.functions.scalars import cell_point

_PARTS = pa.schema([("workbook", pa.string()), ("part", pa.string()), ("content", pa.binary())])


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if name.endswith((".xml", ".rels")):
                        yield pa.RecordBatch.from_pydict({"workbook": [path], "part": [posixpath.normpath(name.replace("\\", "/")).lstrip("/")], "content": [z.read(name)]}, schema=_PARTS)


def parts(spark: SparkSession, path: str, glob: str = "*.xls[xm]") -> DataFrame:
    """workbook, part, content of the XML parts of all workbooks under path; a file per task row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_unzipped, "workbook string, part string, content binary")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(wanted: dict[str, list[str]], children: tuple[str, ...] = ()):
    """Streams XML parts and yields a row per wanted element: its attributes, its text and children's texts and attributes."""
    names = sorted({a for attributes in wanted.values() for a in attributes})
    fields = ["workbook", "part", "place", "element", "text", *names, *(f"{c}_{x}" for c in children for x in ("text", "t", "ref", "si"))]
    schema = pa.schema([(f, pa.int32() if f == "place" else pa.string()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for book, part, content in zip(*(batch.column(c).to_pylist() for c in ("workbook", "part", "content")), strict=True):
                place = 0
                for _, node in ET.iterparse(io.BytesIO(content)):
                    kind = _local(node.tag)
                    if kind in wanted:
                        row = {"workbook": book, "part": part, "place": place, "element": kind, "text": node.text} | {_local(k): v for k, v in node.attrib.items() if _local(k) in names}
                        for child in node:
                            if (c := _local(child.tag)) in children:
                                row |= {f"{c}_text": child.text or ""} | {f"{c}_{k}": v for k, v in child.attrib.items() if k in ("t", "ref", "si")}
                        rows.append(row)
                        place += 1
                    if kind not in children:
                        node.clear()
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields} for r in rows], schema=schema)

    return run, ", ".join(f"`{f}` {'int' if f == 'place' else 'string'}" for f in fields)


def _read(found: DataFrame, wanted: dict[str, list[str]], children: tuple[str, ...] = ()) -> DataFrame:
    return found.select("workbook", "part", "content").mapInArrow(*_elements(wanted, children))


def relationships(found: DataFrame) -> DataFrame:
    """workbook, id, path of what the workbook part refers to; absolute targets lose their slash."""
    rels = _read(found.where("part = 'xl/_rels/workbook.xml.rels'"), {"Relationship": ["Id", "Target"]})
    path = F.when(F.col("Target").startswith("/"), F.substring("Target", 2, 10_000)).otherwise(F.concat(F.lit("xl/"), "Target"))
    return rels.select("workbook", F.col("Id").alias("rel_id"), path.alias("path"))


def sheets(found: DataFrame) -> DataFrame:
    """workbook, index, name, sheet_id, state, path of each sheet; a missing relationship leaves path null."""
    rows = _read(found.where("part = 'xl/workbook.xml'"), {"sheet": ["name", "sheetId", "id", "state"]})
    rows = rows.select("workbook", F.col("place").alias("index"), "name", F.col("sheetId").alias("sheet_id"), F.coalesce("state", F.lit("visible")).alias("state"), F.col("id").alias("rel_id"))
    return rows.join(relationships(found), ["workbook", "rel_id"], "left")


def defined_names(found: DataFrame) -> DataFrame:
    """workbook, name, formula (trimmed, with a leading =), local_sheet_id, local_sheet_id_raw, hidden."""
    rows = _read(found.where("part = 'xl/workbook.xml'"), {"definedName": ["name", "localSheetId", "hidden"]})
    body = F.trim(F.coalesce("text", F.lit("")))
    return rows.select("workbook", "name", F.when(body.startswith("="), body).otherwise(F.concat(F.lit("="), body)).alias("formula"), F.col("localSheetId").try_cast("int").alias("local_sheet_id"), F.col("localSheetId").alias("local_sheet_id_raw"), F.coalesce(F.col("hidden") == "1", F.lit(False)).alias("hidden"))


def cells(found: DataFrame) -> DataFrame:
    """sheet, row, col, kind, shared_index, shared_ref, formula, value, value_type of all cells of all sheets.

    kind is the formula's storage (normal, shared, array), null for plain values. Values of
    the shared string table are indexes into it.
    """
    listed = sheets(found).select("workbook", F.col("name").alias("sheet"), F.col("path").alias("part"))
    rows = _read(found.where("part LIKE 'xl/worksheets/%.xml'"), {"c": ["r", "t", "s"]}, ("f", "v"))
    rows = rows.join(listed, ["workbook", "part"]).withColumn("p", cell_point(F.col("r")))
    formula = F.when(F.coalesce("f_text", F.lit("")) != "", F.concat(F.lit("="), F.ltrim(F.col("f_text"), F.lit("=")))).otherwise(F.when(F.col("f_text").isNotNull(), ""))
    kind = F.when(F.col("f_text").isNotNull(), F.coalesce("f_t", F.lit("normal")))
    return rows.select("workbook", "sheet", "p.row", "p.col", kind.alias("kind"), F.col("f_si").alias("shared_index"), F.col("f_ref").alias("shared_ref"), formula.alias("formula"), F.col("v_text").alias("value"), F.coalesce("t", F.lit("n")).alias("value_type"), F.col("s").alias("style"))


def formula_cells(found: DataFrame) -> DataFrame:
    return cells(found).where("kind is not null")


def merged_ranges(found: DataFrame) -> DataFrame:
    """workbook, sheet, ref of merged cells."""
    listed = sheets(found).select("workbook", F.col("name").alias("sheet"), F.col("path").alias("part"))
    rows = _read(found.where("part LIKE 'xl/worksheets/%.xml'"), {"mergeCell": ["ref"]})
    return rows.join(listed, ["workbook", "part"]).select("workbook", "sheet", "ref")
