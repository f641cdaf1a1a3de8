"""Documentation comments: blocks of ''' lines, their sections, what they document and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.functions.scalars import text_lines

# The notation of comments, sections, annotations and declarations.
DOC_LINE = r"^\s*'''"
HEADER = r"^\s*([A-Za-z][A-Za-z ]*?)\s*:\s*$"
ENTRY = r"^\s*([A-Za-z_]\w*)\s*:\s*(.*?)\s*$"
DESCRIPTION = r"""(?i)^\s*'@(?:Module)?Description\s*\(?\s*"((?:[^"]|"")*)"\s*\)?\s*$"""
DECLARATION = r"(?i)^\s*(?:(?:Public|Private|Friend|Global|Static)\s+)*(Sub|Function|Property\s+(?:Get|Let|Set))\s+([A-Za-z_]\w*)\s*(?:\((.*)\))?"
PARAMETER = r"(?i)^\s*(?:(?:Optional|ByVal|ByRef|ParamArray)\s+)*([A-Za-z_]\w*)"


def _parameters(listed: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda p: F.regexp_extract(p, PARAMETER, 1)), lambda p: p != "")


def doc_blocks(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, start_line, end_line, declaration_line, name, kind, parameters, summary, body, args, sections of each block of ''' lines.

    A block belongs to the declaration that follows it, blank lines and annotations between;
    else declaration_line, name, kind and parameters are null. Sections begin with a line
    "Name:"; what stands before the first is the summary, up to a blank line, and the body.
    args are the entries "name: description" of the section args, in order; sections maps
    all but the summary and args to their text, indentation removed. A description annotation
    between block and declaration is the summary of a block without one. Declarations of one
    line are known. A null text has no blocks. Lines are sorted by file; a file is one group.
    """
    by, doc = Window.partitionBy(*key).orderBy("line_no"), F.col("line").rlike(DOC_LINE)
    rows = docs.select(*key, F.posexplode(text_lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    rows = rows.withColumns({"doc": doc, "note": F.col("line").rlike(DESCRIPTION)})
    solid = F.when((F.trim("line") != "") & ~F.col("note"), F.struct("line_no", "line", "doc"))
    rows = rows.withColumn("solid", solid).withColumn("next", F.first("solid", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    begins = F.col("doc") & ~F.coalesce(F.lag("doc").over(by), F.lit(False))
    rows = rows.withColumn("block", F.sum(begins.cast("int")).over(by))
    declares = F.col("next.line").rlike(DECLARATION) & ~F.col("next.doc")
    notes = rows.where(F.col("note") & declares).groupBy(*key, F.col("next.line_no").alias("declaration_line")).agg(F.regexp_replace(F.max_by(F.regexp_extract("line", DESCRIPTION, 1), "line_no"), '""', '"').alias("note"))
    lines = rows.where("doc").withColumn("content", F.regexp_replace("line", rf"{DOC_LINE} ?", "")).withColumn("header", F.when(F.col("content").rlike(HEADER), F.lower(F.regexp_replace(F.regexp_extract("content", HEADER, 1), r"\s+", " "))))
    of_block = Window.partitionBy(*key, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(of_block), F.lit("")))
    at = F.sort_array(F.collect_list(F.when(F.col("header").isNull(), F.struct("line_no", "content"))))
    indent = F.min(F.when(F.col("header").isNull() & (F.trim("content") != ""), F.length("content") - F.length(F.ltrim("content"))))
    parts = lines.groupBy(*key, "block", "section").agg(at.alias("at"), indent.alias("indent"))
    body = F.array_join(F.transform("at", lambda x: F.rtrim(F.substr(x["content"], F.coalesce("indent", F.lit(0)) + 1))), "\n")
    entries = F.filter(F.transform("at", lambda x: F.struct(F.regexp_extract(x["content"], ENTRY, 1).alias("name"), F.regexp_extract(x["content"], ENTRY, 2).alias("description"))), lambda e: e["name"] != "")
    parts = parts.withColumn("body", F.regexp_replace(body, r"^\n+|\n+$", "")).withColumn("entries", entries)
    merged = parts.groupBy(*key, "block").agg(
        F.max(F.when(F.col("section") == "", F.col("body"))).alias("lead"),
        F.max(F.when(F.col("section") == "args", F.col("entries"))).alias("args"),
        F.map_from_entries(F.collect_list(F.when(~F.col("section").isin("", "args") & (F.col("body") != ""), F.struct("section", "body")))).alias("sections"),
    )
    places = lines.groupBy(*key, "block").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max_by("next", "line_no").alias("next"))
    linked = F.coalesce(declares, F.lit(False))
    part = lambda n: F.when(linked, F.regexp_extract("next.line", DECLARATION, n))
    found = places.join(merged, [*key, "block"]).select(
        *key, "start_line", "end_line", F.when(linked, F.col("next.line_no")).alias("declaration_line"), part(2).alias("name"), F.lower(F.regexp_replace(part(1), r"\s+", "_")).alias("kind"),
        F.when(linked, _parameters(part(3))).alias("parameters"), "lead", F.coalesce("args", F.array().cast("array<struct<name: string, description: string>>")).alias("args"), "sections",
    )
    cut = F.split(F.coalesce("lead", F.lit("")), "\n\\s*\n", 2)
    found = found.join(notes, [*key, "declaration_line"], "left")
    own = F.trim(F.get(cut, F.lit(0)))
    return found.select(*key, "start_line", "end_line", "declaration_line", "name", "kind", "parameters", F.when(own != "", own).otherwise(F.coalesce("note", F.lit(""))).alias("summary"), F.coalesce(F.trim(F.get(cut, F.lit(1))), F.lit("")).alias("body"), "args", "sections")


def validate(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, line, code, name, suggestion of what is wrong with doc_blocks().

    VB040: an entry for a parameter that the declaration doesn't have, with the closest one
    as suggestion (one letter off, two for names of four or more). VB041: an entry whose name
    an earlier one has, case ignored. VB042: a Returns section of a Sub. VB043: a block
    without a declaration.
    """
    each = blocks.where("declaration_line IS NOT NULL").select(*key, "start_line", "parameters", F.posexplode("args").alias("_at", "_arg")).withColumn("name", F.col("_arg.name"))
    again = F.row_number().over(Window.partitionBy(*key, "start_line", F.lower("name")).orderBy("_at")) > 1
    near = F.transform("parameters", lambda p, i: F.struct(F.levenshtein(F.lower(p), F.lower("name")).alias("d"), i.alias("i"), p.alias("p")))
    close = F.array_min(F.filter(near, lambda n: n["d"] <= F.when(F.length("name") >= 4, 2).otherwise(1)))
    strange = ~F.exists("parameters", lambda p: F.lower(p) == F.lower("name"))
    entries = each.withColumn("code", F.when(again, "VB041").when(strange, "VB040")).where("code IS NOT NULL")
    out = entries.select(*key, F.col("start_line").alias("line"), "code", "name", F.when(F.col("code") == "VB040", close["p"]).alias("suggestion"))
    whole = F.when(F.col("declaration_line").isNull(), "VB043").when((F.col("kind") == "sub") & F.coalesce(F.trim(F.try_element_at("sections", F.lit("returns"))) != "", F.lit(False)), "VB042")
    return out.union(blocks.select(*key, F.col("start_line").alias("line"), whole.alias("code"), "name", F.lit(None).cast("string").alias("suggestion")).where("code IS NOT NULL"))
