"""Spreadsheet formulas as column expressions: tokens, relative patterns, features, shifts.

A pattern finds the units of interest; what lies between stays as it is. Splitting by the
pattern and extracting it give the two halves of a formula, which are zipped together
again, so everything stays inside the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.functions.scalars import column_letters, column_number

_STRING = '"(?:[^"]|"")*"?'
_QUOTED = "'(?:[^']|'')*'"
_NAME = r"[\p{L}_\\][\p{L}\p{N}_.]*"
_SHEET = rf"(?:(?:{_QUOTED}|{_NAME})!)?"
_CELL = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}"
_AREA = rf"(?:{_CELL}(?::{_CELL})?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|\$?[1-9][0-9]{{0,6}}:\$?[1-9][0-9]{{0,6}})"
_START, _END = r"(?<![\p{L}\p{N}_.$!'])", r"(?![\p{L}\p{N}_.(!])"
_REF = rf"{_SHEET}{_AREA}{_END}"

#: Features in the order in which they are looked for, then plain references.
UNITS = {
    "string": _STRING,
    "external_reference": rf"\[[^\]]*\][^!'\"]*!{_AREA}{_END}|'[^']*\[[^']*'!{_AREA}{_END}",
    "3d_reference": rf"{_START}(?:{_QUOTED}|{_NAME}):(?:{_QUOTED}|{_NAME})!{_AREA}{_END}",
    "structured_reference": rf"{_START}{_NAME}\[(?:[^\[\]]|\[[^\[\]]*\])*(?:\]|$)",
    "implicit_intersection": rf"@{_REF}",
    "spill_reference": rf"{_START}{_REF}#",
    "reference": rf"{_START}{_REF}",
}
FEATURES = [k for k in UNITS if k not in ("string", "reference")]
_ANY = "|".join(f"(?:{p})" for p in UNITS.values())

#: Kinds of tokens with their patterns, in order of precedence.
TOKENS = {
    "whitespace": r"\s+",
    "string": _STRING,
    "quoted_name": "'(?:[^']|'')*'?",
    "error": r"#[A-Za-z0-9/]+[!?]?",
    "number": r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[Ee][+-]?[0-9]+)?",
    "identifier": r"[\p{L}_$\\][\p{L}\p{N}_.$]*",
    "operator": r"<>|<=|>=|[-+*/^&=<>%@]",
    "punctuation": r"[(),;:!{}\[\]#]",
    "unknown": r"(?s).",
}


def tokens(formula: Column) -> Column:
    """An array of structs (kind, text, start, end) that cover a formula; ends are exclusive."""
    found = F.regexp_extract_all(formula, F.lit("|".join(f"(?:{p})" for p in TOKENS.values())), F.lit(0))
    kind = lambda t: F.coalesce(*(F.when(t.rlike(f"^(?:{p})$"), k) for k, p in TOKENS.items()))
    empty = F.array().cast("array<struct<kind:string,text:string,start:int,end:int>>")
    step = lambda acc, t: F.concat(acc, F.array(F.struct(kind(t).alias("kind"), t.alias("text"), _last(acc).alias("start"), (_last(acc) + F.length(t)).alias("end"))))
    return F.aggregate(found, empty, step)


def _last(acc: Column) -> Column:
    return F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))


def units(formula: Column) -> Column:
    """An array of structs (kind, text) of a formula's strings, features and references in order."""
    kind = lambda u: F.coalesce(*(F.when(u.rlike(rf"^(?:{p})\z"), k) for k, p in UNITS.items()), F.lit("reference"))
    return F.transform(F.regexp_extract_all(formula, F.lit(_ANY), F.lit(0)), lambda u: F.struct(kind(u).alias("kind"), u.alias("text")))


def _rewritten(formula: Column, pattern: str, found: Column) -> Column:
    """A formula with what the pattern finds replaced by found, one for each place."""
    return F.array_join(F.flatten(F.zip_with(F.split(formula, pattern, -1), found, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")


def _reference(text: Column, endpoint: Callable[[Column], Column]) -> Column:
    sheet = F.regexp_extract(text, rf"^({_SHEET})", 1)
    area = F.substring(text, F.length(sheet) + 1, F.length(text))
    ends = F.transform(F.split(area, ":"), endpoint)
    return F.concat(sheet, F.array_join(ends, ":"))


def _relative(row: Column, col: Column) -> Callable[[Column], Column]:
    def render(end: Column) -> Column:
        letters, digits = F.upper(F.regexp_extract(end, "([A-Za-z]+)", 1)), F.regexp_extract(end, "([0-9]+)", 1)
        part = lambda mark, value, base, fixed: F.when(fixed, F.concat(F.lit(mark), value.cast("string"))).when(value == base, mark).otherwise(F.concat(F.lit(f"{mark}["), (value - base).cast("string"), F.lit("]")))
        rows = F.when(digits == "", "").otherwise(part("R", digits.try_cast("int"), row, end.rlike(r"\$[0-9]")))
        return F.concat(rows, F.when(letters == "", "").otherwise(part("C", column_number(letters), col, end.rlike(r"\$[A-Za-z]"))))

    return render


def pattern_of(formula: Column, row: Column, col: Column) -> Column:
    """A struct (formula_r1c1, status, features) of an A1 formula as seen from its cell.

    failed: the cell is not positive; partial: a feature or an unterminated literal is
    there; else ok. Texts of features stay as they are.
    """
    found = units(formula)
    rendered = F.transform(found, lambda u: F.when(u["kind"] == "reference", _reference(u["text"], _relative(row, col))).otherwise(u["text"]))
    features = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda u: u["kind"].isin(FEATURES)), lambda u: u["kind"])))
    open_ = F.exists(found, lambda u: (u["kind"] == "string") & ~u["text"].rlike('^"(?:[^"]|"")*"$')) | F.exists(found, lambda u: (u["kind"] == "structured_reference") & ~u["text"].endswith("]"))
    sound = F.coalesce((row > 0) & (col > 0), F.lit(False))
    status = F.when(~sound, "failed").when((F.size(features) > 0) | open_, "partial").otherwise("ok")
    return F.struct(F.when(sound, _rewritten(formula, _ANY, rendered)).otherwise(formula).alias("formula_r1c1"), status.alias("status"), features.alias("features"))


def shifted(formula: Column, rows: Column, cols: Column) -> Column:
    """A formula as copied so many rows down and columns right: relative ends move, fixed ones stay."""

    def move(end: Column) -> Column:
        letters, digits = F.upper(F.regexp_extract(end, "([A-Za-z]+)", 1)), F.regexp_extract(end, "([0-9]+)", 1)
        col = F.when(letters == "", "").when(end.rlike(r"\$[A-Za-z]"), F.concat(F.lit("$"), letters)).otherwise(column_letters(column_number(letters) + cols))
        row = F.when(digits == "", "").when(end.rlike(r"\$[0-9]"), F.concat(F.lit("$"), digits)).otherwise((digits.try_cast("int") + rows).cast("string"))
        return F.concat(col, row)

    moved = F.transform(units(formula), lambda u: F.when(u["kind"] == "reference", _reference(u["text"], move)).otherwise(u["text"]))
    return _rewritten(formula, _ANY, moved)


_R1C1 = rf"{_STRING}|{_QUOTED}|(?<![\p{{L}}\p{{N}}_.])R(?:[0-9]+|\[-?[0-9]+\])?C(?:[0-9]+|\[-?[0-9]+\])?(?![\p{{L}}\p{{N}}_.(\[])"


def expanded(pattern: Column, row: Column, col: Column) -> Column:
    """The A1 formula of an R1C1 pattern at a cell; null if a reference leaves the sheet."""

    def cell(text: Column) -> Column:
        fixed = lambda mark: F.regexp_extract(text, rf"{mark}([0-9]+)", 1)
        offset = lambda mark: F.coalesce(F.regexp_extract(text, rf"{mark}\[(-?[0-9]+)\]", 1).try_cast("int"), F.lit(0))
        place = lambda mark, base: F.when(fixed(mark) != "", fixed(mark).try_cast("int")).otherwise(base + offset(mark))
        mark = lambda m: F.when(fixed(m) != "", "$").otherwise("")
        rows = place("R", row)
        return F.when(rows > 0, F.concat(mark("C"), column_letters(place("C", col)), mark("R"), rows.cast("string")))

    found = F.regexp_extract_all(pattern, F.lit(_R1C1), F.lit(0))
    made = F.transform(found, lambda u: F.when(u.rlike("^[\"']"), u).otherwise(cell(u)))
    return F.when(~F.exists(made, lambda u: u.isNull()), _rewritten(pattern, _R1C1, made))


def functions(formula: Column) -> Column:
    """Names before an opening bracket, upper case, distinct, in order; names in strings don't count."""
    bare = F.regexp_replace(formula, f"{_STRING}|{_QUOTED}", '""')
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(?<![\p{L}\p{N}_.!])([\p{L}_][\p{L}\p{N}_.]*)\s*\("), F.lit(1)), F.upper)))


def sheets(formula: Column) -> Column:
    """Names of the sheets that references name, unquoted, distinct, in order."""
    named = F.filter(units(formula), lambda u: (u["kind"] == "reference") & u["text"].contains("!"))
    bare = F.transform(named, lambda u: F.regexp_replace(F.regexp_replace(F.regexp_extract(u["text"], "^(.*)!", 1), "^'|'$", ""), "''", "'"))
    return F.array_sort(F.array_distinct(bare))


def folded_string(expression: Column) -> Column:
    """The value of "a" & "b" & …; null if anything else is there."""
    literal = r'\s*"(?:[^"]|"")*"\s*'
    parts = F.regexp_extract_all(expression, F.lit('"((?:[^"]|"")*)"'), F.lit(1))
    return F.when(expression.rlike(rf"^{literal}(?:&{literal})*$"), F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit('""'), F.lit('"'))), ""))
