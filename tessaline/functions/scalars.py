"""Text, coordinate, size and checked-arithmetic functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def text_lines(text: Column) -> Column:
    """The lines of a text; one newline at the end adds none, an empty or null text has none."""
    body = F.regexp_replace(normal_text(F.coalesce(text, F.lit(""))), "\n\\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def sheet_slug(name: Column) -> Column:
    """Letters and digits kept, runs of others one hyphen, none at the ends; 'Sheet' if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{Nd}]+", "-"), "^-|-$", "")
    return F.when(slug == "", "Sheet").otherwise(slug)


def last_name_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def without_comment(line: Column) -> Column:
    """A line up to an apostrophe that is not inside a string literal; doubled quotes stay inside."""
    return F.regexp_extract(line, "^((?:[^\"']++|\"(?:[^\"]++|\"\")*+(?:\"|$))*+)", 1)


def masked_strings(line: Column) -> Column:
    """A line with its string literals blanked out, quotes kept."""
    return F.regexp_replace(line, '"(?:[^"]++|"")*+"', '""')


def statements(line: Column) -> Column:
    """The statements of a line, cut at colons outside of strings and comments: structs of column (from 1) and text; blank ones are left out."""
    pieces = F.regexp_extract_all(without_comment(line), F.lit('("(?:[^"]|"")*"?|[^":]+|:)'), F.lit(1))
    start = F.struct(F.lit(1).alias("at"), F.array(F.struct(F.lit(1).alias("column"), F.lit("").alias("text"))).alias("found"))

    def add(acc: Column, piece: Column) -> Column:
        last, at = F.element_at(acc["found"], -1), acc["at"] + F.length(piece)
        longer = F.concat(F.slice(acc["found"], F.lit(1), F.size(acc["found"]) - 1), F.array(F.struct(last["column"].alias("column"), F.concat(last["text"], piece).alias("text"))))
        return F.struct(at.alias("at"), F.when(piece == ":", F.concat(acc["found"], F.array(F.struct(at.alias("column"), F.lit("").alias("text"))))).otherwise(longer).alias("found"))

    found = F.aggregate(pieces, start, add)["found"]
    trimmed = F.transform(found, lambda s: F.struct((s["column"] + F.length(s["text"]) - F.length(F.ltrim(s["text"]))).alias("column"), F.trim(s["text"]).alias("text")))
    return F.filter(trimmed, lambda s: s["text"] != "")


def sheet_selector(selector: Column) -> Column:
    """A struct (sheet, address) of "'It''s'!A1:B2" or "Sheet!A1"; nulls if it is neither."""
    quoted = F.regexp_replace(F.regexp_extract(selector, r"^'((?:[^']|'')+)'!([^!']+)$", 1), "''", "'")
    plain = F.regexp_extract(selector, r"^([^'!]+)!([^!']+)$", 1)
    sheet = F.when(quoted != "", quoted).when(plain != "", plain)
    return F.struct(sheet.alias("sheet"), F.when(sheet.isNotNull(), F.upper(F.regexp_extract(selector, r"!([^!']+)$", 1))).alias("address"))


def size_bytes(value: Column) -> Column:
    """Bytes of '10', '10KB', '1.5 MB', '2gib' and the like (powers of 1024); null if malformed."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGTkmgt]?)(?:[iI]?[bB])?\s*$"
    power = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in (("", 1.0), ("K", 2.0**10), ("M", 2.0**20), ("G", 2.0**30), ("T", 2.0**40)) for x in pair)), F.upper(F.regexp_extract(value, pattern, 2))), F.lit(1.0))
    return F.when(value.rlike(pattern), (F.regexp_extract(value, pattern, 1).try_cast("double") * power).cast("long"))


def duration_hours(value: Column) -> Column:
    """Hours of '36h', '7d' or '2w'; null if malformed."""
    pattern = r"^\s*([0-9]+)\s*([hdwHDW])\s*$"
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    hours = F.when(unit == "h", 1).when(unit == "d", 24).otherwise(168)
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1).try_cast("long") * hours)


def column_letters(number: Column) -> Column:
    """1 is A, 26 Z, 27 AA, up to 18,278 (ZZZ); null outside."""
    n = number.cast("int")
    letter = lambda x: F.char(F.lit(65) + x)
    one, two, three = n - 1, n - 27, n - 703
    return (
        F.when((n < 1) | (n > 18278), F.lit(None).cast("string"))
        .when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def column_number(letters: Column) -> Column:
    """AB is 28; null unless all are letters."""
    digits = F.split(F.upper(letters), "")
    value = F.aggregate(digits, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    return F.when(letters.rlike("^[A-Za-z]{1,3}$"), value)


def cell_point(address: Column) -> Column:
    """A struct (row, col) of 'B7' or '$B$7'; nulls if malformed."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$"
    sound = address.rlike(pattern)
    return F.struct(F.when(sound, F.regexp_extract(address, pattern, 2).try_cast("int")).alias("row"), F.when(sound, column_number(F.regexp_extract(address, pattern, 1))).alias("col"))


def range_info(address: Column) -> Column:
    """A struct (r0, c0, r1, c1, cells) of 'A1:B2' or 'A1'; nulls if malformed or reversed."""
    start, end = cell_point(F.substring_index(address, ":", 1)), cell_point(F.substring_index(address, ":", -1))
    sound = (start["row"] <= end["row"]) & (start["col"] <= end["col"]) & ~address.rlike(":.*:")
    cells = (end["row"] - start["row"] + 1).cast("long") * (end["col"] - start["col"] + 1)
    parts = {"r0": start["row"], "c0": start["col"], "r1": end["row"], "c1": end["col"], "cells": cells}
    return F.struct(*(F.when(sound, v).alias(k) for k, v in parts.items()))


def distinct_sorted(values: Column) -> Column:
    """A set of strings in order, blanks dropped."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))))


def checked(op: str, a: Column, b: Column) -> Column:
    """A struct (value, status) of a whole-number operation: known, unknown (overflow) or invalid (by zero)."""
    value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "mod": F.try_mod, "\\": lambda x, y: F.when(y != 0, F.try_divide(x - F.try_mod(x, y), y).cast("long")), "/": lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))}[op](a, b)
    invalid = (b == 0) if op in ("/", "\\", "mod") else F.lit(False)
    status = F.when(a.isNull() | b.isNull(), "unknown").when(invalid, "invalid").when(value.isNull(), "unknown").otherwise("known")
    return F.struct(value.alias("value"), status.alias("status"))


def checked_power(a: Column, exponent: Column) -> Column:
    """a ^ exponent in whole numbers where exact, else null; a negative exponent is null."""
    exact = F.pow(a.cast("double"), exponent.cast("double"))
    return F.when((exponent >= 0) & (F.abs(exact) < 2.0**53), exact.cast("long"))


def logic(op: str, a: Column, b: Column) -> Column:
    """and, or, xor, eqv, imp of booleans; null is unknown and stays so."""
    return {"and": lambda: F.when(a.isNotNull() & b.isNotNull(), a & b), "or": lambda: F.when(a.isNotNull() & b.isNotNull(), a | b), "xor": lambda: a != b, "eqv": lambda: a == b, "imp": lambda: F.when(a.isNotNull() & b.isNotNull(), ~a | b)}[op]()


def compared(op: str, a: Column, b: Column, ordered: bool = True) -> Column:
    """A comparison; for kinds without an order only = and <> are known, the others null."""
    if not ordered and op not in ("=", "<>"):
        return F.lit(None).cast("boolean")
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def number_literal(text: Column) -> Column:
    """The value of 12, 1.5e3, &HFF, &O17 with an optional type suffix; null if malformed."""
    body = F.regexp_replace(F.upper(F.trim(text)), r"[%&^!#@]$", "")
    hexed, octal = F.regexp_extract(body, "^&H([0-9A-F]+)$", 1), F.regexp_extract(body, "^&O?([0-7]+)$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("double")).when(octal != "", F.conv(octal, 8, 10).try_cast("double")).when(body.rlike(r"^[0-9]*\.?[0-9]+(E[+-]?[0-9]+)?$"), body.try_cast("double"))


def round2(value: Column) -> Column:
    """Two places, halves away from zero."""
    return F.round(value, 2)


def power(a: Column, exponent: Column) -> Column:
    """a ^ exponent as a double, exact for whole results below 2 ^ 53; null if it isn't a finite number."""
    value = F.pow(a.cast("double"), exponent.cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def negated(a: Column) -> Column:
    """-a of a whole number; null where it overflows, and for null."""
    return F.try_subtract(F.lit(0).cast("long"), a)


def inverted(a: Column) -> Column:
    """All bits of a whole number turned over; null for null. For booleans use ~."""
    return F.bitwise_not(a)


def number_text(value: Column) -> Column:
    """A number as text: no decimal point for whole numbers below 1e15, else the shortest form; null for null."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))


def looks_like_utf16le(payload: Column) -> Column:
    """Whether bytes begin with the mark of UTF-16LE, or most of their odd places are zero; false for fewer than two bytes."""
    odd = F.regexp_extract_all(F.hex(payload), F.lit("..(..)"), F.lit(1))
    zeros = F.size(F.filter(odd, lambda x: x == "00"))
    marked = F.hex(F.substring(payload, F.lit(1), F.lit(2))) == "FFFE"
    return F.coalesce((F.length(payload) >= 2) & (marked | (2 * zeros > F.size(odd))), F.lit(False))


def decoded(payload: Column) -> Column:
    """Bytes as text: UTF-16LE where they look so, without its mark, else UTF-8; null for null."""
    wide = F.regexp_replace(F.decode(payload, "UTF-16LE"), "^\ufeff", "")
    return F.when(looks_like_utf16le(payload), wide).otherwise(F.decode(payload, "UTF-8"))
