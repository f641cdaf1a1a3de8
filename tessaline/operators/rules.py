"""Rules as filters over rows, their union, suppression, severity and review."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.functions.scalars import masked_strings, text_lines, without_comment


@dataclass(frozen=True)
class Rule:
    """A rule finds rows: the condition says where, code and severity what."""

    code: str
    condition: Column | Callable[[], Column]
    severity: str = "warning"
    surface: str = "lint"


def evaluate(df: DataFrame, rules: list[Rule], keep: list[str], off: set[str] = frozenset(), severities: dict[str, str] | None = None) -> DataFrame:
    """keep, code, severity, surface of every rule that holds in every row.

    All rules run in one pass over df: each gives a struct or null, and those that aren't
    null become rows. off switches codes off, severities changes them.
    """
    found = []
    for r in rules:
        if r.code not in off:
            condition = r.condition() if callable(r.condition) else r.condition
            severity = (severities or {}).get(r.code, r.severity)
            found.append(F.when(condition, F.struct(F.lit(r.code).alias("code"), F.lit(severity).alias("severity"), F.lit(r.surface).alias("surface"))))
    if not found:
        return df.select(*keep, *(F.lit("").alias(c) for c in ("code", "severity", "surface"))).limit(0)
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hits).alias("_f")).select(*keep, "_f.*")


def detect_lines(docs: DataFrame, key: list[str], text: str, detectors: dict[str, str], ignore: dict[str, str] | None = None, code_only: bool = False) -> DataFrame:
    """key, line_no (from 1), code of each line that a detector's pattern finds and its ignore pattern doesn't.

    With code_only patterns see a line without its comment and with empty string literals.
    """
    lines = docs.select(*key, F.posexplode(text_lines(F.col(text))).alias("_pos", "_line")).select(*key, (F.col("_pos") + 1).alias("line_no"), "_line")
    if code_only:
        lines = lines.withColumn("_line", masked_strings(without_comment(F.col("_line"))))
    rules = [Rule(code, F.col("_line").rlike(p) & (~F.col("_line").rlike(ignore[code]) if code in (ignore or {}) else F.lit(True))) for code, p in detectors.items()]
    return evaluate(lines, rules, [*key, "line_no"]).select(*key, "line_no", "code")


def directives(docs: DataFrame, key: list[str], text: str, token: str) -> DataFrame:
    """key, line_no, target_line, mode, code of comments "token:disable-line a, b" and "…:disable-next-line"."""
    lines = docs.select(*key, F.posexplode(text_lines(F.col(text))).alias("_pos", "_line"))
    pattern = rf"'\s*{token}:disable-(line|next-line)\s+([A-Za-z0-9, ]+)"
    found = lines.where(F.col("_line").rlike(pattern)).select(*key, (F.col("_pos") + 1).alias("line_no"), F.regexp_extract("_line", pattern, 1).alias("mode"), F.explode(F.split(F.regexp_extract("_line", pattern, 2), r"[,\s]+")).alias("code"))
    return found.where("code <> ''").select(*key, "line_no", (F.col("line_no") + F.when(F.col("mode") == "next-line", 1).otherwise(0)).alias("target_line"), "mode", F.upper("code").alias("code"))


def suppress(findings: DataFrame, found: DataFrame, file: list[str], line: str = "line_no", code: str = "code") -> DataFrame:
    """Findings without a directive for their file, line and code; lines below 1 always stay."""
    key = found.select(*file, F.col("target_line").alias(line), code).where(F.col(line) > 0).distinct()
    return findings.join(key, [*file, line, code], "left_anti")


def unused_directives(findings: DataFrame, found: DataFrame, file: list[str], order: list[str], line: str = "line_no", code: str = "code") -> DataFrame:
    """Directives that suppressed nothing: no finding there, or not the first for its key."""
    key = [*file, line, code]
    hits = findings.select(*key).where(F.col(line) > 0).distinct().withColumn("_hit", F.lit(True))
    numbered = found.withColumn("_rn", F.row_number().over(Window.partitionBy(*file, "target_line", code).orderBy(*order)))
    joined = numbered.withColumn("_at", F.col("target_line")).join(hits.withColumnRenamed(line, "_at"), [*file, "_at", code], "left")
    return joined.where("_hit is null OR _rn > 1").drop("_hit", "_rn", "_at")


def unmatched(df: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Rows that nothing refers to."""
    return df.join(used.select(*key).distinct(), key, "left_anti")


def precision(reviews: DataFrame, group: list[str], truth: Column, claim: Column) -> DataFrame:
    """true_positive, false_positive, precision (null if none were claimed), n and unreviewed (rows whose truth is null) of each group."""
    tp, fp = F.count_if(claim & truth), F.count_if(claim & ~truth)
    return reviews.groupBy(*group).agg(tp.alias("true_positive"), fp.alias("false_positive"), F.count("*").alias("n"), F.count_if(truth.isNull()).alias("unreviewed")).withColumn("precision", F.try_divide("true_positive", F.col("true_positive") + F.col("false_positive")))


def consume(reviews: DataFrame, rows: DataFrame, key: list[str], review_id: str, row_id: str) -> DataFrame:
    """review_id, row_id of a one-to-one match of equal keys, in the order of ids."""
    number = lambda df, i: df.select(*key, i, F.row_number().over(Window.partitionBy(*key).orderBy(i)).alias("_rn"))
    return number(reviews, review_id).join(number(rows, row_id), [*key, "_rn"]).select(review_id, row_id)


def thresholds(df: DataFrame, key: list[str], limits: dict[str, int]) -> DataFrame:
    """key, metric, value, threshold where a metric exceeds its threshold; 0 switches one off."""
    if unknown := set(limits) - set(df.columns):
        raise ValueError(f"no such metric: {sorted(unknown)}")
    over = [Rule(m, F.col(m) > t) for m, t in limits.items() if t > 0]
    found = evaluate(df, over, [*key, *limits])
    value = reduce(lambda w, m: w.when(F.col("code") == m, F.col(m)), limits, F.when(F.lit(False), F.lit(None)))
    limit = reduce(lambda w, m: w.when(F.col("code") == m, F.lit(limits[m])), limits, F.when(F.lit(False), F.lit(None)))
    return found.select(*key, F.col("code").alias("metric"), value.cast("long").alias("value"), limit.cast("long").alias("threshold"))


def violations(df: DataFrame, key: list[str], implications: dict[str, tuple[Column, Column]], unique: list[str]) -> DataFrame:
    """key and constraint of rows where a holds but b doesn't, or whose unique columns repeat."""
    broken = evaluate(df, [Rule(name, a & ~F.coalesce(b, F.lit(False))) for name, (a, b) in implications.items()], key).select(*key, F.col("code").alias("constraint"))
    repeats = df.groupBy(*unique).agg(F.count("*").alias("_n")).where("_n > 1")
    return broken.union(df.join(repeats, unique, "left_semi").select(*key, F.lit("unique").alias("constraint")))


def preflight(df: DataFrame, code: str, blocking: set[str]) -> DataFrame:
    """Adds blocks: whether a row's code stops what comes next."""
    return df.withColumn("blocks", F.coalesce(F.upper(F.trim(code)).isin(*blocking), F.lit(False)))


def may_have(*flags: Column) -> Column:
    """Whether all features may be there: an unknown (null) one may."""
    return reduce(lambda a, b: a & b, (F.coalesce(f, F.lit(True)) for f in flags))


def with_empty_groups(df: DataFrame, spine: DataFrame, group: list[str], condition: Column) -> DataFrame:
    """Rows of df that fulfil the condition counted per group of the spine; groups without any stay."""
    counts = df.where(condition).groupBy(*group).agg(F.count("*").alias("n"))
    return spine.select(*group).distinct().join(counts, group, "left").select(*group, F.coalesce("n", F.lit(0)).alias("n"))


def recovered(findings: DataFrame, generic: Column, file: list[str], start: str, end: str, width: int = 64) -> DataFrame:
    """Findings without the generic ones that overlap a specific one of the same file.

    Generic and specific findings of a file meet by tiles of so many lines, and the specific
    ones of a tile are first reduced to their ranges, so a file of many findings isn't
    compared all with all. A finding without a file, start or end overlaps nothing.
    """
    no = storage.fresh(findings, "_no")[0]
    rows = storage.save(findings.withColumn(no, F.monotonically_increasing_id()), "findings")
    tiles = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))).alias("_tile")
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    specific = rows.where(~generic & known).select(*file, F.col(start).alias("_s"), F.col(end).alias("_e"), tiles).distinct()
    asked = rows.where(generic & known).select(no, *file, F.col(start).alias("_from"), F.col(end).alias("_to"), tiles)
    gone = asked.join(specific, [*file, "_tile"]).where("_from <= _e AND _s <= _to").select(no).distinct()
    return rows.join(gone, no, "left_anti").drop(no)


def _most(pairs: list[tuple[int, int, int, int]]) -> int:
    """The largest matching of pairs (left, how often it is there, right, how often), each pair as often as both are free.

    Phases of a breadth-first search over what is free, then ways along its layers, found
    with a stack of their own, until no way is left.
    """
    fits, left, right, back = defaultdict(list), {}, {}, defaultdict(dict)
    for a, n, b, m in pairs:
        fits[a].append(b)
        left[a], right[b] = n, m
    total = 0
    while True:
        layer, queue = {(0, a): 0 for a, n in left.items() if n}, deque((0, a) for a, n in left.items() if n)
        found = False
        while queue:
            side, x = node = queue.popleft()
            found = found or side == 1 and right[x] > 0
            for y in fits[x] if side == 0 else [a for a, used in back[x].items() if used]:
                if (1 - side, y) not in layer:
                    layer[1 - side, y] = layer[node] + 1
                    queue.append((1 - side, y))
        if not found:
            return total
        after = {node: iter(fits[node[1]] if node[0] == 0 else [a for a, used in back[node[1]].items() if used]) for node in layer}
        for start in [a for a, n in left.items() if n]:
            while left[start]:
                path = [(0, start)]
                while path:
                    side, x = path[-1]
                    if side == 1 and right[x]:
                        break
                    step = next((y for y in after[path[-1]] if layer.get((1 - side, y)) == layer[path[-1]] + 1 and (side == 0 or back[x][y])), None)
                    if step is None:
                        path.pop()
                    else:
                        path.append((1 - side, step))
                if not path:
                    break
                held = [back[path[k][1]][path[k + 1][1]] for k in range(1, len(path) - 1, 2)]
                many = min(left[start], right[path[-1][1]], *held)
                for k in range(0, len(path) - 1, 2):
                    a, b = path[k][1], path[k + 1][1]
                    back[b][a] = back[b].get(a, 0) + many
                    if k + 2 < len(path):
                        back[b][path[k + 2][1]] -= many
                left[start] -= many
                right[path[-1][1]] -= many
                total += many
                after |= {node: iter(fits[node[1]] if node[0] == 0 else [a for a, used in back[node[1]].items() if used]) for node in path}


def match_expectations(expected: DataFrame, actual: DataFrame, location: list[str], fields: list[str]) -> DataFrame:
    """location, n_expected, n_actual, n_matched: a largest matching of expectations to diagnostics, one to one.

    A null field of an expectation matches anything; a null field of a diagnostic only that.
    Alike rows of a location are one with a count. What may match is found by joins, one for
    each set of null fields, so no pairs of a location are made that don't match. A location
    is matched in one task, which holds its pairs. Locations of one side alone match nothing;
    null locations are a location.
    """
    at = F.struct(*location).alias("_at")
    sides = {}
    for name, df in (("e", expected), ("a", actual)):
        rows = df.select(at, *fields).groupBy("_at", *fields).agg(F.count("*").alias(f"n_{name}"))
        sides[name] = storage.save(rows.withColumn(name, F.monotonically_increasing_id()), "expectations")
    e, a, pairs = sides["e"], sides["a"], None
    for mask in range(1 << len(fields)):
        known = [f for k, f in enumerate(fields) if not mask >> k & 1]
        some = e.where(reduce(lambda x, y: x & y, [F.col(f).isNull() if mask >> k & 1 else F.col(f).isNotNull() for k, f in enumerate(fields)], F.lit(True)))
        fit = some.select("_at", *known, "e", "n_e").join(a.select("_at", *known, "a", "n_a"), ["_at", *known]).select("_at", "e", "n_e", "a", "n_a")
        pairs = fit if pairs is None else pairs.union(fit)
    kind = e.schema["_at"].dataType.simpleString()

    def most(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_no": [int(key[0])], "n_matched": [_most(list(zip(*(rows[c].tolist() for c in ("e", "n_e", "a", "n_a")), strict=True)))]})

    totals = e.select("_at", F.col("n_e"), F.lit(0).cast("long").alias("n_a")).union(a.select("_at", F.lit(0).cast("long"), "n_a")).groupBy("_at").agg(F.sum("n_e").alias("n_expected"), F.sum("n_a").alias("n_actual"))
    totals = storage.save(totals.withColumn("_no", F.monotonically_increasing_id()), "locations")
    numbered = pairs.join(totals.select(F.col("_at").cast(kind).alias("_at"), "_no"), "_at").select("_no", "e", "n_e", "a", "n_a")
    matched = numbered.groupBy("_no").applyInPandas(most, "_no long, n_matched long")
    return totals.join(matched, "_no", "left").select("_at.*", "n_expected", "n_actual", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def compile_equivalent(diagnostics: DataFrame, catalogue: DataFrame, procedures: DataFrame, file: list[str]) -> DataFrame:
    """diagnostics (file, code, line) with severity, procedure, analyze and preflight: what the compiler would say too, as findings.

    catalogue (code, family, surfaces, compile_equivalent, preflight_blocking,
    default_severity) has a row a code; a diagnostic of a code that it doesn't have is left
    out. procedure is the first of procedures (file, name, start_line, end_line) around the
    line, null if none is. analyze tells whether the rule has that surface, preflight whether
    the finding blocks what comes next. Procedures of a file meet its diagnostics by lines of
    a width, not all with all.
    """
    width = 128
    known = diagnostics.join(F.broadcast(catalogue.select("code", "family", "surfaces", "compile_equivalent", "preflight_blocking", F.col("default_severity").alias("severity"))), "code")
    known = storage.save(known.withColumn("_no", F.monotonically_increasing_id()), "known")
    tiles = procedures.select(*file, F.struct("start_line", "end_line", "name").alias("_p"), F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))).alias("_tile"))
    hits = known.select("_no", *file, "line", F.floor(F.col("line") / width).alias("_tile")).join(tiles, [*file, "_tile"]).where("line BETWEEN _p.start_line AND _p.end_line")
    around = hits.groupBy("_no").agg(F.min("_p")["name"].alias("procedure"))
    blocks = (F.col("family") == "lint") & F.col("compile_equivalent") & F.col("preflight_blocking")
    out = known.join(around, "_no", "left")
    return out.select(*diagnostics.columns, "severity", "procedure", F.array_contains("surfaces", "analyze").alias("analyze"), F.coalesce(blocks, F.lit(False)).alias("preflight"))


def in_order(found: DataFrame, file: list[str], line: str, column: str, code: str) -> DataFrame:
    """found with place, the number of a diagnostic in its file by line, column and code.

    Nulls come first. Diagnostics that agree in all of these are numbered in any order.
    Files are sorted apart, so no task sorts all.
    """
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*file).orderBy(line, column, code)).cast("long"))
