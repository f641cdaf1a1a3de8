from pyspark.sql import functions as F

from tessaline.functions import formulas, scalars
from tessaline.operators import regions

#: Own formulas, each with what it means from the cell at (row, col); the notation is fixed.
PATTERNS = [
    (7, 5, "=D7-B7/C7", "=RC[-1]-RC[-3]/RC[-2]", "ok"),
    (19, 5, "=D19-B19/C19", "=RC[-1]-RC[-3]/RC[-2]", "ok"),
    (7, 5, "=$B$3+B$3+$B3", "=R3C2+R3C[-3]+R[-4]C2", "ok"),
    (7, 5, "=AVERAGE(E1:F6)", "=AVERAGE(R[-6]C:R[-1]C[1])", "ok"),
    (7, 5, "='été 1'!E8&\"F9\"", "='été 1'!R[1]C&\"F9\"", "ok"),
    (7, 5, "=COUNT(B:D)+COUNT($B:D)", "=COUNT(C[-3]:C[-1])+COUNT(C2:C[-1])", "ok"),
    (7, 5, "=MAX(6:$9)", "=MAX(R[-1]:R9)", "ok"),
    (7, 5, "=Stock!G7*2.5E-2", "=Stock!RC[2]*2.5E-2", "ok"),
    (7, 5, "='It''s'!$C7", "='It''s'!RC3", "ok"),
    (7, 5, "=[Prices.xlsx]List!E7", "=[Prices.xlsx]List!E7", "partial"),
    (7, 5, "=Goods[Price]+D7", "=Goods[Price]+RC[-1]", "partial"),
    (7, 5, "=D7#", "=D7#", "partial"),
    (0, 5, "=D7", "=D7", "failed"),
    (7, 5, "", "", "ok"),
]


def test_patterns(spark):
    df = spark.createDataFrame(PATTERNS, "row int, col int, formula string, want string, status string")
    got = df.withColumn("p", formulas.pattern_of(F.col("formula"), F.col("row"), F.col("col"))).select("formula", "p.formula_r1c1", "want", "p.status", F.col("status").alias("want_status")).collect()
    for r in got:
        assert (r.formula_r1c1, r.status) == (r.want, r.want_status), r.formula


def test_expand_and_shift(spark):
    df = spark.createDataFrame([("=R[-3]C*RC[4]-R9C[1]", 12, 6), ('=MIN(R[2]C[-1]:R[4]C)&"R1"', 12, 6), ("=RC[-6]", 12, 6)], "p string, row int, col int")
    assert [r[0] for r in df.select(formulas.expanded(F.col("p"), F.col("row"), F.col("col"))).collect()] == ["=F9*J12-G$9", '=MIN(E14:F16)&"R1"', None]
    df = spark.createDataFrame([("=H7/$K7-M$2&Ledger!AA40",)], "f string")
    assert df.select(formulas.shifted(F.col("f"), F.lit(2), F.lit(5))).first()[0] == "=M9/$K9-R$2&Ledger!AF42"
    text = df.select(formulas.functions(F.lit('=Round(K2)/LEN("AVG(2)")+ROUND (x)')), formulas.sheets(F.lit("=North!C4-'Cash ''n'' carry'!D2+North!C5")), formulas.folded_string(F.lit('"up" & " ""to"" " & "ten"')), formulas.folded_string(F.lit('y & "z"'))).first()
    assert list(text) == [["LEN", "ROUND"], ["Cash 'n' carry", "North"], 'up "to" ten', None]


def test_tokens_cover_the_formula(spark):
    f = "=IF(Sheet1!A1<>\"x\"\"y\", 'My Sheet'!B2, #REF!) + 1.5e3 é"
    got = spark.range(1).select(formulas.tokens(F.lit(f)).alias("t")).first().t
    assert "".join(t.text for t in got) == f and [t.start for t in got[1:]] == [t.end for t in got[:-1]]
    kinds = {t.text: t.kind for t in got}
    assert kinds["<>"] == "operator" and kinds['"x""y"'] == "string" and kinds["'My Sheet'"] == "quoted_name" and kinds["#REF!"] == "error" and kinds["1.5e3"] == "number" and kinds["IF"] == "identifier"


CELLS = "sheet string, row int, col int, kind string, shared_index string, shared_ref string, formula string"


def found(spark, rows):
    cells = regions.shared_cells(spark.createDataFrame([("S", *r) for r in rows], CELLS))
    return {r["range"]: r for r in regions.regions(cells).collect()}


def test_runs_of_one_pattern_and_what_breaks_them(spark):
    normal = lambda row, col, f: (row, col, "normal", None, None, f)
    got = found(spark, [normal(r, 11, f"=SQRT($B{r})-K{r - 1}") for r in range(8, 15)])
    assert {k: (v["count"], v.formula_r1c1) for k, v in got.items()} == {"K8:K14": (7, "=SQRT(RC2)-R[-1]C")}
    # one cell among its like, two cells of another pattern, and a gap
    column = {r: f"=J{r}+1" for r in (*range(20, 29), *range(32, 35))} | {24: "=J24+2"} | {r: f"=J{r}-J$20" for r in (27, 28)}
    got = found(spark, [normal(r, 12, f) for r, f in column.items()])
    assert {k: v.is_outlier for k, v in got.items()} == {"L20:L23": False, "L24": True, "L25:L26": False, "L27:L28": False, "L32:L34": False}


def test_shared_rectangles(spark):
    # an anchor whose rectangle spans two columns, with a follower that has a formula of its own
    rows = [(5, 2, "shared", "3", "B5:C7", "=$A5*B$1")] + [(r, c, "shared", "3", None, "") for r in (5, 6, 7) for c in (2, 3) if (r, c) not in ((5, 2), (6, 3))] + [(6, 3, "normal", None, None, "=77")]
    got = found(spark, rows)
    assert {k: v["count"] for k, v in got.items()} == {"B5:B7": 3, "C5": 1, "C6": 1, "C7": 1}
    assert got["B5:B7"].storage_kinds == ["shared"] and got["C6"].example_formula == "=77" and got["C7"].formula_r1c1 == "=RC1*R1C"
    # two rectangles one above the other that say the same are one run, a third that says something else is not
    got = found(spark, [(10, 8, "shared", "0", "H10:H19", "=LEN(G10)"), (20, 8, "shared", "1", "H20:H31", "=LEN(G20)"), (32, 8, "shared", "2", "H32:H40", "=LEN(F32)")])
    assert sorted(got) == ["H10:H31", "H32:H40"]
    got = found(spark, [(3, 15, "shared", "6", None, ""), (8, 16, "shared", "4", "P20:P2", "=O8")])
    assert got["O3"].parse_status == "failed" and "P8" in got


def test_snapshot_queries(spark):
    cells = regions.shared_cells(spark.createDataFrame([("S", r, c, "normal", None, None, f"=$A{r}") for r in range(1, 9) for c in (2, 4)], CELLS))
    made = regions.regions(cells)
    assert regions.region_at(made, "S", "D5").first().formula_here == "=$A5"
    assert {r["range"] for r in regions.regions_in(made, "S", "C3:E4").collect()} == {"D1:D8"}
    assert regions.summary(made).first().regions == 2
    assert tuple(regions.used_ranges(cells).first())[1:] == (1, 8, 2, 4, 16)
    cut = regions.window_of(cells, "S", "A1:D8", 3, 10).collect()
    assert len(cut) == 6 and all(r.truncated for r in cut)


def test_scalars(spark):
    cases = [
        (scalars.text_lines(F.lit("a\r\nb\rc\n")), ["a", "b", "c"]), (scalars.text_lines(F.lit("")), []), (scalars.text_lines(F.lit("\n\n")), ["", ""]),
        (scalars.sheet_slug(F.lit("  My / Sheet!! ")), "My-Sheet"), (scalars.sheet_slug(F.lit("***")), "Sheet"),
        (scalars.without_comment(F.lit('x = "it\'s" \' note')), 'x = "it\'s" '), (scalars.masked_strings(F.lit('a "b""c" d')), 'a "" d'),
        (scalars.number_literal(F.lit("&HFF&")), 255.0), (scalars.number_literal(F.lit("12x")), None), (scalars.duration_hours(F.lit("2w")), 336),
        (scalars.range_info(F.lit("B3:A1"))["cells"], None), (scalars.range_info(F.lit("A1:C4"))["cells"], 12), (scalars.logic("imp", F.lit(False), F.lit(False)), True),
        (scalars.sheet_selector(F.lit("'It''s'!a1:b2")), ("It's", "A1:B2")), (scalars.compared("<", F.lit("a"), F.lit("b"), False), None), (scalars.column_letters(F.lit(18278)), "ZZZ"),
    ]
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i
