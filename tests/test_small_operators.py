"""Operators that no query runs, and the largest matching, against plain versions."""

import random

from pyspark.sql import functions as F

from tessaline.functions import scalars
from tessaline.operators import calls, dataflow, graph, ranking, resolve, rules
from tessaline.sources import files, sinks
from tessaline.streaming import events

rng = random.Random(17)


def largest(expected, actual):
    fits = [[j for j, a in enumerate(actual) if all(x is None or x == y for x, y in zip(e, a, strict=True))] for e in expected]
    taken = {}

    def place(i, seen):
        for j in fits[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(fits)))


def test_largest_matching_by_location(spark):
    one = lambda null: tuple(rng.choice([*"abc", None] if null else "abc") for _ in range(3))
    expected = [(rng.choice(["p", "q", "r", None]), *one(True)) for _ in range(90)] + [("alone", "a", None, None)]
    actual = [(rng.choice(["p", "q", "r", None]), *one(False)) for _ in range(90)] + [("p", None, "a", "b"), ("other", "a", "a", "a")]
    schema = "file string, x string, y string, z string"
    got = rules.match_expectations(spark.createDataFrame(expected, schema), spark.createDataFrame(actual, schema), ["file"], ["x", "y", "z"])
    places = {r[0] for r in expected + actual}
    side = lambda rows, p: [r[1:] for r in rows if r[0] == p]
    assert {tuple(r) for r in got.collect()} == {(p, len(side(expected, p)), len(side(actual, p)), largest(side(expected, p), side(actual, p))) for p in places}


def test_matching_a_long_chain(spark):
    n = 100_000  # each diagnostic is wanted by two expectations, which only one long way sorts out
    expected = spark.range(n).selectExpr("'f' AS file", "if(id % 2 = 0, id div 2, NULL) AS x", "if(id % 2 = 1, id div 2 + 1, NULL) AS y")
    actual = spark.range(n // 2 + 1).selectExpr("'f' AS file", "id AS x", "id AS y")
    assert tuple(rules.match_expectations(expected, actual, ["file"], ["x", "y"]).first()) == ("f", n, n // 2 + 1, n // 2 + 1)
    chain = [(i, 1, j, 1) for i in range(20_000) for j in (i, i + 1)]
    assert rules._most(chain) == 20_000 and rules._most([(i, 1, j, 1) for i, _, j, _ in chain if j < 20_000]) == 20_000
    assert rules._most([(1, 5, 7, 3), (1, 5, 8, 1), (2, 2, 7, 3), (3, 1, 9, 9)]) == 5 and rules._most([]) == 0


def test_calls_and_symbols(spark):
    sites = spark.createDataFrame([("Do", "sub", "A.Do x"), ("do", "Function", "B.do"), ("Do", None, None), ("Other", "sub", "do")], "base_name string, caller_kind string, text string")
    assert calls.query_calls(sites, "DO").count() == 3 and calls.query_calls(sites, "do", "SUB").count() == 1 and calls.query_calls(sites, "do", text="b.D").count() == 1
    symbols = spark.createDataFrame([("Run", "sub", "Public", "M"), ("Hide", "sub", "Private", "M"), ("L1", "label", None, "M"), ("Far", "sub", None, "N")], "name string, kind string, visibility string, module string")
    names = lambda **kw: sorted(r.name for r in calls.visible_symbols(symbols, **kw).collect())
    assert names() == ["Far", "Hide", "Run"] and names(private=False) == ["Far", "Run"] and names(labels=True, module="m") == ["Hide", "L1", "Run"]
    nodes = spark.createDataFrame([("M", 1, 10), ("M", 1, 11), ("M", 2, 12)], "module string, line int, node long")
    got = {(r.module, r.line): (r.node, r.shared) for r in calls.bound(spark.createDataFrame([("M", 1), ("M", 2), ("M", 3)], "module string, line int"), nodes, ["module", "line"]).collect()}
    assert got == {("M", 1): (10, True), ("M", 2): (12, False), ("M", 3): (None, None)}
    made = spark.createDataFrame([(1, "ambiguous"), (1, "unresolved"), (2, "dynamic"), (3, "ambiguous"), (1, "matched")], "src long, status string")
    assert tuple(calls.uncertainty(made, spark.createDataFrame([(1,), (2,)], "node long")).first()) == (1, 1, 1)
    roots = spark.createDataFrame([("M.Main", "sub", "private"), ("TestSum", "sub", "public"), ("Book_Open", "sub", "private"), ("Go", "sub", "public"), ("Api", "function", "public"), ("Own", "sub", "private")], "name string, kind string, visibility string")
    assert {r.name: (r.reason, r.confidence) for r in calls.roots(roots, ["main"]).collect()} == {"M.Main": ("entry", "confirmed"), "TestSum": ("test", "confirmed"), "Book_Open": ("event", "confirmed"), "Go": ("public_macro", "confirmed"), "Api": ("public_api", "possible")}


def test_rules_switched_and_weighed(spark):
    df = spark.createDataFrame([(1, " io01 "), (2, "ui02"), (3, None)], "n int, code string")
    made = [rules.Rule("A", F.col("n") > 1), rules.Rule("B", F.col("n") < 3, "error"), rules.Rule("C", F.col("code").isNull())]
    got = lambda **kw: {(r.n, r.code, r.severity) for r in rules.evaluate(df, made, ["n"], **kw).collect()}
    assert got() == {(2, "A", "warning"), (3, "A", "warning"), (1, "B", "error"), (2, "B", "error"), (3, "C", "warning")}
    assert got(off={"A", "C"}, severities={"B": "hint"}) == {(1, "B", "hint"), (2, "B", "hint")} and got(off={"A", "B", "C"}) == set()
    assert [r.blocks for r in rules.preflight(df, "code", {"IO01"}).orderBy("n").collect()] == [True, False, False]
    flags = spark.createDataFrame([(True, None), (None, None), (False, None), (True, False)], "a boolean, b boolean")
    assert [r[0] for r in flags.select(rules.may_have(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_dimension_columns_and_dependents(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    dimension = spark.createDataFrame([("a", "first", 9)], "k string, label string, other int")
    assert {(r.k, r.n, r.label) for r in resolve.enclosing(df, dimension, ["k"], ["label"]).collect()} == {("a", 1, "first"), ("b", 2, None), (None, 3, None)}
    uses = spark.createDataFrame([("Sum", "x.bas"), ("SUM", "y.bas"), ("Max", "z.bas"), (None, "n.bas")], "name string, file string")
    assert sorted((r.name, r.file) for r in events.dependents(spark.createDataFrame([("sum",), ("gone",)], "name string"), uses, "name", "file").collect()) == [("sum", "x.bas"), ("sum", "y.bas")]


def test_texts(spark):
    texts = ["DROP table t", "update T set a = 1", "Select a\nFrom b", "selected from", "hello", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(dataflow.risk()).collect()] == ["schema", "write", "unknown", "unknown", "unknown", "unknown"]
    assert spark.range(1).select(sinks.report_line("%s: %d", F.lit("lines"), F.lit(7))).first()[0] == "lines: 7"
    assert spark.range(1).select(scalars.distinct_sorted(F.array(F.lit("b"), F.lit(" "), F.lit("a"), F.lit(None), F.lit("b")))).first()[0] == ["a", "b"]


def test_catalogues_and_cases(spark):
    records = spark.createDataFrame([("a", "m", "2024-01-01", 5), ("b", None, None, None), ("c", "m", None, 5), ("d", "m", "2024-01-01", -1)], "id string, manifest string, created_at string, size_bytes long")
    assert {r.id: r.state for r in files.catalogue(records).collect()} == {"a": "valid", "b": "legacy", "c": "invalid", "d": "invalid"}
    symbols = spark.createDataFrame([("M", "standard", "sub", "TestAdd", ["one", "two"]), ("M", "standard", "sub", "TestAdd", ["two"]), ("M", "class", "sub", "TestNo", None), ("M", "standard", "function", "TestF", None), ("N", "standard", "sub", "testBare", None)], "module string, module_kind string, kind string, name string, cases array<string>")
    assert sorted((r.id, r.duplicate) for r in files.test_cases(symbols).collect()) == [("M/TestAdd/one", False), ("M/TestAdd/two", True), ("M/TestAdd/two", True), ("N/testBare", False)]
    kept = spark.createDataFrame([(1, 10, False), (2, 10, True), (3, 10, False), (4, 10, False)], "at int, size int, held boolean").withColumn("all", F.lit(1))
    assert sorted(r.at for r in ranking.size_budget(kept, ["all"], ["at"], "size", "held", 20).collect()) == [1, 3]


def test_generic_findings_give_way_to_specific_ones(spark):
    rows = [(rng.choice(["f", "g", None]), rng.choice(["GEN", "S1", "S2"]), a := rng.randrange(600), a + rng.choice([0, 1, 9, 150])) for _ in range(260)] + [("f", "GEN", None, 3), ("f", "S1", 2, None)]
    df = spark.createDataFrame(rows, "file string, code string, s int, e int")
    clash = lambda r: r[1] == "GEN" and None not in r and any(o[1] != "GEN" and None not in o and o[0] == r[0] and o[2] <= r[3] and r[2] <= o[3] for o in rows)
    got = sorted(map(str, (tuple(r) for r in rules.recovered(df, F.col("code") == "GEN", ["file"], "s", "e").collect())))
    assert got == sorted(str(r) for r in rows if not clash(r)) and 10 < len(got) < len(rows)
    long = "x" * 200_000 + ' "' + "y" * 200_000 + '" \' z'
    assert spark.createDataFrame([(long,)], "line string").select(F.length(scalars.masked_strings(scalars.without_comment(F.col("line"))))).first()[0] == 200_004


def test_depths_of_a_deep_forest(spark):
    deep = spark.range(50_000).selectExpr("id AS node", "if(id = 0, NULL, id - 1) AS parent")
    assert graph.depths(deep, "node", "parent").where("depth <> node + 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4), (7, 99), (8, 8), (None, 1), (3, 2)], "n long, p long")
    assert {(r.node, r.depth) for r in graph.depths(odd, "n", "p").collect()} == {(1, 1), (2, 2), (3, 3)} and graph.depths(odd.limit(0), "n", "p").count() == 0


def test_handlers_of_fields_and_controls(spark):
    symbols = spark.createDataFrame([("Form1", "cmdOk_Click"), ("Form1", "Form1.CMD_OK_Click"), ("Form2", "cmdOk_Click"), ("Form1", "cmdOk"), ("Form1", "cmdOkay_Click"), (None, "cmdOk_Click"), ("Form1", None)], "module string, name string")
    fields = spark.createDataFrame([("form1", "CmdOK"), ("FORM1", "cmd_ok"), ("Form1", "cmd"), ("Form3", "x"), ("Form1", " "), ("Form1", None)], "module string, field string")
    got = {(r.module, r.name, r.reason, r.confidence) for r in calls.handler_roots(symbols, fields, "control").collect()}
    assert got == {("Form1", "cmdOk_Click", "control", "confirmed"), ("Form1", "Form1.CMD_OK_Click", "control", "confirmed")}
