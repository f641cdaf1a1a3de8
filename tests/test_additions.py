"""Orders, unary operators, text of numbers, encodings, publishing and functions that no query runs."""

import pytest
from pyspark.sql import functions as F

from tessaline.functions import scalars
from tessaline.operators import dataflow, graph, ranking, rules
from tessaline.sources import sinks
from tessaline.streaming import events


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_unary_and_power(spark):
    long = lambda x: F.lit(x).cast("long")
    assert one(spark, scalars.negated(long(5)), scalars.negated(long(None)), scalars.negated(F.lit(-(1 << 63))), scalars.inverted(long(6))) == [-5, None, None, -7]
    got = one(spark, scalars.power(long(2), long(10)), scalars.power(long(2), long(-1)), scalars.power(F.lit(9.0), F.lit(0.5)), scalars.power(F.lit(-8.0), F.lit(0.5)), scalars.power(long(0), long(-1)), scalars.power(long(None), long(1)))
    assert got == [1024.0, 0.5, 3.0, None, None, None]


def test_number_text(spark):
    assert one(spark, *(scalars.number_text(F.lit(x).cast("double")) for x in (3.0, -2.5, 0.0, 1e14, None))) == ["3", "-2.5", "0", "100000000000000", None]
    assert one(spark, scalars.round2(F.lit(2.345)), scalars.round2(F.lit(-2.345))) == [2.35, -2.35]


def test_encodings(spark):
    rows = [("plain".encode(), "plain"), ("wide é".encode("utf-16-le"), "wide é"), (b"\xff\xfe" + "mark".encode("utf-16-le"), "mark"), (b"", ""), (b"x", "x"), (None, None), ("é" * 3000).encode()]
    rows[-1] = (rows[-1], "é" * 3000)
    got = spark.createDataFrame(rows, "payload binary, want string").select(scalars.decoded(F.col("payload")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_orders(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3), (None, 4)], "kind string, n int")
    assert {r.kind: r.rank for r in df.withColumn("rank", ranking.rank_of("kind", ["a", "b"])).collect()} == {"a": 0, "b": 1, "z": 2, None: 2}
    first = ranking.total_and_first(df, [F.desc("n")], 2).collect()
    assert [(r.n, r.total) for r in first] == [(4, 4), (3, 4)] and ranking.total_and_first(df.limit(0), [F.desc("n")], 2).count() == 0
    found = spark.createDataFrame([("f", 2, 1, "B"), ("f", 1, 9, "A"), ("f", 2, 1, "A"), ("g", None, None, None)], "file string, line int, column int, code string")
    assert {(r.file, r.line, r.code): r.place for r in rules.in_order(found, ["file"], "line", "column", "code").collect()} == {("f", 1, "A"): 1, ("f", 2, "A"): 2, ("f", 2, "B"): 3, ("g", None, None): 1}


def test_precision_counts_what_nobody_reviewed(spark):
    df = spark.createDataFrame([("r", True, True), ("r", False, True), ("r", None, True), ("s", None, False)], "rule string, truth boolean, claim boolean")
    got = {r.rule: r for r in rules.precision(df, ["rule"], F.col("truth"), F.col("claim")).collect()}
    assert (got["r"].precision, got["r"].unreviewed, got["s"].precision, got["s"].unreviewed) == (0.5, 1, None, 1)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.write_jsonl(spark.range(3), path)
    sinks.write_jsonl(spark.range(5), path)
    assert spark.read.json(path).count() == 5
    with pytest.raises(Exception, match="bad row"):
        sinks.write_jsonl(spark.range(2).select(F.raise_error(F.lit("bad row")).alias("x")), path)
    assert spark.read.json(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


def test_witnesses_of_loops_and_ties(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 4), (4, 1), (1, 5), (5, 1), (7, 7), (8, 9), (3, 8)]
    edges = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 7, 8, 9)], "node long")
    got = graph.witnesses(edges, graph.strong_components(nodes, edges)).collect()
    assert {r.component: (list(r.cycle), r.length) for r in got} == {1: ([1, 4], 2), 7: ([7], 1)}
    assert graph.witnesses(edges.limit(0), graph.strong_components(nodes, edges.limit(0))).count() == 0


def test_guards(spark):
    rows = [(1, 2, "branch_true", 'x = "a""b"', None), (1, 3, "branch_false", "x = 1", None), (2, 4, "case", "1, -2.5, True", "y"), (2, 5, "case", "Is > 3", "y"), (3, 6, "branch_true", "x = y", None), (3, 7, "branch_true", None, None)]
    branches = spark.createDataFrame(rows, "src long, dst long, kind string, condition string, selector string")
    assert {tuple(r) for r in dataflow.equality_guards(branches).collect()} == {(1, 2, "x"), (2, 4, "y")}


def test_provenance_leaves_the_owner_out(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "src long, dst long")
    facts = spark.createDataFrame([(1, "own"), (2, "two"), (2, "two"), (3, None), (4, "loop")], "node long, fact string")
    got = graph.provenance(spark.createDataFrame([(1,), (4,), (9,)], "owner long"), edges, facts).collect()
    assert sorted((r.owner, r.node, str(r.fact)) for r in got) == [(1, 2, "two"), (1, 3, "None")]


def test_file_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file string, stamp int")
    got = events.file_changes(frame([("a", 1), ("b", 1), ("c", None), ("d", 2)]), frame([("a", 1), ("b", 2), ("c", None), ("e", 1)]), "file", "stamp")
    assert {tuple(r) for r in got.collect()} == {("b", "changed"), ("d", "deleted"), ("e", "created")}
    log = spark.createDataFrame([("b", "deleted", 1), ("b", "created", 2), ("d", "changed", 1), ("d", "deleted", 3)], "file string, change string, at int")
    actions = events.settled_changes(log, "file", "change", "at")
    assert {tuple(r) for r in actions.collect()} == {("b", "refresh", 2), ("d", "remove", 2)}
    assert {tuple(r) for r in events.apply_changes(frame([("a", 1), ("b", 1), ("d", 2)]), actions, frame([("a", 9), ("b", 2)]), "file").collect()} == {("a", 1), ("b", 2)}
