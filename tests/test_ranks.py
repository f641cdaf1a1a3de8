"""Ranks and digests over whole tables against plain versions."""

import hashlib
import random

from pyspark.sql import functions as F

from tessaline.operators import ranking, ranks, rollup

rng = random.Random(31)


def plain(values):
    known = [v for v in values if v is not None]
    if not known or min(known) == max(known):
        return [0.0] * len(values)
    place = lambda v: (v is not None, v or 0)
    return [100.0 * (sum(place(w) < place(v) for w in values) + (values.count(v) - 1) / 2) / (len(values) - 1) for v in values]


def test_percentiles_by_cohort(spark):
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, 5, None, rng.randrange(90)]), 7) for k in range(400)] + [(500, "alone", 3, 7), (501, "equal", 2, 7), (502, "equal", 2, 7)]
    df = spark.createDataFrame(rows, "id long, cohort string, x int, same int").repartition(6)
    got = {r.id: r for r in ranks.percentiles(df, ["x", "same"], ["cohort"]).collect()}
    for c in ("a", "b", None, "alone", "equal"):
        own = [(k, x) for k, cohort, x, _ in rows if cohort == c]
        assert [round(got[k].p_x, 9) for k, _ in own] == [round(p, 9) for p in plain([x for _, x in own])]
        assert all(got[k].p_same == 0 and not got[k].v_same for k, _ in own)
    assert len(got) == len(rows) and ranks.percentiles(df.limit(0), ["x"]).count() == 0
    four = ranks.percentiles(spark.createDataFrame([(10,), (20,), (20,), (30,)], "x int"), ["x"])
    assert sorted(r.p_x for r in four.collect()) == [0, 50, 50, 100]


def test_positions_and_running_totals(spark):
    rows = [(k, rng.randrange(40), rng.choice(["a", "b", None])) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, v int, c string").repartition(5)
    got = [r.id for r in ranks.positions(df, [F.desc("v"), "id"]).orderBy("position").collect()]
    assert got == [k for k, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for r in ranks.positions(df, ["id"], ["c"]).collect():
        assert r.position == 1 + sum(c == r.c and k < r.id for k, _, c in rows)
    before = {r.id: r.before for r in ranks.running(df, ["v", "id"], F.col("v")).collect()}
    assert all(before[k] == sum(w for j, w, _ in rows if (w, j) < (v, k)) for k, v, _ in rows)


def test_no_window_holds_the_table(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS a", "id % 11 AS b")
    out = ranking.hotspots(df, ["a", "b"], ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "windowspecdefinition(_range" in plan
    rows = sorted(out.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 1001)) and all((-x.score, x.id) < (-y.score, y.id) for x, y in zip(rows, rows[1:], strict=False))


def root(values, chunk):
    level = [hashlib.sha256(v.encode()).hexdigest() if v is not None else "" for v in values]
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + chunk]).encode()).hexdigest() for i in range(0, len(level), chunk)]
        if len(level) == 1:
            return level[0]


def test_digest_is_a_tree_of_short_rows(spark):
    rows = [(g, k, f"text {k % 9}" if k % 13 else None) for g, n in (("one", 1), ("four", 4), ("five", 5), ("many", 83), (None, 17)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, text string").repartition(4)
    got = {r.g: r.digest for r in rollup.digest(df, ["g"], ["k"], "text", chunk=4).collect()}
    assert got == {g: root([t for h, _, t in rows if h == g], 4) for g in {g for g, _, _ in rows}}
    assert rollup.digest(df.limit(0), ["g"], ["k"], "text").count() == 0
