"""The library's own operators applied to the driver's tables; oracle.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.functions import scalars
from tessaline.operators import calls, cycles, dataflow, diff, dominators, effects, graph, ranking, ranks, reach, regions, resolve, rollup, rules
from tessaline.operators import runs as runs_
from tessaline.sources.tables import table
from tessaline.streaming import postings
from tessaline.streaming.events import current, publish, sessions, settled_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query
def w1_runs(spark, sf_dir):
    return _event_runs(spark, sf_dir).selectExpr("user_id", "event_type", "first.ts AS start_ts", "last.ts AS end_ts", "n")


@query
def w2_outlier_runs(spark, sf_dir):
    found = runs_.outliers(_event_runs(spark, sf_dir), ["user_id"], ["event_type"])
    return found.where("is_outlier").selectExpr("user_id", "event_type", "first.ts AS start_ts")


def _suppliers(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = lines.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"), F.max(F.floor("l_extendedprice").cast("long")).alias("top_price"))
    customers = lines.select("l_suppkey", "l_orderkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.count_distinct("o_custkey").alias("n_customers"))
    return storage.save(own.join(customers, "l_suppkey"), "suppliers")


SIGNALS = ["n_lines", "n_parts", "n_customers", "top_price"]


@query
def w3_percentile(spark, sf_dir):
    df = ranks.percentiles(_suppliers(spark, sf_dir), SIGNALS)
    return df.select("l_suppkey", *(F.round(f"p_{s}", 6).alias(f"p_{s}") for s in SIGNALS))


@query
def w4_hotspots(spark, sf_dir):
    return ranking.hotspots(_suppliers(spark, sf_dir), SIGNALS, ["l_suppkey"]).select("l_suppkey", "score", "position")


@query
def l4_topn_or_threshold(spark, sf_dir):
    ranked = ranking.hotspots(_suppliers(spark, sf_dir), SIGNALS, ["l_suppkey"])
    return ranking.top_or_threshold(ranked, 5, 60.0).select("l_suppkey", "score", "position", "by_top", "by_score")


def _nation_metrics(spark, sf_dir):
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    c = customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("debtors"))
    s = supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    both = nation.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return both.select("n_nationkey", *(F.coalesce(m, F.lit(0)).alias(m) for m in ("customers", "debtors", "suppliers")))


@query
def p14_thresholds(spark, sf_dir):
    return rules.thresholds(_nation_metrics(spark, sf_dir), ["n_nationkey"], {"customers": 60, "debtors": 5, "suppliers": 0})


@query
def w5_priority_overlay(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    base = orders.select("o_orderkey", "o_orderstatus", F.lit(0).alias("priority"), F.lit(0).alias("seq"))
    patch = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_orderkey") % 2).cast("int").alias("priority"), F.lit(1).alias("seq"))
    return ranking.overlay(base.union(patch), ["o_orderkey"], "priority", ["seq", "o_orderstatus"])


def _sized_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("size"), (F.col("event_type") == "purchase").alias("protected"))


@query
def w6_keep_last(spark, sf_dir):
    return ranking.keep_last(_sized_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "recency")


@query
def w7_size_budget(spark, sf_dir):
    return ranking.size_budget(_sized_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "size", "protected", 1000).select("user_id", "event_id")


@query
def w8_latest(spark, sf_dir):
    return ranking.latest(table(spark, sf_dir, "events"), ["user_id"], ["event_type", "value"], ["ts", "event_id"])


@query
def p_older_than(spark, sf_dir):
    hours = scalars.duration_hours(F.lit("7d"))
    return table(spark, sf_dir, "events").where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")) - F.make_dt_interval(hours=hours.cast("int"))).select("event_id")


@query
def w9_last_n(spark, sf_dir):
    return ranking.last_n(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 200).select("event_type", "event_id", "total", "truncated", "recency")


@query
def w10_redeclared(spark, sf_dir):
    found = ranking.redeclared(table(spark, sf_dir, "part"), ["p_name", "p_brand"], ["p_partkey"])
    return found.selectExpr("p_partkey", "occurrence", "first_at.p_partkey AS first_partkey")


@query
def w11_unique_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("slug", scalars.sheet_slug(F.col("p_name")))
    return ranking.numbered_names(part, "slug", ["p_partkey"]).select("p_partkey", "unique_name")


@query
def w12_nearby(spark, sf_dir):
    found = ranking.nearby(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2)
    return found.select("event_id", F.array_join("context", ">").alias("context"))


@query
def j2_added_removed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    early, late = o.where("o_orderdate < TIMESTAMP_NTZ '1995-04-01'"), o.where("o_orderdate >= TIMESTAMP_NTZ '2001-04-01'")
    return diff.added_removed(early, late, ["o_custkey"])


def _mutated_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = o.where("o_orderkey % 97 <> 0").select(
        F.when(F.col("o_orderkey") % 89 == 0, F.col("o_orderkey") + 100_000_000).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return o, after


@query
def j3_cell_diff(spark, sf_dir):
    return diff.cell_diff(*_mutated_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query
def j4_file_diff(spark, sf_dir):
    o, after = _mutated_orders(spark, sf_dir)
    return diff.changed_keys(o, after, ["o_orderkey"], "o_orderpriority")


@query
def a3_diff_summary(spark, sf_dir):
    return diff.summary(diff.cell_diff(*_mutated_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]))


@query
def j5_line_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return diff.line_diff(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"], "text")


def _halves(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    return rows.where(early).select("l_partkey", "l_returnflag"), rows.where(~early).select("l_partkey", "l_returnflag")


@query
def u1_multiset_delta(spark, sf_dir):
    return diff.multiset_delta(*_halves(spark, sf_dir))


@query
def a7_delta_by_flag(spark, sf_dir):
    return diff.delta_by(diff.multiset_delta(*_halves(spark, sf_dir)), ["l_returnflag"])


@query
def a1_status(spark, sf_dir):
    return rollup.status_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], "O")


@query
def a2_summaries(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_quantity").cast("long").alias("quantity"), F.array("l_returnflag").alias("flags"), F.array("l_linestatus").alias("states"))
    out = rollup.summaries(lines, ["l_suppkey"], "quantity", ["flags", "states"])
    return out.select("l_suppkey", "n", "size", F.array_join("flags", ",").alias("flags"), F.array_join("states", ",").alias("states"))


@query
def a4_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rollup.by_sets(lines, ["l_returnflag", "l_linestatus"], [[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]], [F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")])


@query
def a4_surface_pivot(spark, sf_dir):
    return rollup.pivoted_counts(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "purchase"])


@query
def a5_inventory(spark, sf_dir):
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 20).alias("n"))
    return rollup.compared_counts(made, declared, ["key"], "n")


@query
def a8_precision(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return rules.precision(labels.join(docs, "doc_id"), ["lang"], F.col("quality") == 1, F.col("n_chars") > 500)


@query
def a11_fans(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 500).alias("src"), (F.col("l_suppkey") % 500).alias("dst"))
    return rollup.fans(edges, "src", "dst")


@query
def a12_module_rollup(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_nationkey", F.floor("c_acctbal").cast("long").alias("balance"), (F.col("c_mktsegment") == "BUILDING").alias("building"))
    return rollup.rolled_up(df, ["c_nationkey"], ["balance"], ["balance"], ["building"])


@query
def a13_counters(spark, sf_dir):
    kind = F.col("event_type")
    return rollup.counters(table(spark, sf_dir, "events"), ["user_id"], {"views": kind == "view", "bought": kind == "purchase", "other": ~kind.isin("view", "purchase"), "large": F.col("value") > 50})


@query
def a15_evidence(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    found = rollup.with_evidence(lines, ["l_suppkey", "l_returnflag"], ["l_partkey"])
    return found.select("l_suppkey", "l_returnflag", F.array_join(F.transform("evidence", lambda e: e["l_partkey"].cast("string")), ",").alias("evidence"))


@query
def a17_stage_totals(spark, sf_dir):
    stages = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor("value").cast("long").alias("elapsed"), F.when(F.col("event_id") % 1000 == 7, "canceled").when(F.col("event_id") % 50 == 3, "error").otherwise("ok").alias("outcome"))
    return rollup.stage_totals(stages, "event_type", ["elapsed"], "outcome", {"ok": 0, "error": 1, "canceled": 2}, "event_id")


@query
def a19_first_wins(spark, sf_dir):
    return ranking.first_wins(table(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", "p_partkey")


@query
def a23_digest(spark, sf_dir):
    return rollup.digest(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "text")


def _resolved(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    symbols = part.select(name.alias("name"), "p_partkey")
    sites = part.select(F.col("p_partkey").alias("site"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("no such "), name)).otherwise(F.upper(name)).alias("name"))
    return resolve.resolve(sites, symbols, ["site"], ["name"], "p_partkey")


@query
def j6_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query
def a9_status_counts(spark, sf_dir):
    return resolve.status_counts(_resolved(spark, sf_dir))


@query
def j6_visibility(spark, sf_dir):
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    sites = customer.select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("module"), (F.col("c_custkey") % 120).cast("string").alias("name"))
    symbols = supplier.select("s_suppkey", F.col("s_nationkey").alias("owner"), F.col("s_suppkey").cast("string").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("private"))
    return resolve.resolve(sites, symbols, ["site"], ["name"], "s_suppkey", ~F.col("c.private") | (F.col("c.owner") == F.col("s.module")))


@query
def j9_followers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = part.select("p_partkey", (F.col("p_partkey") % 60).alias("idx"))
    anchors = part.select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")).alias("idx"), "p_name")
    return resolve.followers(cells, anchors, ["idx"], "p_name").select("p_partkey", "anchor_formula", "parse_status")


@query
def j10_expand(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size AS r0", "p_size + CAST(p_partkey % 4 AS INT) - 1 AS r1", "1 AS c0", "CAST(p_partkey % 3 AS INT) + 1 AS c1")
    return resolve.expand(part, "r0", "r1", "c0", "c1").select("p_partkey", "row", "col")


def _findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.detect_lines(docs, ["doc_id"], "text", {"R001": "token|secret|password", "R002": "[#$%&*]{3}", "R003": "[Ll]icen[sc]e", "R004": "@[a-z0-9]+[.]", "R005": "[0-9]{6}", "R006": "^[^ ]+$"}, {"R005": "[A-Za-z]{30}"})


@query
def p11_code_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.detect_lines(docs, ["doc_id"], "text", {"R001": "token|secret|password", "R003": "[Ll]icen[sc]e", "R006": "^[^ ]+$"}, {"R001": "=$"}, code_only=True)


@query
def p11_detectors(spark, sf_dir):
    return _findings(spark, sf_dir)


def _directives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.explode(F.array(F.lit(1), F.lit(1), F.lit(2)))
    return docs.select("doc_id", n.alias("line_no"), F.explode(F.array(F.lit("R002"), F.lit("R003"))).alias("code")).withColumn("target_line", F.col("line_no") + (F.col("doc_id") % 2).cast("int")).withColumn("no", F.monotonically_increasing_id())


@query
def j12_suppressed(spark, sf_dir):
    return rules.suppress(_findings(spark, sf_dir), _directives(spark, sf_dir), ["doc_id"])


@query
def j12_unused_directives(spark, sf_dir):
    return rules.unused_directives(_findings(spark, sf_dir), _directives(spark, sf_dir), ["doc_id"], ["line_no", "no"]).select("doc_id", "line_no", "target_line", "code")


@query
def j13_unreached(spark, sf_dir):
    return rules.unmatched(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query
def j15_shadowing(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("N"), (F.col("p_partkey") % 400).cast("string"))
    locals_ = part.select("p_partkey", "p_brand", name.alias("name"))
    modules = supplier.select(F.concat(F.lit("n"), (F.col("s_suppkey") * 7).cast("string")).alias("name"))
    procedures = supplier.select(F.concat(F.lit("n"), (F.col("s_suppkey") * 3).cast("string")).alias("name"))
    return resolve.shadowing(locals_, modules, procedures, "name", ["p_brand"], ["p_partkey"]).select("p_partkey", "shadows")


@query
def j16_consume(spark, sf_dir):
    lines = table(spark, sf_dir, "events")
    reviews = lines.where("event_id % 3 = 0").select("user_id", "event_type", F.col("event_id").alias("review_id"))
    rows = lines.where("event_id % 3 <> 0").select("user_id", "event_type", F.col("event_id").alias("row_id"))
    return rules.consume(reviews, rows, ["user_id", "event_type"], "review_id", "row_id")


@query
def p7_empty_groups(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    df = customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    return rules.with_empty_groups(df, nation, ["n_nationkey"], F.col("c_acctbal") > 9900)


@query
def p13_violations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return rules.violations(part, ["p_partkey"], {"large_is_dear": (F.col("p_size") > 45, F.col("p_retailprice") > 1000)}, ["p_name", "p_brand", "p_type", "p_size"])


def _month_ranges(spark, sf_dir):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select("o_custkey", days.alias("day"))
    return o.groupBy("o_custkey").agg(F.min("day").alias("low"), (F.min("day") + F.count("*").cast("int") * 3).alias("high"))


@query
def p5_point_in_range(spark, sf_dir):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", days.alias("day"))
    return resolve.point_in_range(points, _month_ranges(spark, sf_dir), "day", "low", "high", ["o_orderkey"], ["o_custkey"], ["low", "o_custkey"], 30)


@query
def p6_overlap(spark, sf_dir):
    ranges = storage.save(_month_ranges(spark, sf_dir), "ranges")
    return resolve.overlaps(ranges, ranges.withColumnRenamed("o_custkey", "other"), "low", "high", ["o_custkey"], ["other"], 30)


def _formula_cells(spark, sf_dir):
    """Each five hundred parts are a sheet whose third column has a formula for each part, of three patterns."""
    row = (F.col("p_partkey") % 500 + 1).cast("int")
    here = row.cast("string")
    text = F.when(F.col("p_size") % 10 == 3, F.concat(F.lit("=A"), here, F.lit("+'Rate card'!$B$1"))).when(F.col("p_size") % 10 > 7, F.concat(F.lit("=ROUND($A"), here, F.lit("*B$1,2)"))).otherwise(F.concat(F.lit("=A"), here, F.lit("*B"), here))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("S"), F.floor(F.col("p_partkey") / 500).cast("string")).alias("sheet"), row.alias("row"), F.lit(3).alias("col"), text.alias("formula"))
    return rows.withColumn("storage", F.lit("normal"))


@query
def c1_formula_regions(spark, sf_dir):
    found = regions.regions(_formula_cells(spark, sf_dir))
    return found.select("sheet", "range", "formula_r1c1", "example_formula", "count", "is_outlier", F.array_join("functions", ",").alias("functions"), F.array_join("depends_on_sheets", ",").alias("depends_on_sheets"))


@query
def c1_region_at(spark, sf_dir):
    found = regions.regions_in(regions.regions(_formula_cells(spark, sf_dir)), "S1", "B100:C200")
    return found.select("range", "count")


@query
def s18_layered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select(F.concat(F.lit("K"), (F.col("p_partkey") % 700).cast("string")).alias("name"), "p_size", "p_partkey").groupBy("name").agg(F.max("p_size").alias("p_size"), F.min("p_partkey").alias("p_partkey")).withColumn("tags", F.array(F.lit("base")))
    over = base.where("p_partkey % 5 = 0").select(F.lower("name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(-1)).alias("p_size"), F.lit(None).cast("long").alias("p_partkey"), F.array(F.lit("over")).alias("tags"))
    out = resolve.layered([base, over], "name", ["p_size", "p_partkey"], ["tags"])
    return out.select("name", "p_size", "p_partkey", F.array_join("tags", ",").alias("tags"))


def _customers(spark, sf_dir):
    """Customers in neighbourhoods of eight, as many as the table has."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("long")
    return c.select(key.alias("node"), F.floor(key / 8).alias("block"), F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment")


def _referrals(spark, sf_dir, shift=0):
    a, b = (_customers(spark, sf_dir).select("block", F.col("node").alias(x), F.col("nation").alias(f"{x}_nation")) for x in ("src", "dst"))
    return a.join(b, "block").where((F.col("src") != F.col("dst")) & ((F.col("src_nation") + 2 * F.col("dst_nation") + F.col("src") + shift) % 4 == 0))


def _trade(spark, sf_dir):
    """Whom a customer refers to in its neighbourhood."""
    return storage.save(_referrals(spark, sf_dir).select("src", "dst"), "trade")


def _nodes(spark, sf_dir):
    return _customers(spark, sf_dir).select("node")


@query
def g1_impact(spark, sf_dir):
    return graph.impact(_nodes(spark, sf_dir).where("node % 16 = 1"), _trade(spark, sf_dir), "both", 3)


@query
def g3_reachability(spark, sf_dir):
    c, key = _customers(spark, sf_dir), F.col("node")
    nodes = c.select("node", F.when(F.col("nation") % 2 == 0, "Private").otherwise("Public").alias("visibility"))
    roots = c.select(F.concat(F.lit("R"), F.floor(key / 24).cast("string"), F.when(key % 24 == 0, "a").when(key % 24 == 5, "b").when(key % 24 < 11, "c").cast("string")).alias("root"), "node", F.when(key % 24 == 5, "possible").otherwise("confirmed").alias("confidence"), F.lit(True).alias("exact"))
    roots = roots.where("node % 24 IN (0, 5, 9, 10)")
    dynamic = c.where("node % 10 = 3 AND block % 4 <> 3").select(key.alias("caller"), (key + 8).alias("target"))
    return reach.reachability(nodes, _trade(spark, sf_dir), roots, dynamic)


@query
def g5_components(spark, sf_dir):
    return graph.clusters(_nodes(spark, sf_dir), _trade(spark, sf_dir))


@query
def g6_scc(spark, sf_dir):
    return graph.strong_components(_nodes(spark, sf_dir), _trade(spark, sf_dir))


@query
def g6_witness(spark, sf_dir):
    trade = _trade(spark, sf_dir)
    found = graph.witnesses(trade, graph.strong_components(_nodes(spark, sf_dir), trade))
    return found.select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


@query
def g7_cycles(spark, sf_dir):
    return cycles.cycles(_trade(spark, sf_dir)).select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length", "complete")


@query
def g8_participation(spark, sf_dir):
    return cycles.participation(cycles.cycles(_trade(spark, sf_dir)))


@query
def l2_custom_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("rank", ranking.rank_of("c_mktsegment", ["MACHINERY", "BUILDING", "AUTOMOBILE"]))
    return c.groupBy("c_mktsegment", "rank").agg(F.count("*").alias("n"))


@query
def l5_total_and_first(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 25")
    return ranking.total_and_first(part, [F.desc("p_retailprice"), F.asc("p_partkey")], 10).select("p_partkey", "total")


@query
def r3_diagnostic_order(spark, sf_dir):
    return rules.in_order(_findings(spark, sf_dir).withColumn("column", F.col("line_no") % 3), ["doc_id"], "line_no", "column", "code").select("doc_id", "line_no", "code", "place")


@query
def x36_unary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("long")
    return part.select("p_partkey", scalars.negated(k).alias("negated"), scalars.inverted(k).alias("inverted"), scalars.negated(F.lit(-(1 << 63))).alias("overflow"), scalars.power(k, -(k % 3)).alias("power"))


@query
def g9_affected(spark, sf_dir):
    closed = graph.closure(_nodes(spark, sf_dir), _trade(spark, sf_dir))
    nation = _customers(spark, sf_dir).select(F.col("node").alias("dst"), "nation")
    return closed.join(nation, "dst").groupBy("src").agg(F.count_distinct("nation").alias("nations"), F.count("*").alias("nodes"))


def _steps(spark, sf_dir):
    """Parts as steps of flow graphs of twelve: graph, node, place in it, p_size."""
    key = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(F.floor(key / 12).alias("graph"), key.alias("node"), (key % 12).alias("place"), "p_size")


def _flow(spark, sf_dir):
    """A step leads to the next, unless its size forbids it, and to two more by arithmetic; always onward."""
    to = F.array(F.col("place") + 1, F.col("place") * 2 + 1, F.col("place") + 5)
    rows = _steps(spark, sf_dir).select("graph", F.col("node").alias("src"), "place", "p_size", F.explode(to).alias("to"))
    rows = rows.where((F.col("to") < 12) & ((F.col("p_size") % 4 != 1) | (F.col("to") != F.col("place") + 1)))
    return rows.select("graph", "src", (F.col("graph") * 12 + F.col("to")).alias("dst")).distinct()


def _entries(spark, sf_dir):
    return _steps(spark, sf_dir).where("place = 0").select("graph", "node")


@query
def g13_dominators(spark, sf_dir):
    back = _steps(spark, sf_dir).where("p_size % 5 = 0 AND place >= 4").select(F.col("node").alias("src"), (F.col("node") - 4).alias("dst"))
    return dominators.dominator_tree(_flow(spark, sf_dir).select("src", "dst").union(back), _entries(spark, sf_dir))


@query
def g12_flow_reachable(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    nodes = steps.select("graph", "node", F.when(F.col("place") == 0, "entry").when(F.col("place") == 11, "exit").otherwise("statement").alias("kind"))
    edges = _flow(spark, sf_dir).withColumn("class", F.when((F.col("src") + F.col("dst")) % 3 == 0, "exceptional").otherwise("normal"))
    return reach.flow_reachable(nodes, edges, _entries(spark, sf_dir), steps.where("p_size % 17 = 3").select("node"), ["normal"])


@query
def g14_assigned(spark, sf_dir):
    gives = _steps(spark, sf_dir).select("graph", "node", (F.col("node") % 3).alias("fact"))
    return graph.must_facts(_flow(spark, sf_dir), _entries(spark, sf_dir), gives)


@query
def g15_cleanup(spark, sf_dir):
    n = _steps(spark, sf_dir)
    return graph.guaranteed(n.where("place >= 9"), _flow(spark, sf_dir).select("src", "dst"), n.where("place = 0"), n.where("place IN (2, 7, 8)"))


def _effect_calls(spark, sf_dir):
    a, b = F.col("src"), F.col("dst")
    status = F.when((a + b) % 7 == 0, "ambiguous").when((a + b) % 19 == 3, "external").otherwise("matched")
    found = F.when((a + b) % 7 == 0, F.array(b, b + 1)).otherwise(F.array(b))
    return _trade(spark, sf_dir).select("src", status.alias("status"), found.alias("candidates"), (a % 11 != 0).alias("reachable"), (b % 13 == 0).alias("recovered"))


def _facts(spark, sf_dir):
    family = F.element_at(F.array(*(F.lit(f) for f in effects.FAMILIES)), (F.col("node") % 5 + 1).cast("int"))
    own = _customers(spark, sf_dir).select("node", family.alias("family"), F.when(F.col("node") % 10 == 3, effects.MAY_RAISE).otherwise(F.col("c_mktsegment")).alias("fact"))
    return own.union(effects.uncertain(_effect_calls(spark, sf_dir)))


@query
def d6_effects(spark, sf_dir):
    return effects.propagate(_facts(spark, sf_dir), effects.call_edges(_effect_calls(spark, sf_dir)))


@query
def d6_witness(spark, sf_dir):
    found = effects.witnesses(_facts(spark, sf_dir), effects.call_edges(_effect_calls(spark, sf_dir)))
    return found.select("node", "witness", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query
def a14_depths(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 3, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return graph.depths(part, "node", "parent")


@query
def l8_rotation(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (F.col("p_partkey") * 7 + i * 31) % 101).alias("cycle"))
    return part.select("p_partkey", F.array_join(F.transform(ranking.rotated(F.col("cycle")), lambda x: x.cast("string")), ">").alias("cycle"))


@query
def x_scalars(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    big = k * 4611686018427
    checked = [scalars.checked(op, x, y) for op, x, y in (("*", big, size * 1000000), ("+", big, size), ("/", size, k % 3), ("\\", k, k % 4), ("mod", k, k % 5))]
    columns = [c for i, s in enumerate(checked) for c in (s["value"].alias(f"value_{i}"), s["status"].alias(f"status_{i}"))]
    return part.select("p_partkey", scalars.sheet_slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"), scalars.column_letters(k).alias("letters"), scalars.column_number(scalars.column_letters(k)).alias("number"), scalars.checked_power(size, k % 12).alias("power"), scalars.size_bytes(F.concat(k.cast("string"), F.element_at(F.array(F.lit("KB"), F.lit("mib"), F.lit(" G")), (k % 3 + 1).cast("int")))).alias("bytes"), *columns)


@query
def t1_upsert(spark, sf_dir):
    path, rows = storage.new_path(spark, "upserts"), table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    for part in (1, 2, 0):  # as three batches, out of order
        publish(rows.where(F.col("event_id") % 3 == part), path, ["user_id", "event_type"], "ts")
    return current(spark, path).select("user_id", "event_type", "event_id", "value")


@query
def t2_postings(spark, sf_dir):
    path, rows = storage.new_path(spark, "postings"), table(spark, sf_dir, "events")
    rows = rows.select("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("generation"), ((F.col("event_id") % 3 == 0) & (F.col("user_id") % 5 == 0)).alias("removed"), "event_id", "event_type")
    for number in (0, 1):
        postings.replace(rows.where(F.col("generation") == number), number, path, ["user_id"], "generation", "removed", 16)
    return postings.current(spark, path, "removed").select("user_id", "generation", "event_id", "event_type")


@query
def t3_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 30)


def _calls(spark, sf_dir):
    """Orders as calls: customers call suppliers' nations."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    return rows.select("o_orderkey", name("Cust", F.col("c_custkey") % 50).alias("caller_name"), name("Mod.Cust", F.col("c_custkey") % 50).alias("caller_qualified"), name("N", F.col("c_nationkey")).alias("caller_module"), name("Do", F.col("o_orderkey") % 40).alias("base_name"), F.col("o_orderstatus").alias("member"), name("Obj.Do", F.col("o_orderkey") % 40).alias("text"))


@query
def p1_calls_from(spark, sf_dir):
    return calls.calls_from(_calls(spark, sf_dir), "n7").select("o_orderkey")


@query
def p2_calls_to(spark, sf_dir):
    return calls.calls_to(_calls(spark, sf_dir), "DO7").select("o_orderkey")


@query
def p3_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("module"))
    return calls.search(part, "E", "contains").select("p_partkey")


@query
def j17_matching(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    expected = rows.where("event_id % 2 = 0").withColumn("event_type", F.when(F.col("event_id") % 6 != 0, F.col("event_type")))
    return rules.match_expectations(expected, rows.where("event_id % 2 = 1"), ["user_id"], ["event_type"])


@query
def j18_hierarchy(spark, sf_dir):
    found = calls.hierarchy(_calls(spark, sf_dir), "caller_name", "base_name", ["o_orderkey"])
    return found.select("caller_name", "base_name", F.array_join(F.transform("evidence", lambda e: e["o_orderkey"].cast("string")), ",").alias("places"))


@query
def g10_dependencies(spark, sf_dir):
    o = _calls(spark, sf_dir)
    rows = o.select(F.col("caller_name").alias("src"), F.col("base_name").alias("dst"), F.col("caller_module").alias("src_module"), F.concat(F.lit("N"), (F.col("o_orderkey") % 25).cast("string")).alias("dst_module"), (F.col("o_orderkey") % 9).alias("line"))
    types = o.select(F.col("caller_module").alias("src_module"), F.col("member").alias("type_name"), (F.col("o_orderkey") % 5).alias("line"))
    found = calls.dependencies(rows, types)
    return found.select("kind", "src", "dst", F.array_join(F.transform("evidence", lambda e: e["line"].cast("string")), ",").alias("lines"))


@query
def a21_state_access(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(k) for k in ("read", "write", "mutate", "readwrite"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 12).cast("string").alias("procedure"), kind.alias("kind"))
    found = calls.state_access(rows, ["event_type"])
    return found.select("event_type", *(F.array_join(c, ",").alias(c) for c in ("readers", "writers", "mutators")))


SINK_KINDS = ["shell", "sql", "http"]


def _taint(spark, sf_dir):
    n = _steps(spark, sf_dir)
    name = lambda x: F.concat(F.lit("v"), (x % 4).cast("string"))
    sources = n.where("node % 8 = 0").select("node", name(F.floor(F.col("node") / 8)).alias("var"), F.col("node").alias("origin"), F.when(F.col("p_size") % 3 == 0, 2).otherwise(1).alias("state"))
    assigns = n.where("node % 3 = 1").select("node", name(F.col("node") + 1).alias("target"), name(F.col("node")).alias("value"))
    kills = n.where("node % 5 = 3").select("node", name(F.col("node")).alias("var"))
    return _flow(spark, sf_dir).select("src", "dst"), sources, assigns, kills


def _sink_of(node):
    return F.element_at(F.array(*(F.lit(s) for s in SINK_KINDS)), (node % 3 + 1).cast("int")).alias("sink")


def _taint_paths(spark, sf_dir):
    flow, sources, assigns, kills = _taint(spark, sf_dir)
    cleaners = _steps(spark, sf_dir).where("node % 7 = 2").select("node", F.concat(F.lit("v"), (F.col("node") % 4).cast("string")).alias("var"), _sink_of(F.col("node")))
    return dataflow.taint_paths(flow, sources, assigns, kills, SINK_KINDS, cleaners)


def _written(path):
    return F.array_join(F.transform(path, lambda s: F.concat(s["kind"], F.lit(":"), s["node"].cast("string"))), ">").alias("path")


@query
def d1_taint(spark, sf_dir):
    return _taint_paths(spark, sf_dir)[0].select("node", "var", "origin", "state", _written("path"), "safe")


@query
def d2_sinks(spark, sf_dir):
    uses = _steps(spark, sf_dir).where("node % 2 = 1").select("node", _sink_of(F.floor(F.col("node") / 2)), F.concat(F.lit("v"), (F.col("node") % 4).cast("string")).alias("var"))
    return dataflow.path_findings(_taint_paths(spark, sf_dir)[1], uses, SINK_KINDS).select("node", "sink", "var", "origin", "state", _written("path"))


@query
def d3_guards(spark, sf_dir):
    flow, sources, assigns, kills = _taint(spark, sf_dir)
    name = F.concat(F.lit("v"), (F.col("src") % 4).cast("string"))
    text = F.when(F.col("src") % 3 == 0, F.concat(name, F.lit(" = 7"))).when(F.col("src") % 3 == 1, F.lit('"a", 2')).otherwise(F.concat(name, F.lit(" > 7")))
    branches = flow.withColumn("kind", F.when(F.col("src") % 3 == 1, "case").otherwise("branch_true")).withColumn("condition", text).withColumn("selector", name)
    return dataflow.taint(flow, sources, assigns, kills, guards=dataflow.equality_guards(branches.where("dst - src > 1")))


@query
def d7_provenance(spark, sf_dir):
    evidence = _customers(spark, sf_dir).select("node", F.col("c_mktsegment").alias("fact"), "nation")
    return graph.provenance(_nodes(spark, sf_dir).withColumnRenamed("node", "owner"), _trade(spark, sf_dir), evidence).withColumnRenamed("node", "origin")


@query
def t7_watched_files(spark, sf_dir):
    change = F.when(F.col("event_id") % 3 == 0, "deleted").when(F.col("event_id") % 3 == 1, "changed").otherwise("created")
    return settled_changes(table(spark, sf_dir, "events").select("user_id", change.alias("change"), "event_id"), "user_id", "change", "event_id")


@query
def g11_affected(spark, sf_dir):
    return dataflow.affected(_trade(spark, sf_dir), _referrals(spark, sf_dir, 1), _nodes(spark, sf_dir).where("node % 32 = 6"))


@query
def j19_assignable(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = lambda x: F.concat(F.lit("T"), x.cast("string"))
    types = n.where("n_nationkey < 23").select(name(F.col("n_nationkey")).alias("name"))
    supers = n.where("n_nationkey > 0").select(name(F.col("n_nationkey")).alias("name"), name(F.floor(F.col("n_nationkey") / 2)).alias("super"))
    pairs = n.select(name(F.col("n_nationkey")).alias("source"), F.explode(F.array(F.lit("t1"), F.lit("t2"), F.lit("T24"))).alias("target"))
    return dataflow.assignable(pairs, types, supers)
