"""Reachability in two strata: what edges prove, and what an unknown target makes possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.dominators import dominator_tree
from tessaline.operators.graph import distances
from tessaline.operators.trees import doubled

#: Kinds of nodes that an unknown flow may lead to.
OPEN_KINDS = ("statement", "unknown_exit")


def _accepted(edges: DataFrame, classes: list[str] | None) -> DataFrame:
    return edges if classes is None else edges.where(F.col("class").isin(*classes))


def flow_reachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame, unknown: DataFrame | None = None, classes: list[str] | None = None) -> DataFrame:
    """graph, node, kind, via of each node: "flow" if an entry reaches it, "unknown" if only an unknown flow may, else null.

    nodes (graph, node, kind), edges (src, dst, class), entries (node) and unknown (node):
    nodes whose flow may go anywhere. First the entries are followed along edges of the
    given classes (all if null). In each graph where that meets an unknown node, all its
    statements and its unknown exit become possible, and so does what these lead to.
    Nodes of one graph are not in another; edges to no node count for nothing.
    """
    edges = storage.save(_accepted(edges, classes).select("src", "dst").distinct(), "flow")
    sure = distances(entries.select("node"), edges).select("node", F.lit("flow").alias("via"))
    found = storage.save(nodes.select("graph", "node", "kind").join(sure, "node", "left"), "found")
    if unknown is None or not found.where("via IS NOT NULL").join(unknown.select("node"), "node", "left_semi").limit(1).count():
        return found.select("graph", "node", "kind", "via")
    open_graphs = found.where("via IS NOT NULL").join(unknown.select("node"), "node", "left_semi").select("graph").distinct()
    seeds = found.where(F.col("kind").isin(*OPEN_KINDS)).join(open_graphs, "graph", "left_semi").select("node")
    maybe = distances(seeds, edges).select("node", F.lit("unknown").alias("maybe"))
    return found.join(maybe, "node", "left").select("graph", "node", "kind", F.coalesce("via", "maybe").alias("via"))


def unreachable(reached: DataFrame) -> DataFrame:
    """graph, node of the statements of flow_reachable() that nothing reaches."""
    return reached.where("via IS NULL AND kind = 'statement'").select("graph", "node")


def exit_transitions(reached: DataFrame, edges: DataFrame, exits: list[str], classes: list[str] | None = None) -> DataFrame:
    """The edges of the classes from a reached node into a node of one of the exit kinds."""
    inside = reached.where("via IS NOT NULL").select(F.col("node").alias("src"))
    ends = reached.where(F.col("kind").isin(*exits)).select(F.col("node").alias("dst"))
    return _accepted(edges, classes).join(inside, "src", "left_semi").join(ends, "dst", "left_semi").select(*edges.columns)


def flow_dominators(nodes: DataFrame, edges: DataFrame, entries: DataFrame, unknown: DataFrame | None = None, classes: list[str] | None = None) -> DataFrame:
    """node, idom, depth as dominator_tree() gives them, where an unknown node may also lead to every statement of its graph.

    Each graph gets a node of its own, numbered below 0, that stands between its unknown
    nodes and its statements; so no pairs of them are made. It is left out of the result.
    Nodes are 0 or more.
    """
    edges = _accepted(edges, classes).select("src", "dst")
    if unknown is None:
        return dominator_tree(edges, entries)
    hubs = storage.save(nodes.join(unknown.select("node"), "node", "left_semi").select("graph", "node"), "unknown")
    names = storage.save(hubs.groupBy("graph").agg((-1 - F.min("node")).alias("hub")), "hubs")
    leaving = hubs.join(names, "graph").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    arriving = nodes.where(F.col("kind").isin(*OPEN_KINDS)).join(names, "graph").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    tree = storage.save(dominator_tree(edges.union(leaving).union(arriving), entries), "tree")
    over = tree.where("node < 0").select(F.col("node").alias("idom"), F.col("idom").alias("above"))
    parents = tree.where("node >= 0").join(over, "idom", "left").select("node", F.coalesce("above", "idom").alias("idom"))
    parents = storage.save(parents, "tree")
    depths = doubled(parents.select("node", F.coalesce("idom", "node").alias("up")))[1]
    return parents.join(depths.select("node", "depth"), "node").select("node", "idom", "depth")


def reachability(nodes: DataFrame, edges: DataFrame, roots: DataFrame, dynamic: DataFrame | None = None) -> DataFrame:
    """node, tier: "confirmed", "possible", or "unreachable"; nodes that aren't private and not reached give no row.

    nodes (node, visibility), edges (src, dst). roots (root, node, confidence, exact) has a
    row for each node that a root may name: it confirms its node only if its confidence is
    "confirmed", the name is matched exactly and no other node bears it; else all its nodes
    are possible. dynamic (caller, target) are references by name: from a reached caller
    they make their target possible, never confirmed, and one without a target makes every
    node possible that isn't confirmed. Callers that nothing reaches count for nothing.

    That last rule is a stratum of its own: the closures don't depend on it, so it is
    decided once, after them.
    """
    edges = storage.save(edges.select("src", "dst").distinct(), "edges")
    named_once = roots.groupBy("root").agg(((F.min("node") == F.max("node")) & F.coalesce(F.min((F.col("confidence") == "confirmed") & F.col("exact")), F.lit(False))).alias("sure"))
    exact = storage.save(roots.where("node IS NOT NULL").select("root", "node").distinct().join(named_once, "root").select("node", "sure"), "roots")
    sure = distances(exact.where("sure").select("node").distinct(), edges).select("node")
    seeds, along, lost = exact.where("NOT sure").select("node"), edges, None
    if dynamic is not None:
        named = storage.save(dynamic.where("target IS NOT NULL").select(F.col("caller").alias("src"), F.col("target").alias("dst")).distinct(), "dynamic")
        seeds = seeds.union(named.join(sure.withColumnRenamed("node", "src"), "src", "left_semi").select("dst"))
        along = edges.union(named)
        lost = dynamic.where("target IS NULL AND caller IS NOT NULL").select(F.col("caller").alias("node"))
    maybe = distances(seeds.distinct(), along).select("node")
    if lost is not None and lost.join(sure.union(maybe), "node", "left_semi").limit(1).count():
        maybe = nodes.select("node")
    tiers = nodes.join(sure.withColumn("a", F.lit("confirmed")), "node", "left").join(maybe.distinct().withColumn("b", F.lit("possible")), "node", "left")
    private = F.when(F.lower("visibility") == "private", "unreachable")
    return tiers.select("node", F.coalesce("a", "b", private).alias("tier")).where("tier IS NOT NULL")
