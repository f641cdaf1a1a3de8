"""Effects of procedures, handed from callees to callers.

Calls in circles share all their effects, so each strong component counts as one. What is
left has no circles: components go layer by layer, each after all it calls, so its set is
final when it hands it on and no set is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.graph import strong_components

#: The families of facts.
FAMILIES = ("effect", "state_change", "state_restore", "error", "uncertainty")
#: Fixed value: what the witness is kept for.
MAY_RAISE = "may_raise"


def call_edges(calls: DataFrame) -> DataFrame:
    """src, dst of the calls that carry effects: matched by one candidate, in reached and sound statements.

    calls: src, status, candidates (array of nodes), reachable, recovered. Nulls in these
    count against a call.
    """
    good = (F.col("status") == "matched") & (F.size("candidates") == 1) & F.col("reachable") & ~F.col("recovered")
    return calls.where(good).select("src", F.get("candidates", F.lit(0)).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def uncertain(calls: DataFrame) -> DataFrame:
    """node, family, fact: the outcome of each call in a reached and sound statement that isn't matched, as uncertainty of its caller."""
    open_ = F.col("reachable") & ~F.col("recovered") & (F.col("status") != "matched")
    return calls.where(open_).select(F.col("src").alias("node"), F.lit("uncertainty").alias("family"), F.col("status").alias("fact")).distinct()


def propagate(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """node, family, fact, direct: the facts (node, family, fact) of each node and of all that it calls along edges (src, dst).

    direct tells whether the node has the fact itself. Repeated facts and edges count once,
    those with a null node or fact for nothing. A fact goes over each call between components
    once. Nodes without facts give no row.
    """
    facts = storage.save(facts.select("node", "family", "fact").where("node IS NOT NULL AND fact IS NOT NULL").distinct(), "facts")
    edges = storage.save(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "calls")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(facts.select("node")).distinct()
    of = storage.save(strong_components(nodes, edges).select("node", "component"), "components")
    end = lambda name, c: of.select(F.col("node").alias(name), F.col("component").alias(c))
    left = storage.save(edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a <> b").select("a", "b").distinct(), "condensed")
    held = storage.save(facts.join(of, "node").select("component", "family", "fact").distinct(), "held")
    done = None
    while left.limit(1).count():
        waiting = left.select(F.col("a").alias("component")).distinct()
        ready = storage.save(held.join(waiting, "component", "left_anti").select("component", "family", "fact"), "layer")
        done = ready if done is None else done.union(ready)
        settled = left.select(F.col("b").alias("component")).distinct().join(waiting, "component", "left_anti")
        passing = left.join(settled.withColumnRenamed("component", "b"), "b", "left_semi")
        handed = passing.join(ready.withColumnRenamed("component", "b"), "b").select(F.col("a").alias("component"), "family", "fact")
        held = storage.save(held.join(waiting, "component", "left_semi").select("component", "family", "fact").union(handed).distinct(), "held")
        left = storage.save(left.join(settled.withColumnRenamed("component", "b"), "b", "left_anti").select("a", "b"), "condensed")
    every = held if done is None else done.union(held)
    found = every.join(of, "component").select("node", "family", "fact")
    return found.join(facts.withColumn("own", F.lit(True)), ["node", "family", "fact"], "left").select("node", "family", "fact", F.coalesce("own", F.lit(False)).alias("direct"))


def witnesses(facts: DataFrame, edges: DataFrame, fact: str = MAY_RAISE) -> DataFrame:
    """node, witness, chain: for each node that has a fact only by its calls, the callee that it comes from and the way to its origin.

    chain is the shortest way (node first, origin last), of several the one with the smallest
    nodes; so it doesn't hang on the order in which anything is worked out. witness is its
    second node. Nodes that have the fact themselves give no row. A round follows the callers
    of what the last one found; rows are one for each node.
    """
    edges = storage.save(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "calls")
    new = storage.save(facts.where(F.col("fact") == fact).select("node").where("node IS NOT NULL").distinct().withColumn("chain", F.array("node")), "chains")
    parts = [new]
    while new.limit(1).count():
        reached = parts[0].select("node")
        for part in parts[1:]:
            reached = reached.union(part.select("node"))
        steps = edges.join(new.select(F.col("node").alias("dst"), "chain"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("chain").alias("chain"))
        new = storage.save(steps.join(reached, "node", "left_anti").select("node", F.concat(F.array("node"), F.col("chain")).alias("chain")), "chains")
        parts.append(new)
    found = parts[0].where(F.lit(False))
    for part in parts[1:]:
        found = found.union(part)
    return found.select("node", F.get("chain", F.lit(1)).alias("witness"), "chain")
