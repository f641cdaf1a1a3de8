"""Dominator trees of flow graphs by contraction, with nearest common ancestors by doubling.

Nodes whose predecessors all lie in one group, headed by a node that dominates them, join
that group; chains of such nodes join together by pointer doubling. Their nearest dominator
is the nearest common ancestor of their predecessors in the group's tree, which is complete
by then. Back edges into a head vanish with the contraction, so what is called reducible
ends in a few rounds, whatever its depth. What is left (loops with several entries) starts
from a breadth-first tree and moves each head up to the common ancestor of its predecessors
until none moves: dominators always stay among the ancestors, and at the end they are these.

All graphs of a table run together; where they have few edges in all, one task searches them. Rows are nodes and edges, and nodes times the logarithm
of the depth while ancestors are looked up; no reachability of pairs is built.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.graph import distances
from tessaline.operators.trees import doubled


def _lifted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with to, the ancestor of their node at by a table of doubled()."""
    return rows.join(table.select(F.col("node").alias("at"), F.col("up").alias("to")), "at")


def nearest(sets: DataFrame, parents: DataFrame) -> DataFrame:
    """x, up: the nearest common ancestor of the nodes at of each x, in sets (x, at); it may be one of them.

    All nodes of a set are in one tree of parents (node, up).
    """
    tables, depths = doubled(parents)
    rows = sets.join(depths.select(F.col("node").alias("at"), "depth"), "at").select("x", "at", "depth")
    least = rows.groupBy("x").agg(F.min("depth").alias("least"))
    rows = storage.save(rows.join(least, "x").select("x", "at", (F.col("depth") - F.col("least")).alias("above")).distinct(), "sets")
    for k, table in enumerate(tables):
        bit = F.col("above").bitwiseAND(1 << k) != 0
        if rows.where(bit).limit(1).count():
            rows = storage.save(rows.where(~bit).union(_lifted(rows.where(bit), table).select("x", F.col("to").alias("at"), "above")).distinct(), "sets")
    rows = rows.select("x", "at").distinct()
    done = None
    for k in range(len(tables) - 1, -2, -1):  # the last step goes to the parents
        counts = rows.groupBy("x").agg(F.min("at").alias("up"), F.max("at").alias("other"))
        met = counts.where("up = other").select("x", "up")
        done = met if done is None else done.union(met)
        rows = storage.save(rows.join(met.select("x"), "x", "left_anti"), "sets")
        if k < 0 or not rows.limit(1).count():
            break
        up = storage.save(_lifted(rows, tables[k]), "lifted")
        apart = up.groupBy("x").agg(F.min("to").alias("a"), F.max("to").alias("b")).select("x", (F.col("a") != F.col("b")).alias("apart"))
        rows = storage.save(up.join(apart, "x").select("x", F.when(F.col("apart"), F.col("to")).otherwise(F.col("at")).alias("at")).distinct(), "sets")
    if rows.limit(1).count():
        done = done.union(_lifted(rows, tables[0]).select("x", F.col("to").alias("up")).distinct())
    return storage.save(done.distinct(), "nearest")


#: Edges of all graphs that one task may search.
LOCAL_EDGES = 50_000


def _tree_of(pairs: list[tuple[int | None, int]]) -> list[tuple[int, int | None, int]]:
    """(node, idom, depth) of a few edges; entries come as edges from None.

    Nodes are numbered as a depth-first search leaves them. Each one's dominator is where
    the ways up from its predecessors meet, in falling numbers, until none moves.
    """
    onward, before = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        onward[a].append(b)
        before[b].append(a)
    number, order, stack, seen = {}, [], [(None, iter(onward[None]))], {None}
    while stack:
        after = next((n for n in stack[-1][1] if n not in seen), stack)
        if after is stack:
            node = stack.pop()[0]
            number[node] = len(order)
            order.append(node)
        else:
            seen.add(after)
            stack.append((after, iter(onward[after])))
    above, moved = {None: None}, True
    while moved:
        moved = False
        for node in order[-2::-1]:
            known = [n for n in before[node] if n in above]
            meet = known[0]
            for other in known[1:]:
                while meet != other:
                    if number[meet] < number[other]:
                        meet = above[meet]
                    else:
                        other = above[other]
            if node not in above or above[node] != meet:
                above[node], moved = meet, True
    depth, out = {None: -1}, []
    for node in order[-2::-1]:
        depth[node] = depth[above[node]] + 1
        out.append((node, above[node], depth[node]))
    return out


def _tree_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _tree_of([p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["node", "idom", "depth"])


def dominator_tree(edges: DataFrame, entries: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, idom, depth of every node that entries (node) reach along edges (src, dst), which are longs.

    idom is the nearest node that all paths from the entry to the node go through; it is null
    for an entry, whose depth is 0. Graphs of several entries must not share nodes. Repeated
    edges, loops, edges with a null and those into an entry count for nothing; nodes that no
    entry reaches give no row.
    """
    entries = storage.save(entries.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct(), "entries")
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct()
    edges = storage.save(edges.join(entries.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    every = edges.union(entries.select(F.lit(None).cast("long"), "node"))
    if every.limit(local_edges + 1).count() <= local_edges:
        return storage.save(every.coalesce(1).mapInArrow(_tree_here, "node long, idom long, depth long"), "tree")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(entries).distinct()
    groups = storage.save(nodes.select("node", F.col("node").alias("head"), F.col("node").alias("up")), "groups")
    while True:
        between = edges.join(groups.select(F.col("node").alias("src"), F.col("head").alias("a")), "src").join(groups.where("node = head").select(F.col("node").alias("dst")), "dst").where("a <> dst")
        between = storage.save(between.select("src", "dst", "a"), "between")
        heads = groups.where("node = head").select("node").join(entries, "node", "left_anti")
        before = between.groupBy(F.col("dst").alias("node")).agg(F.min("a").alias("low"), F.max("a").alias("high"))
        heads = storage.save(heads.join(before, "node", "left"), "heads")
        if not heads.limit(1).count():
            break
        joining = heads.where("low = high").select("node", F.col("low").alias("up"))
        lost = heads.where("low IS NULL").select("node")
        if joining.limit(1).count():
            groups = _joined(groups, storage.save(joining, "joining"), between, lost)
        elif lost.limit(1).count():
            groups = storage.save(groups.join(lost.withColumnRenamed("node", "head"), "head", "left_anti").select("node", "head", "up"), "groups")
        else:
            core = between.select(F.col("a").alias("src"), "dst").distinct()
            found = distances(entries, core)
            kept = storage.save(groups.join(found.select(F.col("node").alias("head")), "head", "left_semi").select("node", "head", "up"), "groups")
            if kept.count() < groups.count():
                groups = kept
                continue
            groups = _settled(groups, between, found)
            break
    depths = doubled(groups.select("node", "up"))[1]
    return depths.join(groups.select("node", "up"), "node").select("node", F.when(F.col("depth") > 0, F.col("up")).alias("idom"), "depth")


def _joined(groups: DataFrame, joining: DataFrame, between: DataFrame, lost: DataFrame) -> DataFrame:
    """groups (node, head, up) after the heads joining (node, up) have gone to the group before them, less lost heads and heads in circles."""
    kept = groups.where("node = head").select("node").join(joining.select("node"), "node", "left_anti").join(lost, "node", "left_anti")
    tops = doubled(joining.union(kept.select("node", F.col("node").alias("up"))).union(lost.select("node", F.lit(-1).cast("long"))))[1]
    sets = between.join(joining.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("x"), F.col("src").alias("at")).distinct()
    single = storage.save(sets.groupBy("x").agg(F.min("at").alias("up"), F.count("*").alias("n")), "single")
    up = single.where("n = 1").select("x", "up")
    if single.where("n > 1").limit(1).count():
        several = sets.join(single.where("n > 1").select("x"), "x", "left_semi")
        of = between.join(several.select(F.col("x").alias("dst")), "dst", "left_semi").select(F.col("a").alias("head")).distinct()
        up = up.union(nearest(several, groups.join(of, "head", "left_semi").select("node", "up")))
    moved = groups.join(tops.select(F.col("node").alias("head"), "root"), "head").join(up.select(F.col("x").alias("node"), F.col("up").alias("new")), "node", "left")
    return storage.save(moved.select("node", F.col("root").alias("head"), F.coalesce("new", "up").alias("up")), "groups")


def _settled(groups: DataFrame, between: DataFrame, found: DataFrame) -> DataFrame:
    """groups with the nearest dominators of the heads that no contraction takes, from a breadth-first tree on (found: node, distance)."""
    at = found.select(F.col("node").alias("a"), F.col("distance").alias("d"))
    first = between.join(at, "a").join(found.select(F.col("node").alias("dst"), F.col("distance").alias("own")), "dst").where("own = d + 1").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("new"))
    sets = storage.save(between.select(F.col("dst").alias("x"), F.col("src").alias("at")).distinct(), "sets")
    while True:
        after = storage.save(groups.join(first, "node", "left").select("node", "head", F.coalesce("new", "up").alias("up")), "groups")
        first = nearest(sets, after.select("node", "up")).select(F.col("x").alias("node"), F.col("up").alias("new"))
        if not after.join(first, "node").where("up <> new").limit(1).count():
            return after
        groups = after


def dominates(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """pairs (dominator, node) with dominates: whether the one is on every path to the other; a node dominates itself.

    tree is dominator_tree()'s result. Pairs with a node that isn't reached, or a null, get null.
    """
    tables, _ = doubled(tree.select("node", F.coalesce("idom", "node").alias("up")))
    of = tree.select("node", "depth")
    known = pairs.select("dominator", "node").distinct().join(of, "node").join(of.select(F.col("node").alias("dominator"), F.col("depth").alias("wanted")), "dominator")
    rows = storage.save(known.select("dominator", "node", F.col("node").alias("at"), (F.col("depth") - F.col("wanted")).alias("above")), "pairs")
    for k, table in enumerate(tables):
        bit = (F.col("above") > 0) & (F.col("above").bitwiseAND(1 << k) != 0)
        if rows.where(bit).limit(1).count():
            rows = storage.save(rows.where(~bit).union(_lifted(rows.where(bit), table).select("dominator", "node", F.col("to").alias("at"), "above")), "pairs")
    answers = rows.select("dominator", "node", ((F.col("above") >= 0) & (F.col("at") == F.col("dominator"))).alias("dominates"))
    return pairs.join(answers, ["dominator", "node"], "left")
