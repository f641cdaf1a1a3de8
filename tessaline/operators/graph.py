"""Graphs by rounds of joins: distances, reachability, strong components, cycles, dominators.

Each round is a join of what is new with the edges and an anti join with what is known; it
is written to the shared folder, so lineage stays short and lost executors cost a re-read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.components import connected_components
from tessaline.operators.trees import doubled


def _step(new: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    return new.join(edges, new["node"] == edges["src"]).select(*group, F.col("dst").alias("node")).distinct()


def distances(roots: DataFrame, edges: DataFrame, group: list[str] = (), depth: int | None = None) -> DataFrame:
    """group, node, distance of all nodes reached from roots (group, node) along edges (src, dst)."""
    group, edges = list(group), edges.select("src", "dst").distinct()
    known = new = storage.save(roots.select(*group, "node").distinct().withColumn("distance", F.lit(0)), "reached")
    at = 0
    while depth is None or at < depth:
        at += 1
        fresh = _step(new, edges, group).join(known, [*group, "node"], "left_anti").withColumn("distance", F.lit(at))
        new = storage.save(fresh, "frontier")
        if not new.limit(1).count():
            break
        grown = storage.save(known.unionByName(new), "reached")
        storage.drop(known if at > 1 else None)
        known = grown
    return known


def impact(target: DataFrame, edges: DataFrame, direction: str, depth: int = 1) -> DataFrame:
    """node, distance of what a target (node) calls (callees), what calls it (callers) or both."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    along = {"callees": edges.select("src", "dst"), "callers": turned}
    sides = [distances(target, along[d], depth=depth) for d in (("callees", "callers") if direction == "both" else (direction,))]
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return found.where("distance > 0").join(target.select("node"), "node", "left_anti").groupBy("node").agg(F.min("distance").alias("distance"))


def scanned_edges(target: DataFrame, edges: DataFrame, direction: str, depth: int = 1) -> DataFrame:
    """src, dst and the other columns of all edges that impact() looks along, those to nodes seen before too.

    These are the edges out of (callees) or into (callers) the target and the nodes nearer
    than depth; nodes at the depth itself are not looked from, so depth 0 has none.
    """
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = []
    for side in ("callees", "callers") if direction == "both" else (direction,):
        near = distances(target, edges.select("src", "dst") if side == "callees" else turned, depth=depth).where(F.col("distance") < depth)
        end = "src" if side == "callees" else "dst"
        parts.append(edges.join(near.select(F.col("node").alias(end)), end, "left_semi").select(*edges.columns))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()


def targets(asked: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """name, status, node: a row for each symbol (name, node) that has an asked name, case ignored, so that candidates are listed.

    status is matched, ambiguous (several) or missing (then node is null).
    """
    known = symbols.select(F.lower(name).alias("_name"), "node").distinct()
    counts = known.groupBy("_name").agg(F.count("*").alias("_n"))
    found = asked.select(name).distinct().withColumn("_name", F.lower(name)).join(counts, "_name", "left").join(known, "_name", "left")
    return found.select(name, F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 1, "matched").otherwise("missing").alias("status"), "node")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component of the undirected graph between the given nodes."""
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = connected_components(inside.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst for all dst reached from each of the given nodes, itself included."""
    roots = nodes.select(F.col("node").alias("root"), "node")
    return distances(roots, edges, ["root"]).select(F.col("root").alias("src"), F.col("node").alias("dst"))


#: Edges that one task may search for strong components when no more are left.
LOCAL_EDGES = 50_000


def _components_of(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, largest node of its strong component) of a few edges: a search onward that numbers nodes as it leaves them, then one back in falling numbers."""
    onward, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        onward[a].append(b)
        back[b].append(a)
    left, seen = [], set()
    for start in {**onward, **back}:
        stack = [] if start in seen else [(start, iter(onward[start]))]
        seen.add(start)
        while stack:
            after = next((n for n in stack[-1][1] if n not in seen), None)
            if after is None:
                left.append(stack.pop()[0])
            else:
                seen.add(after)
                stack.append((after, iter(onward[after])))
    out, taken = [], set()
    for start in reversed(left):
        if start not in taken:
            members, queue = [], [start]
            taken.add(start)
            while queue:
                members.append(queue.pop())
                found = [n for n in back[members[-1]] if n not in taken]
                taken.update(found)
                queue += dict.fromkeys(found)
            out += [(m, max(members)) for m in members]
    return out


def _components_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _components_of([p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], names=["node", "colour"])


def strong_components(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component (its smallest node), size, cyclic (several nodes or a loop).

    Nodes without an edge in or out of the rest are trimmed off until none goes. What is
    left is coloured with the largest node that reaches it; the nodes that reach their
    colour's root back are its component and go. Rows never exceed nodes and edges. As soon
    as no more than local_edges edges are left, one task finishes them, which saves the long
    tail of rounds over little; nodes are longs.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")).distinct()
    left = storage.save(edges.where("src <> dst").select("src", "dst").distinct(), "scc")
    found = None
    while left.limit(1).count():
        if left.limit(local_edges + 1).count() <= local_edges:
            part = storage.save(left.coalesce(1).selectExpr("CAST(src AS long) AS src", "CAST(dst AS long) AS dst").mapInArrow(_components_here, "node long, colour long"), "members")
            found = part if found is None else found.union(part)
            break
        while True:
            both = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
            kept = storage.save(left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "scc")
            same = kept.count() == left.count()
            storage.drop(left)
            left = kept
            if same:
                break
        if not left.limit(1).count():
            break
        colours = _spread(left)
        on = lambda c, end: colours.select(F.col("node").alias(end), F.col("colour").alias(c))
        inner = storage.save(left.join(on("cs", "src"), "src").join(on("cd", "dst"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")), "scc")
        roots = colours.where("node = colour").select("node")
        members = distances(roots, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        part = storage.save(members.join(colours, "node").select("node", "colour"), "members")
        found = part if found is None else found.union(part)
        gone = part.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        after = storage.save(rest.select("src", "dst"), "scc")
        storage.drop(left)
        left = after
    found = found if found is not None else nodes.select("node", F.col("node").alias("colour")).limit(0)
    named = nodes.select("node").join(found, "node", "left").withColumn("colour", F.coalesce("colour", "node"))
    sizes = named.groupBy("colour").agg(F.count("*").alias("size"), F.min("node").alias("component"))
    return named.join(sizes, "colour").join(loops, "node", "left").select("node", "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def _spread(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node that reaches each node."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    now, total = storage.save(ends.withColumn("colour", F.col("node")), "colours"), None
    while True:
        sent = edges.join(now, edges["src"] == now["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        after = storage.save(now.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour")), "colours")
        mark = tuple(after.agg(F.sum(F.col("colour").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", "colour"))).first())
        storage.drop(now)
        now = after
        if mark == total:
            return now
        total = mark


def guaranteed(exits: DataFrame, edges: DataFrame, entry: DataFrame, cleanup: DataFrame) -> DataFrame:
    """exits (node) with guaranteed: it isn't reached from the entry without a cleanup node."""
    gone = cleanup.select("node")
    open_ = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    seen = distances(entry.join(gone, "node", "left_anti"), open_).select("node", F.lit(True).alias("open"))
    return exits.select("node").join(seen, "node", "left").select("node", F.col("open").isNull().alias("guaranteed"))


def must_facts(edges: DataFrame, entries: DataFrame, gives: DataFrame) -> DataFrame:
    """node, fact that hold on every path from the entry (graph, node) of its graph to the end of the node: gives (graph, node, fact).

    The complement is a may analysis: a fact can miss at a node if a path gets there
    without it; so each fact is a search that avoids the nodes that give it. Only facts
    that some node of the graph gives and that reach a node by some path can hold there.
    Graphs share no nodes; edges are src, dst.
    """
    edges = edges.select("src", "dst")
    inside = distances(entries.select("node"), edges).select("node")
    every = storage.save(distances(gives.select("fact", "node").join(inside, "node", "left_semi"), edges, ["fact"]).select("fact", "node"), "may")
    start = gives.select("graph", "fact").distinct().join(entries, "graph").select("fact", "node").join(gives, ["fact", "node"], "left_anti")
    known = new = storage.save(start, "missing")
    while True:
        new = storage.save(_step(new, edges, ["fact"]).join(gives, ["fact", "node"], "left_anti").join(known, ["fact", "node"], "left_anti"), "frontier")
        if not new.limit(1).count():
            break
        known = storage.save(known.unionByName(new), "missing")
    return every.join(known, ["fact", "node"], "left_anti").select("node", "fact")


def depths(df: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth of a forest given by parent pointers; roots (null parent) have depth 1.

    Nodes in a circle, below one, or below a parent that isn't there give no row; a null node
    counts for nothing. Rounds grow with the logarithm of the depth.
    """
    rows = df.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.coalesce(F.when(F.col(parent) != F.col(node), F.col(parent)).cast("long"), F.when(F.col(parent).isNull(), F.col(node)).cast("long")).alias("up"))
    return doubled(rows.where("up IS NOT NULL").distinct())[1].select("node", (F.col("depth") + 1).alias("depth"))


def witnesses(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, cycle, length: the shortest cycle through each cyclic component's smallest node.

    components is strong_components()' result. Of several shortest cycles the one with the
    smallest nodes from the front on is given; a loop is a cycle of one node. The search
    takes one step a round in all open components and ends for each with its first cycle,
    which every cyclic component has. Components without a cycle give no row.
    """
    of = components.where("cyclic").select("node", "component")
    inside = edges.select("src", "dst").distinct().join(of.withColumnRenamed("node", "src"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    inside = storage.save(inside.where("component = other").select("component", "src", "dst"), "inside")
    new = storage.save(of.where("node = component").select("component", "node", F.array("node").alias("path")), "paths")
    known, found, length = new.select("component", "node"), None, 0
    while new.limit(1).count():
        length += 1
        steps = new.join(inside.withColumnRenamed("src", "node"), ["component", "node"]).groupBy("component", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        steps = storage.save(steps, "steps")
        closed = steps.where("node = component").select("component", F.col("path").alias("cycle"), F.lit(length).alias("length"))
        found = closed if found is None else found.union(closed)
        going = steps.join(closed.select("component"), "component", "left_anti").join(known, ["component", "node"], "left_anti")
        new = storage.save(going.select("component", "node", F.concat("path", F.array("node")).alias("path")), "paths")
        known = known.union(new.select("component", "node"))
    return found if found is not None else new.select("component", F.col("path").alias("cycle"), F.lit(0).alias("length"))


def provenance(owners: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """owner, and the distinct evidence of the other nodes that each owner (owner) reaches along edges.

    evidence has node and further columns. Only the owners asked about are followed, when
    the result is read. An owner's own evidence is left out, also where a cycle leads back;
    an owner that reaches nothing gives no row.
    """
    asked = owners.select("owner", F.col("owner").alias("node")).distinct()
    reached = distances(asked, edges, ["owner"]).where("node <> owner").select("owner", "node")
    return reached.join(evidence, "node").select("owner", *evidence.columns).distinct()
