"""All elementary cycles of a directed graph, each found once, from its smallest node.

Strong components are found by joins. Then roots are dealt out: a task gets the edges of a
component and those of its nodes that it starts from. From each root it searches the nodes
not below it that the root reaches and that reach the root, so every step can still come
back; a node whose search found no way back stays blocked until a node behind it opens.
Between two cycles that takes one pass over the component's edges at most, so the work
grows with the cycles and not with the dead ends.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.graph import strong_components

#: Edges of a component from which its roots are dealt out to several tasks, and to how many at most.
SPLIT_EDGES, MOST_PARTS = 256, 64
#: Cycles that a task hands over at once.
HANDED = 8192

Steps = dict[int, list[int]]


def _within(root: int, steps: Steps, back: Steps) -> Steps:
    """The steps between nodes not below root that root reaches and that reach it."""
    sides = []
    for along in (steps, back):
        seen, queue = {root}, deque([root])
        while queue:
            for node in along.get(queue.popleft(), ()):
                if node >= root and node not in seen:
                    seen.add(node)
                    queue.append(node)
        sides.append(seen)
    inside = sides[0] & sides[1]
    return {n: [m for m in steps.get(n, ()) if m in inside] for n in inside}


def cycles_from(root: int, steps: Steps, budget: int | None = None) -> Iterator[list[int] | None]:
    """The elementary cycles over root, which all steps lead back to, in the order of their nodes.

    After so many steps as budget says the search ends with None.
    """
    path, after, closed = [root], [iter(steps[root])], [False]
    blocked, waiting, work = {root}, defaultdict(set), 0
    while path:
        for node in after[-1]:
            work += 1
            if budget is not None and work > budget:
                yield None
                return
            if node == root:
                closed[-1] = True
                yield list(path)
            elif node not in blocked:
                blocked.add(node)
                path.append(node)
                after.append(iter(steps[node]))
                closed.append(False)
                break
        else:
            left, led = path.pop(), closed.pop()
            after.pop()
            if led:
                opened = [left]
                while opened:
                    if (node := opened.pop()) in blocked:
                        blocked.remove(node)
                        opened += waiting.pop(node, ())
                if closed:
                    closed[-1] = True
            else:
                for node in steps[left]:
                    waiting[node].add(left)


_ARROW = pa.schema([("component", pa.int64()), ("cycle", pa.list_(pa.int64())), ("length", pa.int64()), ("complete", pa.bool_())])


def cycles(edges: DataFrame, components: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """component, cycle, length, complete: all elementary cycles of edges (src, dst), which are longs.

    A cycle is an array of its nodes from the smallest on; a loop has one. Cycles of the same
    nodes in another order are others; repeated edges count once and edges with a null for
    nothing. component is the smallest node of the strong component; components, if given,
    is strong_components() of all nodes.

    Without a budget every cycle is listed and complete is true throughout. With one, the
    search from each node ends after so many steps; such a search adds a row with a null
    cycle and complete = false, and its other rows are those found till then, the same in
    every run. No cycles give no rows.

    A task holds the edges of one component and hands cycles on as they are found.
    """
    edges = storage.save(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    if components is None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        components = strong_components(nodes, edges)
    of = storage.save(components.where("cyclic").select("node", "component"), "components")
    ends = edges.join(of.withColumnRenamed("node", "src"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    inside = storage.save(ends.where("component = other").select("component", "src", "dst"), "inside")
    sizes = inside.groupBy("component").agg(F.least(F.ceil(F.count("*") / SPLIT_EDGES), F.lit(MOST_PARTS)).cast("int").alias("parts"))
    dealt = inside.join(storage.broadcast_if_small(storage.save(sizes, "sizes")), "component").select("component", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst")

    def search(key: tuple[int, int, int], pairs: list[tuple[int, int]]) -> Iterator[tuple]:
        steps, back = defaultdict(list), defaultdict(list)
        for a, b in pairs:
            steps[a].append(b)
            back[b].append(a)
        for root in sorted(steps)[key[2] :: key[1]]:
            for found in cycles_from(root, _within(root, steps, back), budget):
                yield (key[0], found, len(found), True) if found else (key[0], None, None, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            now, pairs = None, []
            for batch in batches:
                for *key, src, dst in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if tuple(key) != now:
                        if pairs:
                            yield now, pairs
                        now, pairs = tuple(key), []
                    pairs.append((src, dst))
            if pairs:
                yield now, pairs

        out: list[tuple] = []
        for key, pairs in groups():
            for row in search(key, pairs):
                out.append(row)
                if len(out) >= HANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, _ARROW, strict=True)], schema=_ARROW)

    rows = dealt.repartition("component", "part").sortWithinPartitions("component", "part", "src", "dst")
    return rows.select("component", "parts", "part", "src", "dst").mapInArrow(run, "component long, cycle array<long>, length long, complete boolean")


def cycle_edges(found: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """cycle, place (from 0), src, dst and the other columns of the first of the parallel edges by order, for each step of each cycle.

    Rows of found without a cycle give none.
    """
    steps = found.where("cycle IS NOT NULL").select("cycle", F.posexplode("cycle").alias("place", "src"))
    steps = steps.withColumn("dst", F.get("cycle", ((F.col("place") + 1) % F.size("cycle")).cast("int")))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    first = edges.groupBy("src", "dst").agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("first"))
    return steps.join(first, ["src", "dst"]).select("cycle", "place", "src", "dst", *(F.col("first")[c].alias(c) for c in rest))


def participation(found: DataFrame) -> DataFrame:
    """node, cycles, complete: in how many of cycles()' rows each node is, and whether that is all.

    complete is false for the nodes of a component of which some search was cut off: their
    number is a lower bound. Nodes in no cycle give no row. Without a column complete all are
    complete; a null cycle counts for nothing.
    """
    if "complete" not in found.columns:
        found = found.select("cycle", F.lit(None).cast("long").alias("component"), F.lit(True).alias("complete"))
    counts = found.where("cycle IS NOT NULL").select("component", F.explode("cycle").alias("node")).groupBy("component", "node").agg(F.count("*").alias("cycles"))
    cut = found.where("NOT complete").select("component", F.lit(True).alias("cut")).distinct()
    return counts.join(cut, "component", "left").select("node", "cycles", F.col("cut").isNull().alias("complete"))
