"""Elementary cycles and participation against plain searches."""

import random

from pyspark.sql import functions as F

from tessaline.operators import cycles, graph

rng = random.Random(7)


def plain(edges):
    steps = {}
    for a, b in edges:
        if a is not None and b is not None:
            steps.setdefault(a, set()).add(b)
    out = set()

    def visit(root, path):
        for n in steps.get(path[-1], ()):
            if n == root:
                out.add(tuple(path))
            elif n > root and n not in path:
                visit(root, [*path, n])

    for root in steps:
        visit(root, [root])
    return out


CASES = {
    "none": [],
    "no cycle": [(1, 2), (2, 3), (1, 3)],
    "loops, nulls, repeats": [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4), (4, None)],
    # a loop, two pairs, and a ring of three that shares its start with a ring of two
    "nested": [(10, 10), (21, 22), (22, 21), (21, 22), (31, 32), (32, 31), (32, 33), (33, 31), (41, 42), (42, 41), (50, 10)],
    "both ways round": [(1, 2), (2, 3), (3, 1), (1, 3), (3, 2), (2, 1)],
    "random": [(rng.randrange(12), rng.randrange(12)) for _ in range(34)],
    "several": [(10 * k + rng.randrange(7), 10 * k + rng.randrange(7)) for k in range(12) for _ in range(14)],
    "complete": [(i, j) for i in range(7) for j in range(7)],
}


def test_all_cycles(spark):
    """All cases side by side in one graph, a thousand numbers apart."""
    apart = {name: [tuple(None if x is None else 1000 * k + x for x in e) for e in edges] for k, (name, edges) in enumerate(CASES.items())}
    every = [e for edges in apart.values() for e in edges]
    got = cycles.cycles(spark.createDataFrame(every, "src long, dst long")).collect()
    assert len(got) == len({tuple(r.cycle) for r in got}) and {tuple(r.cycle) for r in got} == plain(every)
    assert all(r.complete and r.length == len(r.cycle) and r.component <= r.cycle[0] for r in got)
    assert cycles.cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_long_ring_and_dead_ends(spark):
    n = 3000
    ring = [(i, (i + 1) % n) for i in range(n)]
    ladder = [(n + 2 * i + a, n + 2 * i + 2 + b) for i in range(40) for a in (0, 1) for b in (0, 1)]  # 2^40 ways that lead nowhere
    df = spark.createDataFrame(ring + [(5, n)] + ladder, "src long, dst long")
    known = spark.range(n + 82).selectExpr("id AS node", f"if(id < {n}, 0, id) AS component", f"id < {n} AS cyclic")
    assert [r.length for r in cycles.cycles(df, known).collect()] == [n]
    # the same ways inside a component, where they all end at a node that the only way back has passed
    trap = [(0, 1), (1, 2), (2, 0), (2, 10)] + [(10 + 2 * i + a, 12 + 2 * i + b) for i in range(30) for a in (0, 1) for b in (0, 1)] + [(70, 1), (71, 1)]
    steps = {a: sorted({y for x, y in trap if x == a}) for a, _ in trap}
    assert list(cycles.cycles_from(0, {k: steps.get(k, []) for k in range(72)})) == [[0, 1, 2]]


def test_roots_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(cycles, "SPLIT_EDGES", 3)
    got = {tuple(r.cycle) for r in cycles.cycles(spark.createDataFrame(CASES["complete"] + CASES["random"], "src long, dst long")).collect()}
    assert got == plain(CASES["complete"] + CASES["random"])


def test_budget_gives_a_lower_bound(spark):
    dense = [(i, j) for i in range(10) for j in range(10) if i != j] + [(20, 21), (21, 20)]
    df, turned = (spark.createDataFrame(x, "src long, dst long") for x in (dense, dense[::-1]))
    counts = [sorted(tuple(r) for r in cycles.participation(cycles.cycles(d, budget=2000)).collect()) for d in (df, turned.repartition(5))]
    assert counts[0] == counts[1] and [n for n, _, _ in counts[0]] == [*range(10), 20, 21]
    whole = {r.node: r for r in cycles.participation(cycles.cycles(df)).collect()}
    assert all(r.complete for r in whole.values()) and whole[0].cycles == whole[9].cycles == 986_409
    assert all(0 < c < whole[n].cycles and not done for n, c, done in counts[0][:10]) and [tuple(x) for x in counts[0][10:]] == [(20, 1, True), (21, 1, True)]


def test_participation_of_given_cycles(spark):
    found = spark.createDataFrame([([1, 2],), ([2, 3, 4],), (None,)], "cycle array<long>")
    assert {r.node: (r.cycles, r.complete) for r in cycles.participation(found).collect()} == {1: (1, True), 2: (2, True), 3: (1, True), 4: (1, True)}


def test_steps_keep_the_earliest_parallel_edge(spark):
    edges = spark.createDataFrame([(2, 3, 20, "f"), (2, 3, 2, "g"), (3, 2, 3, "f"), (1, 1, 9, None)], "src long, dst long, line int, file string")
    got = cycles.cycle_edges(cycles.cycles(edges), edges, ["line"]).orderBy("src").collect()
    assert [(list(r.cycle), r.place, r.src, r.dst, r.line, r.file) for r in got] == [([1], 0, 1, 1, 9, None), ([2, 3], 0, 2, 3, 2, "g"), ([2, 3], 1, 3, 2, 3, "f")]
    assert cycles.cycle_edges(cycles.cycles(edges.where(F.lit(False))), edges, ["line"]).count() == 0


def test_strong_components_by_rounds_and_in_one_task(spark):
    edges = [e for name in ("loops, nulls, repeats", "nested", "random", "several") for e in CASES[name] if None not in e]
    nodes = spark.createDataFrame([(n,) for n in sorted({n for e in edges for n in e})], "node long")
    df = spark.createDataFrame(edges, "src long, dst long")
    once, rounds = (sorted(tuple(r) for r in graph.strong_components(nodes, df, local_edges=n).collect()) for n in (graph.LOCAL_EDGES, 0))
    assert once == rounds and len(once) == nodes.count() and any(size > 3 for _, _, size, _ in once)
