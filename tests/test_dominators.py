"""Dominator trees against removal of each node."""

import random

from tessaline.operators import dominators

rng = random.Random(13)


def plain(edges, entry):
    steps = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)

    def reach(without):
        seen, queue = {entry}, [entry]
        while queue:
            for n in steps.get(queue.pop(), ()):
                if n != without and n not in seen:
                    seen.add(n)
                    queue.append(n)
        return seen if without != entry else set()

    every = reach(None)
    strict = {n: {d for d in every if d != n and n not in reach(d)} for n in every}
    return {n: (max(ds, key=lambda d: len(strict[d]), default=None), len(ds)) for n, ds in strict.items()}, strict


def graphs():
    yield [(0, 1), (1, 2), (2, 1), (2, 3), (3, 0), (9, 3), (8, 9), (9, 8)]  # a loop, an edge into the entry, an unreachable ring
    yield [(0, 1), (0, 2), (1, 2), (2, 1), (1, 3), (2, 3)]  # a loop with two entries
    yield [(0, 1), (0, 2), (1, 3), (2, 4), (3, 4), (4, 3), (3, 5), (4, 6), (5, 7), (6, 7), (7, 3)]
    yield []
    for size, many in ((25, 60), (40, 52)):
        yield [(rng.randrange(size), rng.randrange(size)) for _ in range(many)]


def test_trees_match_brute_force(spark):
    all_, want, strict = [], {}, {}
    for k, edges in enumerate(graphs()):
        found, above = plain(edges, 0)
        all_ += [(1000 * k + a, 1000 * k + b) for a, b in edges]
        want |= {1000 * k + n: (None if d is None else 1000 * k + d, depth) for n, (d, depth) in found.items()}
        strict |= {1000 * k + n: {1000 * k + d for d in ds} for n, ds in above.items()}
    edges = spark.createDataFrame([*all_, *all_[:5], (None, 3), (4, None)], "src long, dst long")
    entries = spark.createDataFrame([(1000 * k,) for k in range(6)] + [(None,)], "node long")
    tree = dominators.dominator_tree(edges, entries)
    assert {r.node: (r.idom, r.depth) for r in tree.collect()} == want
    rounds = dominators.dominator_tree(edges, entries, local_edges=0)
    assert {r.node: (r.idom, r.depth) for r in rounds.collect()} == want
    nodes = sorted(want)
    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(300)] + [(d, n) for n in nodes for d in sorted(strict[n])[:2]] + [(0, 0), (77777, 0), (None, 0)]
    got = dominators.dominates(spark.createDataFrame(asked, "dominator long, node long"), tree).collect()
    assert len(got) == len(asked)
    assert all(r.dominates == (None if r.dominator not in want else r.dominator == r.node or r.dominator in strict[r.node]) for r in got)


def test_long_chain_and_diamonds(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    base = 10 * n  # each diamond goes from 3i to 3i + 1 and 3i + 2, which meet at 3i + 3
    pairs = ", ".join(f"named_struct('src', 3 * id + {a + base}, 'dst', 3 * id + {b + base})" for a, b in ((0, 1), (0, 2), (1, 3), (2, 3)))
    diamonds = spark.range(n // 3).selectExpr(f"inline(array({pairs}))")
    tree = dominators.dominator_tree(chain.union(diamonds), spark.createDataFrame([(0,), (base,)], "node long"))
    assert tree.where(f"node < {base} AND (idom <> node - 1 OR depth <> node)").count() == 0
    assert tree.where(f"node > {base} AND idom <> node - if(pmod(node - {base}, 3) = 0, 3, pmod(node - {base}, 3))").count() == 0
    assert tree.count() == n + 1 + n // 3 * 3 + 1
