"""Reachability in strata, effects and taint with paths against plain fixpoints."""

import random

from tessaline.operators import dataflow, effects, reach

rng = random.Random(23)


def reached(starts, pairs):
    seen, queue = set(starts), list(starts)
    while queue:
        x = queue.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                queue.append(b)
    return seen


def test_unknown_flow_opens_its_graph_only(spark):
    kinds = {0: "entry", 1: "statement", 2: "statement", 3: "statement", 4: "exit", 5: "unknown_exit", 10: "entry", 11: "statement", 12: "statement", 13: "exit", 20: "entry", 21: "statement", 22: "statement"}
    nodes = spark.createDataFrame([(n // 10, n, k) for n, k in kinds.items()], "graph long, node long, kind string")
    edges = [(0, 1, "normal"), (1, 4, "exceptional"), (3, 4, "normal"), (10, 11, "normal"), (12, 13, "normal"), (20, 21, "exceptional"), (21, 22, "normal")]
    df = spark.createDataFrame(edges, "src long, dst long, class string")
    entries, unknown = (spark.createDataFrame([(x,) for x in xs], "node long") for xs in ([0, 10, 20], [1, 12, 21]))
    via = lambda **kw: {r.node: r.via for r in reach.flow_reachable(nodes, df, entries, **kw).collect()}
    plain = via()
    assert [n for n in kinds if plain[n] is None] == [2, 3, 5, 12, 13] and len(plain) == len(kinds)
    every = via(unknown=unknown)
    assert {n for n in kinds if every[n] == "unknown"} == {2, 3, 5} and every[4] == "flow" and every[12] is None and every[22] == "flow"
    normal = reach.flow_reachable(nodes, df, entries, unknown, ["normal"])
    assert {r.node for r in reach.unreachable(normal).collect()} == {12, 21, 22}  # 21 is unknown, but nothing normal reaches it
    assert {(r.src, r.dst) for r in reach.exit_transitions(normal, df, ["exit"], ["normal"]).collect()} == {(3, 4)}
    tree = {r.node: (r.idom, r.depth) for r in reach.flow_dominators(nodes, df, entries, unknown).collect()}
    assert tree == {0: (None, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (1, 2), 5: (1, 2), 10: (None, 0), 11: (10, 1), 20: (None, 0), 21: (20, 1), 22: (21, 2)}


def tiers(nodes, edges, roots, dynamic):
    by_root = {}
    for root, n, confidence, exact in roots:
        if n is not None:
            by_root.setdefault(root, []).append((n, confidence == "confirmed" and exact))
    sure = reached({found[0][0] for found in by_root.values() if len({n for n, _ in found}) == 1 and all(ok for _, ok in found)}, edges)
    maybe = {n for found in by_root.values() for n, _ in found if not (len({x for x, _ in found}) == 1 and all(ok for _, ok in found))}
    named = [(a, b) for a, b in dynamic if b is not None]
    maybe = reached(maybe | {b for a, b in named if a in sure}, edges + named)
    if any(a in sure | maybe for a, b in dynamic if b is None):
        maybe = {n for n, _ in nodes}
    found = {n: "confirmed" if n in sure else "possible" if n in maybe else "unreachable" if v == "Private" else None for n, v in nodes}
    return {n: t for n, t in found.items() if t}


def test_reachability_with_names_and_unknown_targets(spark):
    for trial in range(2):
        nodes = [(n, rng.choice(["Private", "Public"])) for n in range(30)]
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(22)]
        roots = [("main", 0, "confirmed", True), ("both", 4, "confirmed", True), ("both", 5, "confirmed", True), ("loose", 7, "confirmed", False), ("api", 9, "possible", True), ("none", None, "confirmed", True)]
        dynamic = [(rng.randrange(30), rng.randrange(30)) for _ in range(6)] + ([(rng.randrange(30), None)] if trial % 2 else []) + [(None, None)]
        got = reach.reachability(spark.createDataFrame(nodes, "node long, visibility string"), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(roots, "root string, node long, confidence string, exact boolean"), spark.createDataFrame(dynamic, "caller long, target long"))
        assert {r.node: r.tier for r in got.collect()} == tiers(nodes, edges, roots, dynamic)


def test_effects_of_diamonds_and_circles(spark):
    calls = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(50, 51), (50, 52), (51, 53), (52, 53), (53, 50)]
    facts = [(rng.randrange(40), rng.choice(effects.FAMILIES), rng.choice("abc")) for _ in range(25)] + [(53, "effect", "writes"), (53, "effect", "writes"), (None, "effect", "x"), (60, "error", "alone")]
    f, e = spark.createDataFrame(facts, "node long, family string, fact string"), spark.createDataFrame([*calls, calls[0], (None, 1)], "src long, dst long")
    own = {x for x in facts if x[0] is not None}
    want = {(n, family, fact): (n, family, fact) in own for n in {x for c in calls for x in c} | {n for n, _, _ in own} for m, family, fact in own if m in reached({n}, calls)}
    got = effects.propagate(f, e).collect()
    assert {(r.node, r.family, r.fact): r.direct for r in got} == want and len(got) == len(want)
    assert effects.propagate(f.limit(0), e).count() == 0


def test_which_calls_carry_effects(spark):
    rows = [(1, "matched", [2], True, False), (1, "matched", [3, 4], True, False), (1, "matched", [5], False, False), (1, "matched", [6], True, True), (1, "ambiguous", [7], True, False), (1, "external", None, True, False), (1, "external", None, False, False), (1, None, [8], True, False)]
    df = spark.createDataFrame(rows, "src long, status string, candidates array<long>, reachable boolean, recovered boolean")
    assert [tuple(r) for r in effects.call_edges(df).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in effects.uncertain(df).collect()) == [(1, "uncertainty", "ambiguous"), (1, "uncertainty", "external")]


def test_witness_is_the_next_step_of_the_shortest_way(spark):
    facts = spark.createDataFrame([(9, "error", "may_raise"), (5, "error", "other"), (6, "error", "may_raise")], "node long, family string, fact string")
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (1, 4), (4, 9), (1, 8), (8, 9), (9, 1), (6, 1), (7, 7)], "src long, dst long")
    got = {r.node: (r.witness, list(r.chain)) for r in effects.witnesses(facts, calls).collect()}
    assert got == {1: (4, [1, 4, 9]), 2: (3, [2, 3, 9]), 3: (9, [3, 9]), 4: (9, [4, 9]), 8: (9, [8, 9])}


SINKS = ["shell", "sql", "http"]


def plain_taint(edges, sources, assigns, kills, cleaners, guards, entries):
    """Facts where nodes end, by rounds over all of them until nothing changes."""
    binds = {(n, v) for n, v, _, _ in sources} | set(kills) | {(n, t) for n, t, _ in assigns}
    live = reached(entries, edges)
    bound = {v: reached({n for n, w in binds if w == v}, edges) for v in {v for _, v in binds}}
    nodes = {n for e in edges for n in e} | {n for n, _ in binds}

    def left(n, entered):
        out = []
        for v, o, state, path, safe in entered:
            safe = safe | {s for m, w, s in cleaners if (m, w) == (n, v)}
            if (n, v) not in kills and not any((m, t) == (n, v) for m, t, _ in assigns):
                out.append((v, o, state, path, safe))
            out += [(t, o, state, (*path, ("assignment", n)), safe) for m, t, value in assigns if (m, value) == (n, v)]
        return out

    def join(rows):
        out = {}
        for v, o, state, path, safe in rows:
            s, p, f = out.get((v, o), (state, path, safe))
            out[v, o] = (max(s, state), min(p, path, key=lambda x: (len(x), x)), f & safe)
        return out

    begins = {n: {} for n in nodes}
    ends = {n: {} for n in nodes}
    while True:
        before = repr((begins, ends))
        for n in nodes:
            rows = [(v, o, *fact) for p in nodes if (p, n) in edges for (v, o), fact in ends[p].items() if (p, n, v) not in guards]
            ways = {a for a, b in edges if b == n and a in live}
            rows += [(v, "unbound", 2, (("unbound", n),), frozenset()) for v in bound if ways & bound[v] and ways - bound[v]]
            begins[n] = join(rows)
            ends[n] = join([(v, o, s, (("source", n),), frozenset()) for m, v, o, s in sources if m == n] + left(n, [(v, o, *f) for (v, o), f in begins[n].items()]))
        if repr((begins, ends)) == before:
            return ends, begins


def flat(facts):
    return {(n, v, o): (s, p, f) for n, found in facts.items() for (v, o), (s, p, f) in found.items()}


def read(df):
    return {(r.node, r["var"], r.origin): (r.state, tuple((s.kind, s.node) for s in r.path), frozenset(x for k, x in enumerate(SINKS) if r.safe >> k & 1)) for r in df.collect()}


def test_taint_keeps_the_worst_state_the_shortest_path_and_what_all_ways_are_safe_for(spark):
    edges, sources, assigns, kills, cleaners, guards = set(), [], set(), set(), set(), set()
    for base in (0, 100):
        edges |= {(base + rng.randrange(14), base + rng.randrange(14)) for _ in range(24)} | {(base, base + 1), (base + 1, base + 2)}
        n, var = lambda b=base: b + rng.randrange(14), lambda: rng.choice("xyz")
        sources += [(n(), var(), f"o{k}", rng.choice([1, 2])) for k in range(3)]
        assigns |= {(n(), var(), var()) for _ in range(7)}
        kills |= {(n(), var()) for _ in range(2)}
        cleaners |= {(n(), var(), rng.choice(SINKS)) for _ in range(8)}
        edges |= {(base, base + 20), (base + 20, base + 21), (base + 20, base + 22), (base + 21, base + 23), (base + 22, base + 23)}
        assigns.add((base + 21, "w", "x"))  # w has a value on one of two ways
        guards |= {(*rng.choice(sorted(edges)), var()) for _ in range(3)}
    assigns = {a for a in assigns if a[1] != a[2] and (a[0], a[1]) not in {(n, v) for n, v, *_ in sources}}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    found, begins = dataflow.taint_paths(
        frame(edges, "src long, dst long"), frame(sources, "node long, var string, origin string, state int"), frame(assigns, "node long, target string, value string"), frame(kills, "node long, var string"),
        SINKS, frame(cleaners, "node long, var string, sink string"), frame(guards, "src long, dst long, var string"), frame([(0,), (100,)], "node long"),
    )
    ends, starts = plain_taint(edges, sources, assigns, kills, cleaners, guards, {0, 100})
    assert read(found) == flat(ends) and read(begins) == flat(starts) and len(flat(ends)) > 40
    assert any(f for _, _, f in flat(ends).values()) and any(o == "unbound" for _, _, o in flat(starts))
    uses = {(n, s, v) for n, v, _ in flat(starts) for s in SINKS if rng.random() < 0.5}
    got = {(r.node, r.sink, r["var"], r.origin) for r in dataflow.path_findings(begins, frame(uses, "node long, sink string, var string"), SINKS).collect()}
    assert got == {(n, s, v, o) for (n, v, o), (_, _, f) in flat(starts).items() for m, s, w in uses if (m, w) == (n, v) and s not in f}


def test_two_ways_meet_in_the_unknown_state_and_the_shorter_path(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    sources = spark.createDataFrame([(1, "a", "input", 1), (3, "raw", "input", 2)], "node long, var string, origin string, state int")
    assigns = spark.createDataFrame([(2, "raw", "a")], "node long, target string, value string")
    none = spark.createDataFrame([], "node long, var string")
    found = read(dataflow.taint_paths(edges, sources, assigns, none, SINKS)[1])
    assert found[4, "raw", "input"] == (2, (("source", 3),), frozenset())
    assert dataflow.taint_paths(edges, sources.limit(0), assigns, none, SINKS)[0].count() == 0
