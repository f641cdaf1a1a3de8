"""Forward analyses over flow graphs by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.operators.graph import distances


#: A literal of a comparison or a case: a string with doubled quotes, a number or a truth value.
LITERAL = r'(?:"(?:[^"]|"")*"|[+-]?[0-9]+(?:\.[0-9]+)?|True|False)'


def equality_guards(branches: DataFrame) -> DataFrame:
    """src, dst, var: edges on which a variable equals a literal, so that it carries no taint.

    branches has src, dst, kind, condition, selector. An edge of kind branch_true guards the
    name in a condition "name = literal"; one of kind case guards its selector if its
    condition is a list of literals. Anything else, nulls included, guards nothing.
    """
    compared = rf"(?i)^\s*([a-z]\w*)\s*=\s*{LITERAL}\s*$"
    listed = rf"(?i)^\s*{LITERAL}(\s*,\s*{LITERAL})*\s*$"
    var = F.when((F.col("kind") == "branch_true") & F.col("condition").rlike(compared), F.regexp_extract("condition", compared, 1))
    var = var.when((F.col("kind") == "case") & F.col("condition").rlike(listed), F.col("selector"))
    return branches.select("src", "dst", var.alias("var")).where("var is not null").distinct()


def _entered(tainted: DataFrame, edges: DataFrame, guards: DataFrame | None, group: list[str], keep: list[str]) -> DataFrame:
    """What is tainted when a node begins: what leaves the nodes before it, less the guarded variables of an edge."""
    rows = tainted.select(*group, F.col("node").alias("src"), *keep).join(edges.select(*group, "src", "dst"), [*group, "src"])
    if guards is not None:
        rows = rows.join(guards.select(*group, "src", "dst", "var"), [*group, "src", "dst", "var"], "left_anti")
    return rows.select(*group, F.col("dst").alias("node"), *keep).distinct()


def taint(edges: DataFrame, sources: DataFrame, assigns: DataFrame, kills: DataFrame, group: list[str] = (), guards: DataFrame | None = None) -> DataFrame:
    """group, node, var, origin: variables that may be tainted when a node ends, and from where.

    edges (src, dst); sources (node, var, origin) taint a variable at a node; assigns (node,
    target, value) pass taint on; kills (node, var) clean a variable, assigned targets are
    cleaned unless their value is tainted. guards (src, dst, var) clean a variable along an
    edge. Sets only grow, and each round joins what is
    new, so schedules don't matter.
    """
    group = list(group)
    key = [*group, "node", "var", "origin"]
    cleaned = kills.select(*group, "node", "var").union(assigns.select(*group, "node", F.col("target").alias("var"))).distinct()
    moves = assigns.select(*group, "node", F.col("target"), F.col("value").alias("var"))
    known = new = storage.save(sources.select(*key).distinct(), "taint")
    while True:
        entered = _entered(new, edges, guards, group, ["var", "origin"])
        kept = entered.join(cleaned, [*group, "node", "var"], "left_anti").select(*key)
        passed = entered.join(moves, [*group, "node", "var"]).select(*group, "node", F.col("target").alias("var"), "origin")
        new = storage.save(kept.union(passed).distinct().join(known, key, "left_anti"), "taint")
        if not new.limit(1).count():
            return known
        known = storage.save(known.unionByName(new), "taint")


def sink_findings(tainted: DataFrame, edges: DataFrame, sinks: DataFrame, group: list[str] = (), guards: DataFrame | None = None) -> DataFrame:
    """group, node, sink, var, origin where a variable is tainted when a node with a sink (node, sink, var) begins."""
    group = list(group)
    entry = _entered(tainted, edges, guards, group, ["var", "origin"])
    return entry.join(sinks, [*group, "node", "var"]).select(*group, "node", "sink", "var", "origin")


def _fact_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row a key: the worse state, the better path, the sinks that all ways are safe for, and whether that differs from the row known before."""
    best = F.min(F.struct(F.size("path").alias("steps"), "path"))["path"].alias("path")
    before = F.max(F.when(F.col("_known"), F.struct("state", "path", "safe"))).alias("_before")
    found = rows.groupBy(*group, "node", "var", "origin").agg(F.max("state").alias("state"), best, F.bit_and("safe").alias("safe"), before)
    return found.withColumn("changed", ~F.col("_before").eqNullSafe(F.struct("state", "path", "safe"))).drop("_before")


def _done_by_nodes(cleaned: DataFrame, assigns: DataFrame, cleaners: DataFrame | None, sinks: list[str], group: list[str]) -> DataFrame:
    """group, node, var, made (sinks that var becomes safe for), cleaned, moves (targets that get its value)."""
    key = [*group, "node", "var"]
    row = lambda df, made, is_clean, target: df.select(*key, made.cast("long").alias("made"), F.lit(is_clean).alias("cleaned"), target.alias("move"))
    to = F.struct("target")
    none = F.lit(None).cast(f"struct<target:{assigns.schema['target'].dataType.simpleString()}>")
    rows = row(cleaned, F.lit(0), True, none).union(row(assigns.select(*group, "node", "target", F.col("value").alias("var")), F.lit(0), False, to))
    if cleaners is not None:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(F.array(*(F.lit(s) for s in sinks)), F.col("sink")) - 1).cast("int"))
        rows = rows.union(row(cleaners.where(F.col("sink").isin(*sinks)), bit, False, none))
    found = rows.where("var IS NOT NULL").groupBy(*key).agg(F.bit_or("made").alias("made"), F.max("cleaned").alias("cleaned"), F.collect_set("move").alias("moves"))
    return storage.save(found, "does")


#: Facts that are broadcast to the edges; a row has a path.
FEW_FACTS = 20_000

#: States of a variable in the order in which they outweigh each other.
TAINTED, UNKNOWN = 1, 2
#: Origin of a variable that some way to a node leaves without a value.
UNBOUND = "unbound"


def _unbound(edges: DataFrame, binds: DataFrame, entries: DataFrame, group: list[str]) -> DataFrame:
    """group, node, var where, of the reached nodes before a node, some end with the variable bound and some without."""
    bound = distances(binds.select(*group, "var", "node"), edges.select("src", "dst"), [*group, "var"]).select("var", F.col("node").alias("src"), F.lit(1).alias("bound"))
    reached = distances(entries.select("node"), edges.select("src", "dst")).select(F.col("node").alias("src"))
    before = edges.select(*group, "src", "dst").distinct().join(reached, "src")
    many = before.groupBy("dst").agg(F.count("*").alias("ways"))
    some = before.join(bound, "src").groupBy(*group, "dst", "var").agg(F.count("*").alias("bound"))
    return some.join(many, "dst").where("bound < ways").select(*group, F.col("dst").alias("node"), "var")


def taint_paths(edges: DataFrame, sources: DataFrame, assigns: DataFrame, kills: DataFrame, sinks: list[str], cleaners: DataFrame | None = None, guards: DataFrame | None = None, entries: DataFrame | None = None, group: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Two tables of facts, where nodes end and where they begin: group, node, var, origin, state, path, safe.

    As taint(), with what is known of a variable and an origin kept as one fact: its state is
    1 (tainted) or 2 (unknown), the worst of all ways to the node; path (kind, node) has the
    source and the assignments it came by, the shortest of them, of several the smallest;
    safe is a bit mask of sinks, those that every way has been cleaned for. cleaners (node,
    var, sink) clean a variable for one sink from that node on. sources may have a column
    state (tainted unless given). With entries (node) a variable that has a value on some
    ways to a node but not on all may be anything there: it gets the origin "unbound" and
    the state unknown.

    A fact changes a few times at most (states and masks only grow worse, paths only better),
    and each round derives anew only from facts that changed; nodes are global, group says
    which graph they are in. origin is a string; a null one counts for nothing.
    """
    group, key = list(group), [*group, "node", "var", "origin"]
    if len(sinks) > 62:
        raise ValueError("62 sinks at most")
    edges = storage.save(edges.select(*group, "src", "dst").distinct(), "flow")
    step = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.col("node").cast("long").alias("node")))
    state = F.coalesce("state", F.lit(TAINTED)) if "state" in sources.columns else F.lit(TAINTED)
    facts = sources.where("origin IS NOT NULL AND var IS NOT NULL").select(*group, "node", "var", F.col("origin").cast("string").alias("origin"), state.cast("int").alias("state"), step("source").alias("path"), F.lit(0).cast("long").alias("safe"))
    cleaned = kills.select(*group, "node", "var").union(assigns.select(*group, "node", F.col("target").alias("var"))).distinct()
    does = _done_by_nodes(cleaned, assigns, cleaners, sinks, group)

    def left(entered: DataFrame) -> DataFrame:
        """What entered facts become where their nodes end."""
        found = entered.join(does.hint("merge"), [*group, "node", "var"], "left").withColumn("safe", F.col("safe").bitwiseOR(F.coalesce("made", F.lit(0))))
        one = lambda var, moved: F.struct(var.alias("_var"), F.lit(moved).alias("_moved"))
        passed = F.coalesce(F.transform("moves", lambda m: one(m["target"], True)), F.array())
        kept = F.when(~F.coalesce("cleaned", F.lit(False)), F.array(one(F.col("var"), False))).otherwise(F.array())
        out = found.select(*group, "node", "origin", "state", "path", "safe", F.inline(F.concat(kept, passed)))
        path = F.when(F.col("_moved"), F.concat("path", step("assignment"))).otherwise(F.col("path"))
        return out.select(*group, "node", F.col("_var").alias("var"), "origin", "state", path.alias("path"), "safe")

    start = None
    if entries is not None:
        binds = sources.select(*group, "node", "var").union(cleaned.select(*group, "node", "var")).distinct()
        start = _unbound(edges, binds, entries, group).select(*group, "node", "var", F.lit(UNBOUND).alias("origin"), F.lit(UNKNOWN).alias("state"), step("unbound").alias("path"), F.lit(0).cast("long").alias("safe"))
        start = storage.save(start, "unbound")
        facts = facts.union(left(start))
    fact = ["state", "path", "safe"]
    known = storage.save(_fact_rows(facts.withColumn("_known", F.lit(False)), group), "facts")
    while True:
        new = known.where("changed").select(*key, *fact)
        if not new.limit(1).count():
            break
        arrived = left(_entering(storage.broadcast_if_small(new, FEW_FACTS), edges, guards, group))
        grown = known.select(*key, *fact, F.lit(True).alias("_known")).unionByName(arrived.withColumn("_known", F.lit(False)))
        grown = storage.save(_fact_rows(grown, group), "facts")
        storage.drop(known)
        known = grown
    known = known.select(*key, *fact)
    begins = _entering(known, edges, guards, group)
    begins = begins if start is None else begins.union(start)
    return known, storage.save(_fact_rows(begins.withColumn("_known", F.lit(False)), group).drop("changed"), "begins")


def _entering(facts: DataFrame, edges: DataFrame, guards: DataFrame | None, group: list[str]) -> DataFrame:
    """What enters the nodes after those where facts hold.

    Joins are sorted merges: by the few bytes of its file a written table of millions of
    short rows would be broadcast, and held by the driver.
    """
    rows = facts.withColumnRenamed("node", "src").join(edges.hint("merge"), [*group, "src"])
    if guards is not None:
        rows = rows.join(guards.select(*group, "src", "dst", "var").hint("merge"), [*group, "src", "dst", "var"], "left_anti")
    return rows.select(*group, F.col("dst").alias("node"), "var", "origin", "state", "path", "safe")


def path_findings(begins: DataFrame, uses: DataFrame, sinks: list[str], group: list[str] = ()) -> DataFrame:
    """group, node, sink, var, origin, state, path of facts that reach a sink (node, sink, var) that they aren't safe for.

    begins is the second table of taint_paths(), which was given the same sinks. Sinks of
    another kind are safe for nothing.
    """
    position = F.array_position(F.array(*(F.lit(s) for s in sinks)), F.col("sink"))
    is_safe = (position > 0) & (F.call_function("shiftright", F.col("safe"), F.greatest(position - 1, F.lit(0)).cast("int")).bitwiseAND(1) == 1)
    found = begins.join(uses.select(*group, "node", "sink", "var").distinct().hint("merge"), [*group, "node", "var"]).where(~is_safe)
    return found.select(*group, "node", "sink", "var", "origin", "state", "path")


def risk(text: str = "text") -> Column:
    """What kind of statement a string starts or contains, for the risk of what is put into it."""
    t = F.lower(F.col(text))
    cases = {"schema": r"\b(drop|alter|create)\s+table\b", "write": r"\b(insert\s+into|update\s+\w+\s+set|delete\s+from)\b", "read": r"\bselect\b.*\bfrom\b"}
    out = F.when(F.lit(False), "")
    for kind, pattern in cases.items():
        out = out.when(t.rlike(pattern), kind)
    return out.otherwise("unknown")


def affected(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """node, distance of what a change reaches against the edges of either snapshot."""
    both = before.select("src", "dst").union(after.select("src", "dst")).distinct()
    return distances(changed.select("node"), both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def assignable(pairs: DataFrame, types: DataFrame, supertypes: DataFrame) -> DataFrame:
    """source, target, assignable (null if a type is unknown): target is among the source's supertypes.

    types: name; supertypes: name, super. Names compare without case.
    """
    known = types.select(F.lower("name").alias("name")).distinct()
    up = supertypes.select(F.lower("name").alias("src"), F.lower("super").alias("dst"))
    asked = pairs.select(F.lower("source").alias("root")).distinct()
    reach = distances(asked.select("root", F.col("root").alias("node")), up, ["root"]).select(F.col("root").alias("s"), F.col("node").alias("t"), F.lit(True).alias("ok"))
    out = pairs.withColumn("s", F.lower("source")).withColumn("t", F.lower("target")).join(reach, ["s", "t"], "left")
    for side in ("s", "t"):
        out = out.join(known.select(F.col("name").alias(side), F.lit(True).alias(f"k{side}")), side, "left")
    return out.select("source", "target", F.when(F.col("ks") & F.col("kt"), F.coalesce("ok", F.lit(False))).alias("assignable"))
