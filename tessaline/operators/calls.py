"""Call sites and symbols: filters, searches, hierarchies and dependency edges.

Names compare without case. Call sites have caller_name, caller_qualified, caller_module,
base_name, member and text; symbols name, qualified, module and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.functions.scalars import last_name_part
from tessaline.operators.graph import distances
from tessaline.operators.rollup import with_evidence


def _same(column: str, value: str) -> Column:
    return F.coalesce(F.lower(column) == value.lower(), F.lit(False))


def calls_from(calls: DataFrame, name: str) -> DataFrame:
    """Calls whose caller's name, qualified name or module it is; a call without a caller is none."""
    return calls.where(_same("caller_name", name) | _same("caller_qualified", name) | _same("caller_module", name))


def calls_to(calls: DataFrame, name: str) -> DataFrame:
    """Calls whose base name, member or text it is."""
    return calls.where(_same("base_name", name) | _same("member", name) | _same("text", name))


def query_calls(calls: DataFrame, base_name: str, caller_kind: str | None = None, text: str | None = None) -> DataFrame:
    """Calls of a base name, a filter that reaches the scan, and what else is asked for."""
    found = calls.where(F.lower("base_name") == base_name.lower())
    if caller_kind:
        found = found.where(_same("caller_kind", caller_kind))
    return found.where(F.lower("text").contains(text.lower())) if text else found


def search(symbols: DataFrame, value: str, how: str) -> DataFrame:
    """Symbols by exact name, prefix, contains, qualified name, module or kind."""
    v = value.lower()
    conditions = {"exact": F.lower("name") == v, "prefix": F.lower("name").startswith(v), "contains": F.lower("name").contains(v)}
    conditions |= {c: F.lower(c) == v for c in ("qualified", "module", "kind") if c in symbols.columns}
    return symbols.where(conditions[how])


def visible_symbols(symbols: DataFrame, private: bool = True, labels: bool = False, module: str | None = None) -> DataFrame:
    """Symbols without private ones or labels unless asked for, of a module if named."""
    keep = F.lit(True)
    if not private:
        keep &= F.lower(F.coalesce("visibility", F.lit(""))) != "private"
    if not labels:
        keep &= F.lower("kind") != "label"
    return symbols.where(keep & _same("module", module) if module else keep)


def bound(candidates: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """candidates with the node of their composite key, and whether the key is shared by several."""
    known = nodes.groupBy(*key).agg(F.min("node").alias("node"), (F.count("*") > 1).alias("shared"))
    return candidates.join(known, key, "left")


def hierarchy(calls: DataFrame, key: str, other: str, place: list[str]) -> DataFrame:
    """key, other and the sorted places of the calls between them."""
    return with_evidence(calls, [key, other], place)


def dependencies(calls: DataFrame, references: DataFrame, module: str | None = None) -> DataFrame:
    """kind, src, dst, evidence of procedure, module and type edges.

    calls: src, dst, src_module, dst_module, line; references: src_module, type_name, line.
    Module edges leave out calls within a module. With a module only its outgoing edges stay.
    """
    rows = calls.select(F.lit("procedure").alias("kind"), "src", "dst", "src_module", "line")
    rows = rows.unionByName(calls.where("src_module <> dst_module").select(F.lit("module").alias("kind"), F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), "src_module", "line"))
    rows = rows.unionByName(references.select(F.lit("type").alias("kind"), F.col("src_module").alias("src"), F.col("type_name").alias("dst"), "src_module", "line"))
    return with_evidence(rows.where(_same("src_module", module)) if module else rows, ["kind", "src", "dst"], ["line"])


def roots(symbols: DataFrame, entries: list[str]) -> DataFrame:
    """name, reason, confidence of where execution can start, strongest reason first.

    Named entries, tests and event handlers are confirmed; public macros are confirmed;
    other public procedures are possible.
    """
    name = F.lower(last_name_part(F.col("name")))
    reason = F.when(name.isin([e.lower() for e in entries]), "entry").when(name.startswith("test"), "test").when(name.rlike("_(open|click|change|initialize)$"), "event")
    reason = reason.when((F.lower("visibility") == "public") & (F.lower("kind") == "sub"), "public_macro").when(F.lower("visibility") == "public", "public_api")
    return symbols.select("name", reason.alias("reason")).where("reason is not null").withColumn("confidence", F.when(F.col("reason") == "public_api", "possible").otherwise("confirmed"))


def handler_roots(symbols: DataFrame, fields: DataFrame, reason: str) -> DataFrame:
    """module, name, reason, confidence of the procedures named after a field of their module and an event: "field_event".

    symbols (module, name), fields (module, field): fields declared with events, or controls
    of a form. Names compare without case and may have underscores themselves, so every
    beginning of a name that ends before an underscore is looked up. All are confirmed;
    several fields that fit give one row; nulls fit nothing.
    """
    parts = F.split(F.lower(last_name_part(F.col("name"))), "_")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    rows = symbols.where("name LIKE '%\\_%'").select("module", "name", F.explode(begins).alias("_field"), F.lower("module").alias("_module"))
    known = fields.where("trim(field) <> ''").select(F.lower("module").alias("_module"), F.lower("field").alias("_field")).distinct()
    found = rows.join(known, ["_module", "_field"], "left_semi").select("module", "name").distinct()
    return found.select("module", "name", F.lit(reason).alias("reason"), F.lit("confirmed").alias("confidence"))


def uncertainty(calls: DataFrame, visited: DataFrame) -> DataFrame:
    """Counts of ambiguous, unresolved and dynamic calls made by the visited nodes."""
    own = calls.join(visited.select(F.col("node").alias("src")), "src", "left_semi")
    return own.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ambiguous", "unresolved", "dynamic")))


def state_access(accesses: DataFrame, field: list[str]) -> DataFrame:
    """Per field: sorted readers, writers and mutators; a read-write access is all three."""
    who = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("procedure"))))
    return accesses.groupBy(*field).agg(who("read", "readwrite").alias("readers"), who("write", "readwrite").alias("writers"), who("mutate", "readwrite").alias("mutators"))


def state_roots(accesses: DataFrame, edges: DataFrame, roots: DataFrame, components: DataFrame, field: list[str]) -> DataFrame:
    """field, kind, root: which roots (root, node) reach a procedure that accesses a field, and cyclic: whether one that does is in a circle of calls.

    accesses has the field's columns, procedure (a node) and kind; components is
    strong_components(). A field that no root reaches has no row; repeats count once.
    """
    reached = distances(roots.select("root", "node"), edges, ["root"]).select("root", F.col("node").alias("procedure"))
    circles = components.select(F.col("node").alias("procedure"), "cyclic")
    rows = accesses.select(*field, "procedure", "kind").distinct().join(circles, "procedure", "left").join(reached, "procedure")
    return rows.groupBy(*field, "kind", "root").agg(F.coalesce(F.max("cyclic"), F.lit(False)).alias("cyclic"))
