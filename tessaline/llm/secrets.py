"""Secret scans: candidates in texts, judged by how many owners hold the same value.

A value that many owners hold is a copied example; one that a single owner holds looks
live. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline import storage

#: Kinds in the order in which spans of one start are listed: pattern, group that must be
#: long, least length. The shorter forms of access and hex find the same spans as a run
#: of any length whose short ones are dropped, since a run is taken whole.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Long mixed strings that no base kind covers; they count as spans only if they look live.
OPAQUE = r"[A-Za-z0-9_-]{24,}"
#: A value held by more owners or more repositories than this is a copied example.
MAX_OWNERS = 3
MAX_REPOS = 6


def _matches(text: Column, kind: str, order: int, pattern: str, group: int) -> Column:
    """A struct of a kind's matches: the lengths of what lies before each, the whole and the value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    before = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("kind_no"), F.arrays_zip(before.alias("before"), hits.alias("hit"), value.alias("value")).alias("found")))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """A row per candidate: row_no, the columns of docs but the text, kind, kind_no, start, end, value.

    A row of docs without one gives a row with null kind. Starts are running sums of the
    lengths between and of the matches, over the few short rows of one text.
    """
    kept = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    specs = [(k, p, g) for k, (p, g, _) in BASE.items()] + [("live", OPAQUE, 0)]
    kinds = F.array(*(_matches(body, k, n, p, g) for n, (k, p, g) in enumerate(specs)))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), *kept, F.filter(kinds, lambda k: k.isNotNull()).alias("kinds"))
    rows = rows.select("row_no", *kept, F.explode_outer("kinds").alias("k")).select("row_no", *kept, "k.kind", "k.kind_no", F.posexplode_outer("k.found").alias("pos", "f"))
    size = F.length("f.hit")
    upto = Window.partitionBy("row_no", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("f.before") + F.coalesce(size, F.lit(0))).over(upto)
    rows = rows.repartition("row_no").select("row_no", *kept, "kind", "kind_no", (end - size).alias("start"), end.alias("end"), F.col("f.value").alias("value"), "pos")
    long_enough = F.lit(False)
    for kind, (_, _, least) in BASE.items():
        long_enough |= (F.col("kind") == kind) & (F.length("value") >= least)
    mixed = (F.col("kind") == "live") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    holds = F.coalesce(F.col("end").isNotNull() & (long_enough | mixed), F.lit(False))
    return rows.select("row_no", *kept, *(F.when(holds, F.col(c)).alias(c) for c in ("kind", "kind_no", "start", "end", "value")))


def ownership(found: DataFrame) -> DataFrame:
    """digest, n_repos, n_owners of each value of (digest, repo, owner).

    Repeats within an owner's repository go first, before the shuffle by value; so a value
    that a third of all rows hold brings one row per repository and task.
    """
    pairs = found.groupBy("digest", "repo", "owner").agg(F.lit(1).alias("one"))
    repos = pairs.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_repos"))
    owners = pairs.groupBy("digest", "owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "digest")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: list[str] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of docs: counts of base kinds, digest of base spans, all spans, ownership.

    Base spans always stay. A long mixed string that overlaps none of them is added when at
    most max_owners owners and max_repos repositories hold it. n_live and n_copied count the
    distinct values of each verdict, most_repos is the largest number of repositories that
    hold one of the row's spans, 0 without spans. A null text is empty; a null owner or
    repository counts as one of its own. Repeated ids and rows each give a row. Other
    columns of docs are not read. An empty table gives no rows.
    """
    parts = F.to_json(F.array(*(F.col(c).cast("string") for c in repo)))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"), parts.alias("repo"), F.col(text).alias("text"))
    found = storage.save(candidates(narrow, "text").withColumn("digest", F.sha2("value", 256)).drop("value"), "secrets")
    owned = storage.save(ownership(found.where("digest is not null").select("digest", "repo", "owner")), "owners")
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    judged = found.join(storage.broadcast_if_small(owned.select("digest", "n_repos", copied.alias("copied"))), "digest", "left")
    span = F.struct("start", "kind_no", "end", "kind", F.coalesce("copied", F.lit(False)).alias("copied"), "digest", "n_repos")
    rows = judged.groupBy("row_no", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["kind"] != "live"))
    free = F.filter("all", lambda s: (s["kind"] == "live") & ~s["copied"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("spans", F.sort_array(F.concat("base", free)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    values = lambda copied: F.size(F.array_distinct(F.transform(F.filter("spans", lambda s: s["copied"] == copied), lambda s: s["digest"]))).cast("long")
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        values(False).alias("n_live"),
        values(True).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repos"])), F.lit(0)).cast("long").alias("most_repos"),
    )
