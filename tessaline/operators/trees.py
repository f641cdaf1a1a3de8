"""Ancestors in forests by pointer doubling: a round for each doubling of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline import storage


def doubled(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (node, up) of the 1st, 2nd, 4th ... ancestor, and (node, root, depth).

    parents (node, up) has every node; a root is its own parent. A cycle has no root, and
    its nodes and those below it stay out of the second table.
    """
    now = storage.save(parents.select("node", "up", (F.col("node") != F.col("up")).cast("long").alias("steps")), "ancestors")
    tables, most = [now], now.count()
    while 1 << len(tables) - 1 < most:
        higher = now.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"))
        after = storage.save(now.join(higher, "up").select("node", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps")), "ancestors")
        if not after.where(f"steps = {1 << len(tables)}").limit(1).count():
            now = after
            break
        tables.append(after)
        now = after
    roots = parents.where("node = up").select(F.col("node").alias("up"))
    return [t.select("node", "up") for t in tables], storage.save(now.join(roots, "up", "left_semi").select("node", F.col("up").alias("root"), F.col("steps").alias("depth")), "depths")
