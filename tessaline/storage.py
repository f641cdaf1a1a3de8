"""Written tables that cut lineage, and joins that broadcast only what is small.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``,
which every executor can read. They are plain Parquet, so a lost executor costs a
re-read and nothing is computed twice, as ``DataFrame.checkpoint`` would do.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; a wider row than a few longs needs a lower bound.
BROADCAST_ROWS = 100_000

#: Spark's setting by which the shuffle files of a query go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_saved: list[str] = []
_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; where none is set, a temporary one, and that in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessaline-"))
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, which clear() deletes."""
    _saved.append(f"{scratch_dir(spark).rstrip('/')}/tessaline-{label}-{uuid.uuid4().hex}")
    return _saved[-1]


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files; the session's setting is as before afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the table read back.

    Nothing reads the query's shuffle files once its table is written, so they go with it;
    else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame | None) -> None:
    """Delete a table that save() wrote; nothing may read it afterwards."""
    path = getattr(df, "_scratch_path", None)
    if path in _saved:
        _saved.remove(path)
        _delete(df.sparkSession, path)


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Drops what save() writes inside, except the tables that are put into the list it yields."""
    before, keep = set(_saved), []
    yield keep
    kept = {getattr(df, "_scratch_path", None) for df in keep}
    spark = SparkSession.active()
    for path in [p for p in _saved if p not in before and p not in kept]:
        _saved.remove(path)
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all that save() has written in this process; call it when results are stored."""
    while _saved:
        _delete(spark, _saved.pop())


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows.

    Beyond that the join shuffles, and adaptive execution splits hot keys. df should be a
    written table or cheap, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
