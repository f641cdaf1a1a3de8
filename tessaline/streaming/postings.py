"""An index of postings that is replaced key by key, a few buckets at a time.

Keys are dealt to a fixed number of buckets by hash. A batch writes new versions of the
buckets of its keys, and a manifest that names the version of every bucket; that manifest
is complete in one step or not there at all. Batches are numbered, so one that runs again
after a failure finds itself applied, or writes the same folder anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Buckets of a new index; a batch of k keys rewrites k of them at most.
BUCKETS = 256


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, pattern: str) -> list[str]:
    files, target = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(target) or [])


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def manifests(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose manifests are complete, in order."""
    return sorted(int(n.rsplit("/", 2)[1].removeprefix("m")) for n in _names(spark, f"{path}/manifest/m*/_SUCCESS"))


def _manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """Bucket to version, a row for each bucket that was ever written: at most as many as there are buckets."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long, buckets int").json(f"{path}/manifest/m{batch:019d}").collect() if r.bucket >= 0}


def _buckets(spark: SparkSession, path: str, given: int) -> int:
    done = manifests(spark, path)
    return spark.read.schema("buckets int").json(f"{path}/manifest/m{done[-1]:019d}").first()[0] if done else given


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{path}/data/v{v:019d}/bucket={b}" for b, v in versions.items()]
    return spark.read.parquet(*paths) if paths else None


def replace(batch: DataFrame, number: int, path: str, key: list[str], generation: str, removed: str, buckets: int = BUCKETS) -> int:
    """Puts the postings of the keys of a batch in the place of those that path has for them; returns the buckets written.

    A batch has any number of rows for a key; those of its highest generation replace all
    rows of the key if their generation is higher than, or the same as, what is there. If
    the column removed is true for one of them the key has no postings any more; its
    generation stays known, so an older one doesn't bring it back. Batches are numbered
    upwards; one that is not above the last is taken as done before. Null keys are a key.
    Every other bucket keeps its files, and what the last manifest but one doesn't name is
    deleted.
    """
    spark, done = batch.sparkSession, manifests(batch.sparkSession, path)
    if done and number <= done[-1]:
        return 0
    buckets = _buckets(spark, path, buckets)
    rows = batch.withColumn("bucket", _bucket(key, buckets))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]
    if not touched:
        return 0
    now = _manifest(spark, path, done[-1]) if done else {}
    old = _stored(spark, path, {b: v for b, v in now.items() if b in set(touched)})
    both = rows.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("bucket", _bucket(key, buckets)).withColumn("_new", F.lit(0)))
    same = F.struct(*key)
    newest = both.groupBy(same.alias("_key")).agg(F.max(F.struct(generation, "_new")).alias("_top"), F.max(F.struct(generation, "_new", F.coalesce(removed, F.lit(False)).alias("gone")))["gone"].alias("_gone"))
    kept = both.withColumn("_key", same).join(newest, "_key").where(F.struct(generation, "_new").eqNullSafe(F.col("_top")))
    live = kept.where("NOT _gone").select(*batch.columns, "bucket")
    graves = kept.where("_gone").dropDuplicates(["_key"]).withColumn(removed, F.lit(True)).select(*batch.columns, "bucket")
    live.union(graves).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v{number:019d}")
    after = now | {b: number for b in touched}
    table = spark.createDataFrame([(b, v, buckets) for b, v in sorted(after.items())], "bucket int, version long, buckets int")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/m{number:019d}")
    _prune(spark, path, {*now.items(), *after.items()}, done[-1:] + [number])
    return len(touched)


def _prune(spark: SparkSession, path: str, named: set[tuple[int, int]], kept: list[int]) -> None:
    """Deletes what neither the last manifest nor the one before it names; readers that opened that one go on."""
    keep = {f"v{v:019d}/bucket={b}" for b, v in named}
    for name in _names(spark, f"{path}/data/v*/bucket=*"):
        if "/".join(name.rsplit("/", 2)[1:]) not in keep:
            _delete(spark, name)
    for name in _names(spark, f"{path}/data/v*"):
        if not _names(spark, f"{name}/bucket=*"):
            _delete(spark, name)
    for name in _names(spark, f"{path}/manifest/m*"):
        if int(name.rsplit("/", 1)[1].removeprefix("m")) not in kept:
            _delete(spark, name)


def current(spark: SparkSession, path: str, removed: str) -> DataFrame | None:
    """All postings at path; None before the first batch."""
    done = manifests(spark, path)
    found = _stored(spark, path, _manifest(spark, path, done[-1])) if done else None
    return found if found is None else found.where(~F.coalesce(removed, F.lit(False)))


def lookup(keys: DataFrame, path: str, key: list[str], removed: str) -> DataFrame | None:
    """The postings of a few keys; only their buckets are read."""
    spark, done = keys.sparkSession, manifests(keys.sparkSession, path)
    if not done:
        return None
    asked = {r[0] for r in keys.select(_bucket(key, _buckets(spark, path, BUCKETS))).distinct().collect()}
    found = _stored(spark, path, {b: v for b, v in _manifest(spark, path, done[-1]).items() if b in asked})
    return found if found is None else found.join(keys.select(*key).distinct(), key, "left_semi").where(~F.coalesce(removed, F.lit(False)))


def replace_stream(stream: DataFrame, path: str, key: list[str], generation: str, removed: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Each micro-batch replaces the postings of its keys; its number is the micro-batch's."""
    return stream.writeStream.foreachBatch(lambda batch, number: replace(batch, number, path, key, generation, removed, buckets))
