"""Postings replaced by bucket, changes that settle, and lines cut across chunks."""

import json
import os
import random
import time

from tessaline.streaming import postings, timers

rng = random.Random(41)
POSTING = "path string, generation long, removed boolean, name string"


def held(spark, out):
    return sorted((r.path, r.generation, r.name) for r in postings.current(spark, out, "removed").collect())


def test_a_batch_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    out, model = f"file://{tmp_path}/index", {}
    for number in range(7):
        keys = [f"f{rng.randrange(60)}" for _ in range(3 if number else 60)] if number else [f"f{k}" for k in range(60)]
        rows = []
        for k in set(keys):
            generation = rng.choice([number, number, number - 2])
            gone = number > 1 and rng.random() < 0.3
            own = [(k, generation, gone, None if gone else f"{k}-{number}-{i}") for i in range(1 if gone else rng.randrange(1, 4))]
            rows += own
            if k not in model or generation >= model[k][0]:
                model[k] = (generation, [] if gone else [x[3] for x in own])
        before = {d: os.stat(f"{tmp_path}/index/data/{d}").st_mtime_ns for d in os.listdir(f"{tmp_path}/index/data")} if number else {}
        batch = spark.createDataFrame(rows, POSTING).repartition(3)
        written = postings.replace(batch, number, out, ["path"], "generation", "removed", buckets=32)
        assert written <= len(set(keys)) and (number == 0 or written <= 3)
        new = f"{tmp_path}/index/data/v{number:019d}"
        assert len([d for d in os.listdir(new) if d.startswith("bucket=")]) == written and before is not None
        assert held(spark, out) == sorted((k, g, n) for k, (g, names) in model.items() for n in names)
        assert postings.replace(batch, number, out, ["path"], "generation", "removed", buckets=32) == 0  # again, after a failure
        assert len(postings.manifests(spark, out)) <= 2
    files = sum(name.startswith("bucket=") for d in os.listdir(f"{tmp_path}/index/data") for name in os.listdir(f"{tmp_path}/index/data/{d}"))
    assert files <= 32 + 3  # each bucket's last version, and those that the manifest before names
    found = postings.lookup(spark.createDataFrame([("f1",), ("f2",), ("nowhere",)], "path string"), out, ["path"], "removed")
    assert sorted(r.name for r in found.collect()) == sorted(n for k in ("f1", "f2") for n in model[k][1])


def test_half_written_batches_are_not_seen(spark, tmp_path):
    out = f"file://{tmp_path}/index"
    assert postings.current(spark, out, "removed") is None
    postings.replace(spark.createDataFrame([("a", 1, False, "x")], POSTING), 0, out, ["path"], "generation", "removed")
    half = spark.createDataFrame([("a", 2, False, "y")], POSTING)
    half.write.parquet(f"{out}/data/v{1:019d}/bucket=0")
    half.write.json(f"{out}/manifest/m{1:019d}")
    os.remove(f"{tmp_path}/index/manifest/m{1:019d}/_SUCCESS")
    assert held(spark, out) == [("a", 1, "x")]
    postings.replace(half, 1, out, ["path"], "generation", "removed")
    assert held(spark, out) == [("a", 2, "y")]
    assert postings.replace(half.limit(0), 2, out, ["path"], "generation", "removed") == 0


def test_postings_stream(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/table"
    for rows in ([("a", 1, False, "a1"), ("a", 1, False, "a2"), ("b", 5, False, "b5")], [("a", 2, False, "a3"), ("b", 4, False, "old")], [("b", 6, True, None)]):
        spark.createDataFrame(rows, POSTING).coalesce(1).write.mode("append").json(str(source))
        q = postings.replace_stream(spark.readStream.schema(POSTING).json(str(source)), out, ["path"], "generation", "removed", 4).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert held(spark, out) == [("a", 2, "a3")]


def test_changes_go_out_when_nothing_newer_comes(spark, tmp_path):
    source, got = tmp_path / "in", []
    os.makedirs(source)

    def put(n, *rows):
        with open(tmp_path / f"{n}.tmp", "w") as f:
            f.writelines(json.dumps(dict(zip(("uri", "version", "text", "delay"), r, strict=True))) + "\n" for r in rows)
        os.rename(tmp_path / f"{n}.tmp", source / f"{n}.json")

    def until(n, seconds):
        end = time.time() + seconds
        while len(got) < n and time.time() < end:
            time.sleep(0.2)
        return len(got) >= n

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema("uri string, version long, text string, delay long").json(str(source))
    out = timers.debounced(stream, "uri", "version", "text", "delay")
    q = out.writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend((r.key, r.generation, r.document, time.time()) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        began = time.time()
        put(1, ("a", 1, "one", 300), ("a", 2, "two", 300), ("b", 1, "first", 15_000))
        assert until(1, 60) and got[0][:3] == ("a", 2, "two")  # one change goes out for both
        put(2, ("b", 2, "second", 300), ("b", 1, "late", 300), ("a", 1, "old", 300), ("a", 2, "two", 300))
        assert until(2, 60) and got[1][:3] == ("b", 2, "second") and got[1][3] > began  # the newer one took the first one's place
        put(3, ("a", 3, None, 300))
        assert until(3, 60) and got[2][:3] == ("a", 3, None)
        time.sleep(4)
        assert len(got) == 3  # what was late or superseded never goes out
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_lines_cut_across_chunks_and_batches(spark, tmp_path):
    source, seen = tmp_path / "in", {}
    lines = [json.dumps({"n": k, "text": "é東" * rng.randrange(6)}, ensure_ascii=False) for k in range(300)]
    data = "\n".join([*lines[:100], "{broken", "", "[1]", *lines[100:]]).encode()
    cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(120))})
    pieces = [("s", k, data[a:b], False) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("s", 9999, None, True), ("t", 1, b'{"a": 1}', False), ("big", 1, b"x" * 5000, False), ("big", 2, b'\n{"a": 1}\n', True)]
    for part in (pieces[:40], pieces[40:41], pieces[41:]):
        spark.createDataFrame(part, "k string, seq long, chunk binary, last boolean").repartition(3).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k string, seq long, chunk binary, last boolean").parquet(str(source))
        out = timers.event_lines(stream, "k", "seq", "chunk", "last", most=4000)
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.key: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    s = seen["s"]
    assert (s.total, s.dropped, s.truncated, s.failed) == (300, 2, True, False) and list(s.latest) == lines[-200:]
    assert (seen["t"].total, seen["t"].latest) == (0, []) and seen["big"].failed and seen["big"].total == 0
