import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm import lines, simhash


def documents(spark):
    g = random.Random(3)
    words = ["".join(g.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    line = lambda: [g.choice(words) for _ in range(20)]
    base = [line() for _ in range(30)]
    texts = ["\n".join(" ".join(x) for x in g.sample(base, 3)) for _ in range(40)] + [" ".join(x[:-1] + ["other"]) for x in base]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_stages_leave_only_the_table_that_their_result_reads(spark):
    for stage, label in ((lines.report, "dropped"), (lines.dedup, "dropped"), (simhash.keep_one, "keep")):
        before = set(storage._saved)
        found = stage(documents(spark))
        left = [path for path in storage._saved if path not in before]
        assert len(left) == 1 and f"tessaline-{label}-" in left[0], stage
        assert found.count() > 0


def test_only_rows_that_pairs_name_are_joined(spark):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("line"))
    pairs = spark.createDataFrame([(1, 2), (2, 7), (1, 2)], "a long, b long")
    assert sorted(r.id for r in lines._of(rows, pairs).collect()) == [1, 2, 7]


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {path.name for folder in disk.localDirs() for path in Path(folder.getPath()).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    setting, before = spark.conf.get(storage.CLEANUP), shuffle_files(spark)
    saved = storage.save(spark.range(0, 100_000, 1, 4).groupBy(F.xxhash64("id").alias("h")).agg(F.max("id").alias("m")), "sums")
    deadline = time.monotonic() + 10  # executors are told, and not waited for
    while (left := shuffle_files(spark) - before) and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(storage.CLEANUP) == setting and saved.count() == 100_000


def test_bitmaps_shuffle_a_row_for_each_text(spark):
    texts = spark.createDataFrame([(i, f"line {i} of some text") for i in range(20)], "id long, line string")
    plan = lines._bitmaps(lines._places(texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_are_fetched_of_pairs_whose_marks_agree(spark, monkeypatch):
    fetched = []
    monkeypatch.setattr(lines, "_texts", lambda ids, *more, real=lines._texts: fetched.append(ids.count()) or real(ids, *more))
    texts = ["one line that has a near copy, here", "one line that has a near copy, there", "quite another line", "and one without copies"]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, line string")
    # two buckets of two; only the first one's marks agree
    signed = found.select(F.xxhash64("line").alias("id"), F.array(F.floor(F.col("doc_id") / 2)).alias("bands"), F.greatest("doc_id", F.lit(1)).alias("mark"))
    edges = lines.similar(signed, found, 0.7, lines.Judged(agree=lambda a, b: a == b))
    assert fetched == [2] and edges.where("a <> b").count() > 0


def test_later_levels_keep_only_what_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(lines, "ALL_PAIRS", 4)
    seen = []
    monkeypatch.setattr(lines, "_plausible", lambda pairs, marks, worth, real=lines._plausible: seen.append(marks.count()) or real(pairs, marks, worth))
    g = random.Random(8)
    letters = lambda n: "".join(g.choice("abcdefghijklmnop") for _ in range(n))
    texts = [letters(60) for _ in range(60)] + [f"{opening}{letters(30)}" for opening in [letters(50)] for _ in range(6)]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, line string")
    # pairs of the first sixty meet in a bucket each, the last six in one that is large
    band = F.when(F.col("doc_id") < 60, F.floor(F.col("doc_id") / 2)).otherwise(-1)
    lines.similar(found.select(F.xxhash64("line").alias("id"), F.array(band).alias("bands")), found)
    assert seen[0] == 66 and len(seen) > 1 and set(seen[1:]) == {6}
