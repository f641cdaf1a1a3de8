import random

import brute
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm import lines


def letters(g, n):
    return "".join(g.choice("abcdefghijklmnop") for _ in range(n))


def test_bitmaps_turn_away_no_similar_pair_and_most_others(spark):
    g = random.Random(5)
    pool = ["", "ab", "abcde", "abcdef"]
    for size in (8, 40, 300, 3000):
        base = letters(g, size)
        for kept in (0.95, 0.9, 0.85, 0.7, 0.5):
            pool += [base[: int(size * kept)] + letters(g, size - int(size * kept)), letters(g, 4) + base[4 : int(size * kept)], base + base[: size // 9]]
    texts = spark.createDataFrame(list(enumerate(pool)), "id long, line string")
    bits = {r.id: r for r in lines._bitmaps(lines._places(texts)).collect()}
    assert set(bits) == set(range(len(pool)))
    both = spark.createDataFrame(list(bits.values()), lines._bitmaps(lines._places(texts)).schema)
    a, b = (both.select(F.col("id").alias(k), F.col("bits").alias(f"{k}_bits")) for k in "ab")
    passed = {(r.a, r.b) for r in a.join(b, F.col("a") < F.col("b")).where(lines._can_be_alike(F.col("a_bits"), F.col("b_bits"), 0.8)).collect()}
    pairs = [(i, j) for j in range(len(pool)) for i in range(j)]
    alike = {(i, j) for i, j in pairs if brute.similar(pool[i], pool[j])}
    assert len(alike) > 50 and alike <= passed and len(passed) < 1.5 * len(alike) + 0.05 * len(pairs)


def test_pairs_of_a_large_group_of_dissimilar_texts_are_no_rows(spark, monkeypatch):
    g = random.Random(17)
    opening = letters(g, 60)
    pool = [opening + letters(g, 40) for _ in range(100)]
    pool += [line[:-1] + "#" for line in pool[:10]]
    rows, save = [], storage.save

    def counted(df, label):
        out = save(df, label)
        rows.append(out.count() if label == "pairs" else 0)
        return out

    monkeypatch.setattr(storage, "save", counted)
    found = spark.createDataFrame([(line,) for line in pool], "line string")
    edges = lines.similar(found.select(F.xxhash64("line").alias("id"), F.array(F.lit(1).cast("long")).alias("bands")), found)
    ids = [r.id for r in found.select("line", F.xxhash64("line").alias("id")).collect()]
    assert {frozenset((r.a, r.b)) for r in edges.collect() if r.a != r.b} >= {frozenset((ids[i], ids[100 + i])) for i in range(10)}
    # the first of the bucket with each other, and the ten similar pairs; all pairs are some 6,000
    assert sum(rows) < 200
