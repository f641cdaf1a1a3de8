import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

from tessaline.llm import lm, mixing

rng = random.Random(6)


def documents(n):
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(20000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 80, 400]))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "É Á A\x00 B\tc"), (n + 3, texts[3]), (n + 3, texts[3]), (None, "w1 w2")]


def test_base_scores_match_brute_force(spark):
    docs = documents(300)
    df = spark.createDataFrame([(*d, 1.5) for d in docs], "doc_id long, text string, score double")
    words = [[*brute.WORDS.findall((t or "").translate(brute.LOWER)), None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    for head in (50, 1 << 18):
        got = sorted(lm.score(df, head=head).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        for r, ws, h, (i, _) in zip(got, words, held, docs, strict=True):
            assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, h, len(ws), n)
            assert r.n_known == sum(counts[w] > 0 for w in ws)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
            assert r.score < 0
    assert lm.score(df.limit(0)).count() == 0


def test_filter_reads_counts_back():
    g = np.random.default_rng(1)
    keys, counts = np.unique(g.integers(0, 1 << 63, 20000).astype(np.uint64)), None
    counts = np.minimum(g.zipf(1.5, len(keys)), 10**9)
    shards = lm._shard(keys)
    blocks = {s: lm.build_shard(keys[shards == s], counts[shards == s]) for s in np.unique(shards)}
    sizes = np.zeros(1 << lm.SHARD_BITS, np.int64)
    sizes[list(blocks)] = [len(b) for b in blocks.values()]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    part = lm.Part(np.concatenate(list(blocks.values())), first, (sizes * 8).astype(np.uint64))
    read = lm.count_of(part.levels(keys).astype(int))
    assert (read >= lm.count_of(lm.level(counts)) - 1e-9).all()
    assert (read == lm.count_of(lm.level(counts))).mean() > 0.9
    unseen = g.integers(0, 1 << 63, 20000).astype(np.uint64) | np.uint64(1 << 63)
    assert (part.levels(np.setdiff1d(unseen, keys)) > 0).mean() < 0.06
    assert (np.abs(lm.count_of(lm.level(counts)) / counts - 1) <= 0.34).all()


def test_scores_match_a_plain_model_and_any_number_of_parts(spark):
    docs = [*documents(120), (9000, "w1 w2 w3 " * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(str, lm.score(df).collect()))
    assert whole == sorted(map(str, lm.score(df.repartition(3), part_bytes=2000).collect()))
    words = [[*brute.WORDS.findall((t or "").translate(brute.LOWER)), None] for _, t in docs]
    train = [ws for ws, (i, _) in zip(words, docs, strict=True) if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    singles = Counter(w for ws in train for w in ws)
    doubles = Counter(p for ws in train for p in zip([None, *ws], ws, strict=False))
    below = sum(singles.values()) + 0.1 * (len(singles) + 1)
    read = lambda c: float(lm.count_of(lm.level(np.array([c])))[0]) if c else 0.0
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(df).collect()}
    for (i, _), ws in zip(docs, words, strict=True):
        want = 0.0
        for a, b in zip([None, *ws], ws, strict=False):
            context = read(singles[a])
            want += math.log10((min(read(doubles[a, b]), context) + 2 * (read(singles[b]) + 0.1) / below) / (context + 2))
        assert abs(got[i, len(ws)] - want) <= 0.05 * abs(want) + 2, i


def test_pairs_predict_held_out_text_better_than_words(spark):
    follow = {i: [rng.randrange(200) for _ in range(2)] for i in range(200)}
    docs = []
    for i in range(400):
        at, out = rng.randrange(200), []
        for _ in range(100):
            out.append(f"t{at}")
            at = rng.choice(follow[at])
        docs.append((i, " ".join(out)))
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert len(rows) > 10 and all(r.score > r.base_score * 0.5 for r in rows)


def shares(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def check_mix(rows, n):
    assert len(rows) == n
    taken, sizes, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    expected = shares(dict(sizes))
    for s in sizes:
        assert math.isclose(target[s], expected[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 1.0 * max(r.size for r in rows if r.source == s))


def test_mix_reaches_targets_and_reruns_agree(spark):
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 31, 32, 200])), f"s{i % 7 if i % 3 else 0}" if i % 11 else None) for i in range(3000)]
    docs += [(5000, None, "s1"), docs[4], docs[4], (None, "a b", "zz"), (6000, "long " * 30_000, "s3")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for block in (4096, 7):
        first = sorted(map(str, mixing.mix(df, block=block).collect()))
        assert first == sorted(map(str, mixing.mix(df.repartition(5), block=block).collect()))
        check_mix(mixing.mix(df, block=block).collect(), len(docs))
    drawn = mixing.draw(df)
    assert drawn.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in drawn.collect()) == +want
    assert mixing.mix(df.limit(0)).count() == 0


def test_hot_null_ids_and_repeated_rows_are_dealt_out(spark):
    docs = [(None, f"{i} b c", "s0") for i in range(3000)] + [(None, "x y z w", "s0")] * 3000 + [(i, "q r", None) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "key": F.lit("k"), "copies": F.lit(None)})
    rows = mixing.mix(df, block=100).collect()
    check_mix(rows, len(docs))
    drawn = mixing.draw(df, block=100)
    assert drawn.columns == df.columns and drawn.count() == sum(r.copies for r in rows)
    sized = mixing._sized(df.withColumn("_no", F.monotonically_increasing_id()), "_no", "doc_id", "text", "source")
    groups = mixing._decided(sized, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES, mixing.SEED, 100).groupBy("source", "block").count()
    assert groups.agg(F.max("count")).first()[0] < 300


def test_pivot_keeps_sums():
    g = np.random.default_rng(2)
    hits = np.zeros(9)
    for _ in range(4000):
        parts = np.array([0.1, 0.5, 0.9, 0.3, 0.7, 0.2, 0, 1, 0.3])
        out, at = mixing.pivot(parts, g.random(9))
        assert abs(out.sum() - parts.sum()) < 1e-9 and all(x in (0, 1) for i, x in enumerate(out) if i != at)
        hits += out
    assert np.abs(hits / 4000 - parts).max() < 0.03
