import hashlib
import random
import zlib
from fractions import Fraction

import brute
import numpy as np
from pyspark.sql import functions as F

from tessaline.llm import periods, queries

rng = random.Random(12)


def plain_runs(ws, least=6, times=4):
    """All maximal repetitions, by trying each period at each place."""
    found, n = {}, len(ws)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and ws[i] == ws[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)  # periods come in ascending order
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(ws, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def texts():
    for _ in range(150):
        size, letters = rng.choice([0, 1, 5, 8, 40, 200]), rng.choice([1, 2, 3, 30])
        ws = [f"x{rng.randrange(letters)}" for _ in range(size)]
        for _ in range(rng.randrange(3)):
            unit = [f"x{rng.randrange(letters)}" for _ in range(rng.randrange(1, 12))]
            ws[(at := rng.randrange(len(ws) + 1)) : at] = (unit * 9)[: rng.randrange(1, 60)]
        yield ws


def test_runs_match_brute_force():
    all_ = list(texts())
    codes = [np.array([int(w[1:]) for w in ws], np.int64) for ws in all_]
    found = periods.runs_of(codes)
    for k, ws in enumerate(all_):
        assert [tuple(r) for r in found.get(k, np.zeros((0, 3), int)).tolist()] == plain_runs(ws)
    assert len(found) > 40


def test_one_long_text_of_runs_within_runs():
    unit = ["a"] * 7 + ["b", "c"] * 4
    ws = [f"w{i}" for i in range(30_000)] + unit * 900 + ["end"] + ["z"] * 20_000
    codes = np.unique(ws, return_inverse=True)[1]
    found = [tuple(r) for r in periods.runs_of([codes])[0].tolist()]
    assert (30_000, 13_500, 15) in found and (43_501, 20_000, 1) in found
    assert len(found) == 2 + 2 * 900 and (30_000, 7, 1) in found and (30_007, 8, 2) in found


def test_extensions():
    words = np.array([*[rng.randrange(3) for _ in range(400)], 9])
    a, b = np.array([(i, j) for i in range(0, 400, 7) for j in range(400) if i != j]).T
    want = [next(k for k in range(402) if words[i + k] != words[j + k]) for i, j in zip(a, b, strict=True)]
    assert periods.Extensions(words)(a, b).tolist() == want


def test_operator_and_its_edge_cases(spark):
    rows = [(i, " ".join(ws)) for i, ws in enumerate(texts())] + [(None, "a " * 9), (4, None), (4, ""), (4, None), (5, "é é " * 40), (6, "long " * 150_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    with_words = df.withColumn("words", F.when(F.col("text").isNotNull(), F.filter(F.split("text", "[ ]+"), lambda w: w != "")))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(with_words).collect()), key=str)
    want = []
    for i, t in rows:
        ws = (t or "").split()
        runs = plain_runs(ws) if len(ws) < 10_000 else [(0, len(ws), 1)]
        want.append((i, len(ws), runs, collapsed(ws, runs) if len(ws) < 10_000 else "long"))
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(with_words.limit(0)).count() == 0


def planted(i, text):
    ws = brute.WORDS.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(ws)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if k < a else ws[a + (k - a) % p] for k, w in enumerate(ws)]
    return ws


def test_query_matches_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    folder, some = "/root/testdata/sf0.001", 0
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ws, r = planted(d.doc_id, d.text), got[d.doc_id]
        runs = plain_runs(ws)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(collapsed(ws, runs))
        some += bool(runs)
    assert some > 10
