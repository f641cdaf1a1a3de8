import random
from functools import reduce

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaline.llm import embeddings, lines, simhash
from tessaline.operators.components import connected_components

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(800)]


def prose(n, rng=rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def changed(words, n, rng=rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (7, None), (900, 450), (450, 901), (901, 33)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 400)} == {100}
    assert got[500] == 500 and got[450] == got[900] == got[901] == 0 and 7 in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_the_radius(radius):
    for _ in range(400):
        bits = reduce(lambda x, b: x | 1 << b, rng.sample(range(64), radius), 0)
        assert any(not bits & m & ((1 << 64) - 1) for m in simhash.masks(radius))


@pytest.mark.parametrize("bucket", [8192, 2])
def test_simhash_matches_brute_force(spark, bucket):
    base = prose(60)
    texts = [None, "", " \n", "Two Words", "two words", "ÉA b", "éa b", "x" * 5000 + " y z"]
    texts += [" ".join(prose(rng.choice([3, 20, 60]))) for _ in range(60)]
    texts += [" ".join(changed(base, rng.choice([0, 1, 1, 2]))) for _ in range(150)] + ["\x00 tail"] * 3
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, node string")
    got = {r.doc_id: r for r in simhash.cluster(docs, bucket=bucket).collect()}
    prints = [brute.fingerprint(t) for t in texts]
    roots = brute.components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert len(got) == len(texts) and len(set(roots)) > 50
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == roots[i]


def test_simhash_of_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.cluster(docs).collect()) == ["4", "4", "4", "None"]
    assert simhash.cluster(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).count() == 2


def test_simhash_stage_keeps_one_of_each_group_of_near_copies(spark):
    g = random.Random(41)
    base = [prose(60, g) for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(changed(b, g.choice([0, 1, 1, 2, 6]), g)) for b in base for _ in range(8)]
    texts += [None, "", " \n", "two words", "Two Words", "one", *texts[:3], "Long " + "again and other " * 20_000, "long " + "again and other " * 20_000]
    docs = spark.createDataFrame([(i, t, i, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int, node string, id int")
    prints = [brute.fingerprint(t) for t in texts]
    grams = [brute.word_shingles(t) for t in texts]
    near = lambda i, j: len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
    roots = brute.components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= simhash.KEEP_RADIUS and near(i, j))
    kept = simhash.keep_one(docs.union(docs.where("doc_id = 5")))
    ids = [r.doc_id for r in kept.collect()]
    exact = brute.components(len(texts), near)
    # no group is lost, nothing stays twice, all links within the radius are found, and some beyond
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and set(exact) <= set(ids) <= set(roots)
    assert len(ids) <= len(set(exact)) + 0.3 * len(texts)


def test_simhash_keeps_a_row_of_each_component(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (None, "q r s t u v"), (9, "k l m n"), (9, "w x y z")], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [("4", "a b c"), ("9", "k l m n"), ("9", "w x y z"), ("None", "q r s t u v")]


def test_lines_match_brute_force(spark):
    rng = random.Random(21)
    base = [prose(rng.choice([3, 12, 30, 60]), rng) for _ in range(80)]
    kinds = [" ".join(b) for b in base] + [" ".join(changed(b, rng.choice([1, 1, 2, 4]), rng)) for b in base for _ in range(4)]
    kinds += ["x", "xy", "abcd", "abcde", "é\U0001f600" * 40, "é\U0001f600" * 41]
    pool = sorted(set(kinds))
    docs = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(12)), "z") for i in range(120)]
    docs += [(900, None, None), (901, "", "q"), docs[7], (None, pool[0] + "\nlast", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, line string")
    got = {r.doc_id: r for r in lines.report(df).collect()}
    seen = [line for line in pool if any(t and line in t.split("\n") for _, t, _ in docs)]
    roots = brute.components(len(seen), lambda i, j: brute.similar(seen[i], seen[j]))
    root = {line: roots[i] for i, line in enumerate(seen)}
    kept = {}
    for i, text, _ in docs[:120]:
        stay = [n for n, line in enumerate(text.split("\n")) if str(n) not in got[i].dropped.split(",")]
        for n in stay:
            line = text.split("\n")[n]
            if line.strip():
                kept.setdefault(root.get(line, line), []).append((i, n))
    # no component is lost, and nearly all keep a single line: the rest is banding's recall
    assert set(kept) >= {root[line] for i, t, _ in docs[:120] for line in t.split("\n") if line.strip()} - {root.get(pool[0])}
    assert sum(len(v) for v in kept.values()) <= 1.02 * len(kept) + 1
    assert got[900].n_lines == 0 and got[901].n_lines == 1
    out = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert out[900] is None and out[901] == "" and lines.dedup(df).count() == len(docs)
    for i, text, _ in docs[:120]:
        gone = {int(x) for x in got[i].dropped.split(",") if x}
        assert out[i] == "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
    assert lines.report(df.limit(0)).count() == 0


def test_bands_find_similar_lines_of_any_script(spark):
    g = random.Random(11)
    words = lambda: " ".join(g.choice(VOCABULARY) for _ in range(g.choice([6, 10, 20])))
    spaceless = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(60))
    cjk = lambda: "".join(chr(0x4E00 + g.randrange(3000)) for _ in range(50))
    for make in (words, spaceless, cjk):
        pairs = []
        while len(pairs) < 150:
            a = make()
            b = list(a)
            for _ in range(g.choice([1, 1, 2])):
                b[g.randrange(len(b))] = g.choice(a)
            if a != (b := "".join(b)) and brute.similar(a, b):
                pairs.append((len(pairs), a, b))
        found = spark.createDataFrame([(k, side, line) for k, *both in pairs for side, line in enumerate(both)], "doc_id long, side int, line string")
        bands = {(r.doc_id, r.side): set(r.bands) for r in found.join(lines._signed(found).select("id", "bands"), F.xxhash64("line") == F.col("id")).collect()}
        assert sum(bool(bands[k, 0] & bands[k, 1]) for k, _, _ in pairs) >= 0.98 * len(pairs), make


@pytest.mark.parametrize("words", [6, 12, 30])
@pytest.mark.parametrize("gap", [" ", ""])
def test_lines_recall_by_length_and_script(spark, words, gap):
    g = random.Random(31 + words)
    pairs = []
    while len(pairs) < 200:
        a = prose(words, g)
        b = gap.join(changed(a, 1, g)) if g.random() < 0.5 else gap.join(a)[:-2] + g.choice(VOCABULARY)
        if (a := gap.join(a)) != b and brute.similar(a, b):
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)], "doc_id long, text string")
    lost = {r.doc_id for r in lines.report(docs).where("n_dropped = 1").collect()}
    assert lost <= {2 * i + 1 for i in range(len(pairs))}
    assert len(lost) >= 0.95 * len(pairs)


@pytest.mark.parametrize("levels", [3, 1, 0])
def test_large_buckets_link_members_far_from_both_ends(spark, monkeypatch, levels):
    monkeypatch.setattr(lines, "LEVELS", levels)
    monkeypatch.setattr(lines, "BLOCK", 8)
    monkeypatch.setattr(lines, "ALL_PAIRS", 16)
    g = random.Random(12)
    letters = lambda n: "".join(g.choice("abcdefghijklmnop") for _ in range(n))
    opening = letters(60)
    pool = []
    for _ in range(30):
        variant = opening + letters(40)
        pool += [variant, variant[:-1] + "#"]
    found = spark.createDataFrame([(i, line) for i, line in enumerate(pool)], "doc_id long, line string")
    ids = [r.id for r in found.orderBy("doc_id").select(F.xxhash64("line").alias("id")).collect()]
    # all lines share the only bucket there is
    single = found.select(F.xxhash64("line").alias("id"), F.array(F.lit(1).cast("long")).alias("bands"))
    root = {r.node: r.component for r in connected_components(lines.similar(single, found)).collect()}
    expected = brute.components(len(pool), lambda i, j: brute.similar(pool[i], pool[j]))
    assert len(set(expected)) == 30
    assert all(root.get(ids[i]) == root.get(ids[j]) is not None for i, j in enumerate(expected) if i != j)
    assert len({root.get(i) for i in ids}) == 30


@pytest.mark.parametrize("block", [512, 8])
def test_embeddings_match_brute_force(spark, block):
    g = np.random.default_rng(4)
    centres = g.standard_normal((12, 16))
    vectors = [(centres[i % 12] + g.standard_normal(16) * g.choice([0.02, 0.08, 0.15, 2])).astype(np.float32).tolist() for i in range(240)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 16, [None] + vectors[2][1:], [float("nan")] + vectors[2][1:], [float("inf")] + vectors[2][1:], vectors[3][:8]]
    df = spark.createDataFrame([(i, v, i % 3, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n int")

    def unit(v):
        x = np.array([np.nan if y is None else y for y in v or []], float)
        return x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None

    units = [unit(v) for v in vectors]
    linked = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95
    roots = brute.components(len(vectors), linked)
    got = {r.vec_id: r for r in embeddings.cluster(df, block=block).collect()}
    degrees = [sum(linked(i, j) for j in range(len(vectors)) if j != i) for i in range(len(vectors))]
    assert len(got) == len(vectors) and max(degrees) > 5
    assert sum(got[i].n_links for i in got) >= 0.995 * sum(degrees)
    for i in got:
        assert got[i].n_links <= degrees[i]
        if got[i].n_links == degrees[i]:
            assert got[i].component_id == roots[i] and got[i].kept == (roots[i] == i)
    assert embeddings.cluster(df.limit(0)).count() == 0


def test_simhash_stage_finds_pairs_of_every_similarity(spark):
    """Pairs of long texts by the Jaccard similarity of their five-word shingles; the pairs share nothing with each other."""
    g, texts, classes = random.Random(43), [], {}
    while len(texts) < 1600:
        size = g.randrange(80, 700)
        words_ = [f"{g.choice(VOCABULARY)}{g.randrange(40)}" for _ in range(size)]
        a, b = " ".join(words_), " ".join(changed(words_, max(1, round(size * g.uniform(0.002, 0.023))), g))
        x, y = brute.word_shingles(a), brute.word_shingles(b)
        similarity = len(x & y) / len(x | y)
        if similarity >= 0.8:
            classes.setdefault(min(int(similarity * 20), 18), []).append(len(texts))
            texts += [a, b]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    found = {c / 20: sum(i + 1 not in kept for i in firsts) / len(firsts) for c, firsts in classes.items()}
    print("found by similarity", {k: (round(v, 3), len(classes[round(k * 20)])) for k, v in sorted(found.items())})
    assert all(i in kept for firsts in classes.values() for i in firsts)
    assert len(found) == 3 and all(len(v) > 100 for v in classes.values()) and found[0.8] >= 0.88 and found[0.85] >= 0.93 and found[0.9] >= 0.97
    assert sum(v * len(classes[round(k * 20)]) for k, v in found.items()) >= 0.92 * len(texts) / 2
