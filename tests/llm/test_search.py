import math
import random
import re

from tessaline.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
rng = random.Random(11)


def plain(docs, items, top=10, repeats=False):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: TERM.findall((t or "").translate(lower))
    texts = [(i, cut(t)) for i, t in docs]
    n_docs, all_terms = sum(bool(ws) for _, ws in texts), sum(len(ws) for _, ws in texts)
    counts = [(i, len(ws), {w: ws.count(w) for w in set(ws)}) for i, ws in texts]
    out = []
    for item, t in items:
        ws = cut(t)
        total = [0] * len(docs)
        for w in set(ws):
            df = sum(w in c for _, _, c in counts)
            for k, (_, n, c) in enumerate(counts):
                if w in c:
                    m = 10 + 90 * n * n_docs // all_terms
                    total[k] += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) * (ws.count(w) if repeats else 1)
        best = sorted((-s, i is None, i or 0) for s, (i, _) in zip(total, docs, strict=True) if s > 0)[:top]
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(best)]
    return sorted(out, key=str)


def collected(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.schema["rank"].dataType.simpleString() == "int"
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark):
    vocabulary = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(3000)]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([1, 10, 80]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "-- \x00 \x7f"), (303, docs[5][1]), (303, docs[5][1]), (None, docs[6][1]), (304, "Été ÉTÉ 東京 w1"), (305, "w1 w2 " * 40_000)]
    items = [(i, text(rng.choice([3, 30]))) for i in range(25)] + [(25, None), (26, "..."), (27, "nowhere"), (3, "été w1 w1 W1"), (None, "w2 東京")]
    d = spark.createDataFrame([(*x, "b", 1) for x in docs], "doc_id long, text string, item_id string, score int")
    return docs, items, d, spark.createDataFrame([(*x, 0.5) for x in items], "item_id long, text string, rank double")


def test_search_matches_a_plain_version(spark, monkeypatch):
    docs, items, d, b = tables(spark)
    want = plain(docs, items)
    assert len(want) > 200 and collected(search.search(d, b)) == want
    assert collected(search.search(d.repartition(7), b.repartition(3), entries=40)) == want  # several blocks of items
    assert collected(search.search(d, b, top=3, repeats=True)) == plain(docs, items, 3, True)


def test_small_blocks_of_documents_change_nothing(spark):
    import pyarrow as pa

    block = search._Block()
    for key, words in enumerate(search.terms(pa.array(["a b a", "", "B c"]))):
        found = [{b"a": 0, b"b": 1}[w] for w in words if w in (b"a", b"b")]
        block.found.extend(found)
        block.ids.append(key)
        block.sizes.append(len(words))
        block.hits.append(len(found))
    row = block.matrix().to_pylist()[0]
    assert (row["n_docs"], row["n_terms"], row["terms"], row["counts"]) == (2, 5, [0, 1], [1, 2])
    best = search._Best(2)
    import numpy as np

    for scores, ids in (([5, 0, 7], [9, 1, 4]), ([7, 7, 5], [3, 8, 1])):
        best.add(np.array(scores), np.array(ids), np.zeros(3, bool))
    assert best.scores.tolist() == [7, 7] and best.ids.tolist() == [3, 4]


def test_many_equal_documents_go_by_id(spark):
    d = spark.range(5000).selectExpr("5000 - id AS doc_id", "if(id < 2000, 'same words', 'other') AS text").repartition(9)
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r.doc_id for r in search.search(d, items).orderBy("rank").collect()] == list(range(3001, 3011))


def test_empty_tables(spark):
    _, _, d, b = tables(spark)
    assert collected(search.search(d.limit(0), b)) == collected(search.search(d, b.limit(0))) == []
    assert collected(search.search(d.where("text = ''"), b)) == []
