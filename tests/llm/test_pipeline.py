import random
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from test_lm_mixing import shares
from tokenizers import Tokenizer

rng = random.Random(8)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ber", "tas", "vin", "dor", "pel") for c in ("a", "en", "is", "o", "ur")]


def fixture():
    text = lambda n: "\n".join(" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(n))
    shared = text(1)
    docs = [(i, text(rng.choice([3, 4, 8])) + (f"\n{shared}" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s1") for i in range(8)]
    docs += [(200, None, "en", "s0"), (201, "", None, None), (202, "too short", "en", "s2"), (203, "again and again " * 40, "en", "s2"), (204, text(4), None, None)]
    return docs


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(*d, i) for i, d in enumerate(fixture())], "doc_id long, text string, lang string, source string, n_chars long")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], "").write.parquet(str(tmp_path / str(k)))
        steps.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or steps[-1].columns == columns
    start, good, lined, unique, mixed, packed = ([r for r in s.collect()] for s in steps)

    assert {r.doc_id for r in good} == {r.doc_id for r in start if not brute.quality(r.text)[5]}

    lines = sorted({line for r in good for line in r.text.split("\n") if brute.WORDS.search(line)})
    roots = brute.components(len(lines), lambda i, j: brute.similar(lines[i], lines[j]))
    root = {line: roots[i] for i, line in enumerate(lines)}
    left = Counter(root[line] for r in lined for line in r.text.split("\n") if brute.WORDS.search(line))
    assert set(left) == set(roots) and set(left.values()) == {1} and len(lined) == len(good)

    prints = {r.doc_id: brute.fingerprint(r.text) for r in lined}
    ids = sorted(prints)
    grams = {r.doc_id: brute.word_shingles(r.text) for r in lined}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 6 and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    classes = brute.components(len(ids), lambda i, j: near(ids[i], ids[j]))
    assert sorted(r.doc_id for r in unique) == [ids[i] for i in sorted(set(classes))]

    size = {r.doc_id: len(brute.WORDS.findall(r.text)) for r in unique}
    by_source, taken = Counter(), Counter()
    for r in unique:
        by_source[r.source] += size[r.doc_id]
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    for s, target in shares(dict(by_source)).items():
        assert abs(taken[s] - target) <= max(size.values()), s

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies = Counter(r.doc_id for r in mixed)
    total = sum(copies[r.doc_id] * (len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in unique)
    assert sum(r.length for r in packed) == total
    once = [r for r in packed if copies[r.doc_id] == 1]
    ends = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes() for r in unique if copies[r.doc_id] == 1}
    joined = {}
    for r in sorted(once, key=lambda r: (r.doc_id, r.start)):
        joined[r.doc_id] = joined.get(r.doc_id, b"") + bytes(r.ids)
    assert joined == ends
    assert all(sum(r.length for r in packed if r.sequence_id == s) <= 2048 for s in {r.sequence_id for r in packed})


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
