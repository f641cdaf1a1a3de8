import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessaline.llm import chat, packing, queries
from tessaline.llm.chat import CONTROL

LOG = "conv_id long, seq long, event string, msg long, role string, text string, formatted string"


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([*CONTROL, "\\", "<", "[", ">", "|", " ", "x", "\n"]) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in CONTROL)
        role = rng.choice(["user", "assistant", "system", "tool|", "", text])
        turns = [(role, text), ("assistant", text), ("user", "<"), ("x", text)]
        assert chat.read_back(chat.render(turns)[0]) == turns


def test_log_is_folded(spark):
    log = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "delta", 5, "assistant", "he"), (1, 2, "delta", 5, "assistant", "llo"),
        (1, 3, "message", 6, "user", "gone"), (1, 4, "regenerate", 5, None, None), (1, 5, "delta", 5, "assistant", "bye"),
        (1, 6, "message", 7, "user", "typo"), (1, 7, "edit", 7, "user", "fixed"),
        (None, 0, None, None, None, None), (2, None, "message", None, "tool", "t"), (2, None, "message", None, "tool", "t"),
    ]
    out = {r.conv_id: r for r in chat.format_log(spark.createDataFrame([(*r, "clash") for r in log], LOG)).collect()}
    assert chat.read_back(out[1].formatted) == [("user", "hi"), ("assistant", "bye"), ("user", "fixed")]
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss] == ["bye"]
    assert chat.read_back(out[None].formatted) == [("", "")]
    assert chat.read_back(out[2].formatted) == [("tool", "t")] * 2
    assert chat.format_log(spark.createDataFrame([], LOG)).count() == 0


def check_pieces(rows, expected, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
    for doc, pieces in by_doc.items():
        at, data = 0, b""
        for start, ids in sorted(pieces):
            assert start == at
            at, data = at + len(ids) // 4, data + ids
        assert data == expected[doc]
    assert set(by_doc) == set(expected)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_every_id_in_one_piece(spark):
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|> x  y \n z", "a\n\n b", "tab\t x   y é ", " lead", "trail ", *(" ".join(rng.choice(["the", "Foo,", "12", "naïve", "\n"]) for _ in range(rng.choice([3, 40, 900, 6000]))) for _ in range(60))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(2)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    padding = check_pieces(rows, expected, 2048)
    assert padding < 0.01 * sum(len(x) // 4 for x in expected.values())
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert zlib.crc32(b"") == 0


@pytest.mark.parametrize("sizes", [[4], [1, 9], [2] * 9 + [400]])
def test_short_documents_need_hardly_any_padding(spark, sizes):
    texts = ["the " * (sizes[i % len(sizes)] - 1) + "the" for i in range(4000)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in set(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert check_pieces(rows, {i: ids[t] for i, t in enumerate(texts)}, 2048) <= 0.01 * sum(len(ids[t]) // 4 for t in texts)


def test_packing_query_gives_the_checks_of_its_pieces(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "word " * 5000)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_packing(spark, str(tmp_path)).collect()
    pieces = {(r.doc_id, r.start): r for r in packing.pack(docs.coalesce(1), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    whole = {d: b"".join(bytes(p.ids) for k, p in sorted(pieces.items()) if k[0] == d) for d in (1, 2, 3)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens == len(whole[r.doc_id]) // 4


def test_chat_query_against_plain_digests(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "\\", "</s> <s>", "[/INST]<<SYS>>", "é\U0001f600 x", "line\n\nline", "long " * 20_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts)) for c in range(30) for t in range(rng.randint(1, 6))]
    rows += [(90, 0, "user", "same"), (90, 0, "user", "same"), (91, None, "assistant", "no turn")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, event string, msg int").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        by[c].append((role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render(turns)[0])


def test_limits_hold_together(spark):
    docs = spark.createDataFrame([(i, "q " * (i % 7), "a b c " * (1 + i % 50)) for i in range(300)], "doc_id long, prompt string, text string")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), prompt="prompt", length=256, max_segments=4, max_loss=128).collect()
    sums = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        for k, v in enumerate((r.length, 1, r.loss_tokens)):
            sums[r.sequence_id][k] += v
    assert all(a <= 256 and b <= 4 and c <= 128 for a, b, c in sums.values())


def test_a_long_conversation_is_folded_in_linear_time():
    import time

    n, messages, began = 200_000, chat.Messages(), time.time()
    for k in range(n):
        messages.apply(3 * k, "message", k, "assistant", "draft")
        messages.apply(3 * k + 1, "regenerate", k, None, None)
        messages.apply(3 * k + 2, "delta", k, None, f"t{k}")
    messages.apply(3 * n, "regenerate", n - 3, "user", "end")  # takes the two behind it away
    messages.apply(3 * n + 1, "delta", n - 1, "assistant", "new")  # isn't there any more, so it starts anew
    turns = list(messages)
    assert len(turns) == n - 1 and turns[-3:] == [("assistant", f"t{n - 4}"), ("user", "end"), ("assistant", "new")]
    assert time.time() - began < 20
