import hashlib
import random

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm import oracle, queries, warc

rng = random.Random(13)


def page(k, size):
    return f"<html><title>{k}</title>" + " ".join(f"é{rng.randrange(500)}" for _ in range(size))


def rows():
    out = [(i, f"http://h/{i}", page(i, rng.choice([0, 5, 300]))) for i in range(200)]
    out += [(1000 + i, "http://copy/", out[i % 3 + 20][2] + "x" * 100) for i in range(40)]
    out += [(2000, None, None), (2001, "", ""), (2002, "http://a b\r\nX: y\x7f", "short"), (2003, "u", "short"), (2004, "u", "x" * 99), (2005, "u", "x" * 99), (2006, "u", "x" * 100), (2007, "u", "x" * 100)]
    out += [(3000, "u", "y" * 500)] * 3 + [(3001, "u", "y" * 500), (None, "n", "z" * 200), (None, "n", "z" * 200), (None, "n", "q" * 200), (5, "n", "q" * 200), (3002, "big", "w" * 3_000_000), (3003, "big", "\x00\r\n\r\n" * 40)]
    return out


def expected(pages):
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    out, first = [], {}
    for at, (i, p) in sorted(enumerate(payloads), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        again = len(p) >= 100 and p in first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
        first.setdefault(p, i)
    return sorted(out, key=str)


def written(spark, pages, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages], "page_id long, url string, html string, digest string, many int").repartition(parts)
    path = storage.new_path(spark, "test-archives")
    warc.write_archives(df, path)
    return path


def test_round_trip_matches_brute_force(spark):
    pages = rows()
    records = storage.save(warc.read_archives(spark, written(spark, pages)), "records")
    assert records.where("error IS NOT NULL").count() == 0
    assert records.select("record_id").distinct().count() == records.count()
    assert records.where("record_type = 'warcinfo'").count() == 3
    found = warc.resolve(records).where("record_type <> 'warcinfo'")
    got = [tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(pages)
    payloads = sorted((r.page_id, bytes(r.payload)) for r in found.where("page_id < 1000 AND page_id <> 5").collect())
    assert payloads == [(i, h.encode()) for i, _, h in pages[:200] if i != 5]
    uris = {r.page_id: r.uri for r in found.collect()}
    assert uris[2002] == "http://a%20b%0D%0AX:%20y%7F" and uris[2000] == "urn:page:2000"


def test_archives_are_frames_behind_a_dictionary(spark):
    for content in (bytes(r.content) for r in spark.read.format("binaryFile").load(written(spark, rows())).collect()):
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(content[4:8], "little")
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
        whole = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(content, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len([f for f in warc.frames(content)])


def test_few_and_no_pages(spark):
    few = [(1, "u", "a"), (2, "u", "b" * 150)]
    found = warc.resolve(storage.save(warc.read_archives(spark, written(spark, few, 1)), "records")).where("page_id IS NOT NULL")
    assert sorted(r.payload_bytes for r in found.collect()) == [1, 150]
    assert warc.read_archives(spark, written(spark, [], 1)).count() == 0


def damaged(change):
    record = warc.page_record("<urn:uuid:1>", 7, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), warc.DATE, None)
    return change(record)


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.1"), "WARC header"),
        (lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), "WARC-Date is missing"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: revisit"), "stands twice"),
        (lambda r: r.replace(b"Content-Type: application", b"Content Type: application"), "no header"),
        (lambda r: r + b"more", "Content-Length is"),
        (lambda r: r[:-2], "Content-Length is"),
        (lambda r: r.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"), "block isn't"),
        (lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8"), "block isn't"),
        (lambda r: r.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: -", 2), "no length"),
        (lambda r: r.replace(b"HTTP/1.1", b"HTTQ/1.1").replace(b"WARC-Block-Digest", b"X-Digest"), "HTTP header"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), "revisit holds a payload"),
        (lambda r: r.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n").replace(b"WARC-Block-Digest", b"X-Digest"), "payload isn't"),
    ],
)
def test_records_are_validated(change, said):
    with pytest.raises(warc.Broken, match=said):
        warc.parse_record(damaged(change))
    assert damaged(warc.parse_record)["page_id"] == 7


def test_a_bad_frame_costs_itself_only():
    compress = zstandard.ZstdCompressor(write_checksum=True).compress
    raw = [bytes([65 + k]) * 5000 + rng.randbytes(50) for k in range(6)]
    good = [compress(r) for r in raw]
    data = good[0] + warc.SEPARATOR.encode() + good[1][:-1] + b"\xff" + good[2] + b"junk" + good[3] + good[4][:30] + good[5]
    got = list(warc.frames(data))
    assert [d for _, _, d, _ in got if d] in ([raw[0], raw[2], raw[3], raw[5]], [raw[0], raw[2], raw[3]])
    assert all((d is None) == (e is not None) for _, _, d, e in got) and sum(e is not None for *_, e in got) >= 3
    assert list(warc.frames(good[0][:20]))[0][3] and "bytes" in list(warc.frames(good[0], most=100))[0][3]
    assert list(warc.frames(b"")) == []


def test_the_dictionary_is_needed_and_unknown_sizes_are_read():
    frame, trained = warc.dictionary_frame([page(k, 200).encode() for k in range(60)])
    coded = zstandard.ZstdCompressor(dict_data=trained).compress(b"words " * 50)
    assert "dictionary" in list(warc.frames(coded))[0][3]
    assert list(warc.frames(frame + coded))[0][2] == b"words " * 50
    unknown = zstandard.ZstdCompressor(write_content_size=False).compress(b"words " * 50)
    assert list(warc.frames(unknown))[0][2] == b"words " * 50 and "more than" in list(warc.frames(unknown, most=10))[0][3]
    bad = warc.DICTIONARY_FRAME.to_bytes(4, "little") + (4).to_bytes(4, "little") + b"none"
    assert "no dictionary" in list(warc.frames(bad + unknown))[0][3] and list(warc.frames(bad + unknown))[1][2] == b"words " * 50


def test_revisits_without_their_response(spark):
    records = storage.save(warc.read_archives(spark, written(spark, rows())), "records")
    found = warc.resolve(records.where("NOT (record_type = 'response' AND page_id <=> 2006)").withColumn("payload_bytes", F.when((F.col("record_type") == "revisit") & (F.col("page_id") == 3001), 1).otherwise(F.col("payload_bytes"))))
    errors = {r.page_id: r.error for r in found.where("error IS NOT NULL").collect()}
    assert errors == {2007: "the response is missing", 3001: "the response has another payload"}


def test_query_matches_sql_on_copies(spark, tmp_path):
    spark.createDataFrame(rows(), "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(oracle.SQL["op13_warc"])
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in queries.op13_warc(spark, str(tmp_path)).select(*rel.columns).collect())
