"""WARC archives in Zstandard: written by Spark's tasks and read back record by record.

An archive begins with a skippable frame that holds its dictionary, trained on the first
pages of the task that writes it; then each record is a frame of its own, so a damaged one
costs itself only. A payload that an earlier record holds is written as a revisit.

Frames go through Spark's text writer as raw bytes, so its committer puts each file in
place once, whatever tasks are tried again, on any file system Spark knows. What the writer
puts behind each row is an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline import storage

# Fixed values of the Zstandard and WARC formats.
FRAME, DICTIONARY, SKIPPABLE, DICTIONARY_FRAME = 0xFD2FB528, 0xEC30A437, 0x184D2A50, 0x184D2A5D
SEPARATOR = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 100
#: Bytes of the first pages that a dictionary is trained on, how much of each page, and the dictionary's size.
SAMPLE_BYTES, SAMPLE_PAGE, DICTIONARY_BYTES = 1 << 20, 16 << 10, 64 << 10
#: The largest record that is decoded.
MAX_RECORD = 1 << 30
DATE = "1970-01-01T00:00:00Z"


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(of).encode()).digest()[:16], version=4)}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha256:{_sha256(block)}"), ("Content-Length", len(block))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), b"\r\n", block, b"\r\n\r\n"])


def page_record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, response: str | None) -> bytes:
    """A page as a response record, or as a revisit of the record named by response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    headers = [("WARC-Type", "revisit" if response else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [("WARC-Page-ID", page_id)] if page_id is not None else []
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response)] if response else []
    return _record(headers, http if response else http + payload)


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The leading frame and its dictionary; nothing where samples are too few to train one."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        return b"", None
    data = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data, trained


def _repeated(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, bool]:
    """digest, first (the smallest page_id) of payloads of several pages, and whether some first is not one row alone."""
    narrow = storage.save(pages.where(F.octet_length("html") >= least_bytes).select("page_id", "digest"), "digests")
    ids = narrow.groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy("digest").agg(F.min(F.struct(F.isnull("page_id").alias("none"), "page_id", "n")).alias("first"), F.sum("n").alias("pages"))
    groups = storage.save(groups.where("pages > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.n").alias("n")), "repeated")
    return groups, bool(groups.where("n > 1").limit(1).count())


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes pages as WARC archives into the folder path, one archive for each partition that has rows.

    A page is a record with the UTF-8 bytes of html as payload; null is empty. Of pages with
    equal payloads of at least least_bytes bytes the one with the smallest page_id (null
    last; of repeated rows the first) is a response and the others are revisits without
    payload; all other pages are responses. A null or empty url is named after the page, and
    blanks and control characters in it are escaped. An empty table gives no record; other
    columns are not read. Pages are not shuffled unless repeated payloads are too many to be
    broadcast; an archive has the size of a partition.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    repeated, tied = _repeated(rows, least_bytes)
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    if tied:
        rows = storage.save(rows.withColumn("no", F.monotonically_increasing_id()), "numbered")
        numbers = rows.join(storage.broadcast_if_small(repeated.select("digest", "first")), "digest").where(is_first).groupBy("digest").agg(F.min("no").alias("first_no"))
        repeated = storage.save(repeated.join(numbers, "digest"), "repeated")
        is_first = F.col("no") == F.col("first_no")
    rows = rows.join(storage.broadcast_if_small(repeated.withColumn("many", F.lit(True)).drop("n")), "digest", "left")
    rows = rows.select("page_id", "url", "html", "digest", F.coalesce("many", F.lit(False)).alias("many"), F.coalesce(F.col("many") & ~is_first, F.lit(False)).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, samples, size, compress = TaskContext.get().partitionId(), 0, [], [], 0, None

        def start() -> list[bytes]:
            nonlocal compress
            frame, trained = dictionary_frame(samples)
            compress = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True).compress
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("archive", date, task)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return [*([frame] if frame else []), compress(info), *map(compress, held)]

        for batch in batches:
            out = []
            for key, at, text, digest, many, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                number += 1
                own = _urn("payload", digest) if many and not again else _urn("page", task, number, key)
                record = page_record(own, key, at, payload, digest, date, _urn("payload", digest) if again else None)
                if compress:
                    out.append(compress(record))
                    continue
                held.append(record)
                samples.append(record[:SAMPLE_PAGE])
                size += len(record)
                if size >= SAMPLE_BYTES:
                    out += start()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if held and not compress:
            yield pa.RecordBatch.from_arrays([pa.array(start(), pa.binary())], names=["frame"])

    rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


class Broken(ValueError):
    """What is wrong with a frame or a record."""


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at a place ends, by its block headers."""
    if at + 5 > len(data):
        raise Broken("the frame's header is cut off")
    kind = data[at + 4]
    single, end = kind >> 5 & 1, at + 5
    end += (0 if single else 1) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        if block >> 1 & 3 == 3:
            raise Broken("the frame has a block of no known type")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if end > len(data):
            raise Broken("the frame is cut off")
        if block & 1:
            break
    end += 4 if kind >> 2 & 1 else 0
    if end > len(data):
        raise Broken("the frame's checksum is cut off")
    return end


def _decoded(frame: bytes, dictionary: zstandard.ZstdCompressionDict | None, most: int) -> bytes:
    try:
        told = zstandard.get_frame_parameters(frame)
        if told.dict_id and told.dict_id != (dictionary.dict_id() if dictionary else 0):
            raise Broken(f"the frame asks for dictionary {told.dict_id}, which the archive doesn't begin with")
        known = told.content_size not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
        if known and told.content_size > most:
            raise Broken(f"the record has {told.content_size} bytes; {most} are read at most")
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
        if known:
            return decoder.decompress(frame)
        with decoder.stream_reader(frame) as stream:
            out = stream.read(most + 1)
        if len(out) > most:
            raise Broken(f"the record has more than {most} bytes")
        return out
    except zstandard.ZstdError as e:
        raise Broken(f"the frame can't be decoded: {e}") from e


def frames(data: bytes, most: int = MAX_RECORD) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """offset, length, decoded bytes or None, error or None of each frame of an archive but skippable ones.

    After a fault reading goes on at the next place that looks like a frame, behind the
    faulty one if its end is known.
    """
    at, dictionary = 0, None
    while at < len(data):
        magic, end = int.from_bytes(data[at : at + 4], "little"), None
        try:
            if magic & ~0xF == SKIPPABLE:
                end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
                if end > len(data) or at + 8 > len(data):
                    raise Broken("the skippable frame is cut off")
                if at == 0 and magic == DICTIONARY_FRAME:
                    content = data[8:end]
                    if int.from_bytes(content[:4], "little") == FRAME:
                        content = _decoded(content, None, most)
                    if int.from_bytes(content[:4], "little") != DICTIONARY:
                        raise Broken("the leading frame holds no dictionary")
                    dictionary = zstandard.ZstdCompressionDict(content)
            elif magic == FRAME:
                end = _frame_end(data, at)
                yield at, end - at, _decoded(data[at:end], dictionary, most), None
            else:
                raise Broken("no frame begins here")
        except Broken as e:
            if end is None or end > len(data):
                end = data.find(FRAME.to_bytes(4, "little"), at + 1)
                end = len(data) if end < 0 else end
            yield at, end - at, None, str(e)
        at = end


_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)", re.DOTALL)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out, last = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += f" {line.strip().decode(errors='replace')}"
        elif m := _HEADER.fullmatch(line):
            last = m[1].decode().lower()
            if last in out and not last.startswith("warc-concurrent"):
                raise Broken(f"header {m[1].decode()} stands twice")
            out[last] = m[2].strip().decode(errors="replace")
        else:
            raise Broken(f"no header: {line[:40]!r}")
    return out


def _number(value: str | None, name: str) -> int:
    if value is None or not re.fullmatch(r"[0-9]{1,18}", value):
        raise Broken(f"{name} is no length: {value!r}")
    return int(value)


def _holds(digest: str | None, data: bytes, what: str) -> None:
    """Raises unless a sha256 digest, in either case of letters, is that of data; other digests aren't known here."""
    if digest and digest.lower().startswith("sha256:") and digest[7:].lower() != _sha256(data):
        raise Broken(f"the {what} isn't the one that its digest tells")


def parse_record(raw: bytes) -> dict:
    """The fields of a decoded record; raises Broken if headers, lengths or digests don't hold."""
    head, gap, _ = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise Broken("the record doesn't begin with a WARC header")
    headers = _headers(lines)
    for name in MANDATORY:
        if not headers.get(name.lower()):
            raise Broken(f"header {name} is missing")
    size, start = _number(headers["content-length"], "Content-Length"), len(head) + 4
    if len(raw) != start + size + 4 or not raw.endswith(b"\r\n\r\n"):
        raise Broken(f"Content-Length is {size}, but the frame holds {len(raw) - start - 4} bytes and an end")
    block = raw[start : start + size]
    _holds(headers.get("warc-block-digest"), block, "block")
    kind, digest = headers["warc-type"].lower(), headers.get("warc-payload-digest")
    page = headers.get("warc-page-id")
    out = {"record_type": kind, "record_id": headers["warc-record-id"], "uri": headers.get("warc-target-uri"), "date": headers["warc-date"], "page_id": int(page) if page and re.fullmatch(r"-?[0-9]{1,19}", page) else None, "refers_to_record": headers.get("warc-refers-to"), "payload_bytes": size, "payload": block}
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise Broken("the block doesn't begin with an HTTP header")
        told = _headers(lines).get("content-length")
        out["payload_bytes"] = _number(told, "the HTTP Content-Length") if told is not None or kind == "revisit" else len(payload)
        if kind == "response" and out["payload_bytes"] != len(payload):
            raise Broken(f"the HTTP Content-Length is {told}, but the payload has {len(payload)} bytes")
        if kind == "revisit" and payload:
            raise Broken("a revisit holds a payload")
        out["payload"] = None if kind == "revisit" else payload
    if kind == "revisit" and not (digest and out["refers_to_record"]):
        raise Broken("a revisit names no digest or no record")
    if kind == "response":
        _holds(digest, out["payload"], "payload")
        digest = digest or f"sha256:{_sha256(out['payload'])}"
    out["payload_digest"] = digest[7:].lower() if digest and digest.lower().startswith("sha256:") else digest
    return out


_FIELDS = {"archive": "string", "offset": "long", "length": "long", "record_type": "string", "record_id": "string", "uri": "string", "date": "string", "page_id": "long", "refers_to_record": "string", "payload_bytes": "long", "payload_digest": "string", "payload": "binary", "error": "string"}
_ARROW = pa.schema([(k, {"long": pa.int64(), "binary": pa.binary()}.get(v, pa.string())) for k, v in _FIELDS.items()])
#: Decoded bytes of records that are handed back at once.
HANDED = 32 << 20


def read_archives(spark: SparkSession, path: str, payload: bool = True, most: int = MAX_RECORD) -> DataFrame:
    """A row per record of the archives in the folder path: where it is, its fields, its payload, and what is wrong with it.

    archive, offset, length tell the frame; record_type, record_id, uri, date, page_id,
    refers_to_record are headers; payload_bytes and payload_digest are those of the full
    payload, also of revisits, which have none themselves. Without payload that column is
    null. A frame that can't be decoded and a record whose headers, lengths or digests don't
    hold give a row with null fields and error; the others of the archive are read all the
    same. Empty files and folders without files give no rows. An archive is read by one
    task, in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for offset, length, raw, error in frames(content.as_py(), most):
                    row = {"archive": archive, "offset": offset, "length": length, "error": error}
                    if raw is not None:
                        try:
                            row |= parse_record(raw)
                        except Broken as e:
                            row["error"] = str(e)
                        row = row if payload else row | {"payload": None}
                        size += len(raw)
                    out.append(row)
                    if size >= HANDED:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


def resolve(records: DataFrame) -> DataFrame:
    """records (of read_archives, written) with refers_to: the page_id of the response that a revisit names.

    A revisit whose response isn't there, or has another digest or length, gets an error and
    a null refers_to; all other records have a null refers_to. Responses that are named are
    told apart first, and are broadcast where they are few.
    """
    named = records.where("record_type = 'revisit' AND error IS NULL").select("refers_to_record").distinct()
    responses = records.where("record_type = 'response' AND error IS NULL").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    named = storage.save(responses.join(named, "refers_to_record", "left_semi").dropDuplicates(["refers_to_record"]), "responses")
    revisit = (F.col("record_type") == "revisit") & F.col("error").isNull()
    joined = records.join(storage.broadcast_if_small(named), "refers_to_record", "left")
    found = revisit & (F.col("_digest") == F.col("payload_digest")) & (F.col("_bytes") == F.col("payload_bytes"))
    error = F.when(revisit & ~F.coalesce(found, F.lit(False)), F.when(F.col("_digest").isNull(), "the response is missing").otherwise("the response has another payload")).otherwise(F.col("error"))
    return joined.select(*(F.col(c) for c in records.columns if c != "error"), F.when(found, F.col("_page")).alias("refers_to"), error.alias("error"))
