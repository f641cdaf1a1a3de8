"""One query per operator, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm import chat, embeddings, licenses, lines, lm, mixing, packing, periods, quality, search, secrets, simhash, warc
from tessaline.llm.words import words
from tessaline.sources.tables import table

#: The vocabulary as files of public tokenizers; paths are the operator's parameters.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_CHAT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns = chat.read_back(formatted)
            learned = "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in loss)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_CHAT), _CHAT, strict=True)], schema=_CHAT)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_log(chat.turns_as_log(turns))
    return formatted.mapInArrow(_chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.cluster(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, words of docs; in a tenth of them a stretch of words is repeated up to the end."""
    col, h = F.col, F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", words(col("text")).alias("w"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("changed"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(col("changed") & (col("n") > 0), col("g") % col("n")))
    rows = rows.withColumn("p", 1 + F.floor((col("n") - col("a")) / (3 + col("g") % 8)))
    unit = F.slice("w", (col("a") + 1).cast("int"), col("p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((col("n") - col("a")) / col("p")).cast("int"))), 1, (col("n") - col("a")).cast("int"))
    return rows.select("doc_id", F.when(col("a").isNotNull(), F.concat(F.slice("w", 1, col("a").cast("int")), tail)).otherwise(col("w")).alias("words"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_made_periodic(table(spark, sf_dir, "documents"))).withColumn("best", periods.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period AS exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.resolve(storage.save(warc.read_archives(spark, path, payload=False), "records"))
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "archive", "offset", "error")))
    return records.where("error IS NOT NULL OR record_type IN ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_secret_scan, op3_simhash, op4_license_scan, op5_chat_format, op6_lm_score, op7_line_dedup, op8_packing, op9_embedding_dedup, op10_mixing, op11_lexical_search, op12_periodic_runs, op13_warc)
}
