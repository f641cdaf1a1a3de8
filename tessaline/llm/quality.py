"""Quality rules: documents fail by themselves or because their host mostly fails.

A host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts
(method of moments), so a host with three bad pages is not condemned on them alone.
Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline import storage
from tessaline.llm.words import GAP_CHARACTERS, WORD, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is dropped as a whole when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8

_SYMBOLS = "#*$%&|<>"


def _length_without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _repeats(df: DataFrame) -> DataFrame:
    """Adds _w_repeats from _w (words): how many words lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash within one text. Texts without a repeated window
    skip the sort.
    """
    w, n = F.col("_w"), F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))
    df = df.withColumn("_h", F.coalesce(windows, _none()))
    h = F.col("_h")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    s = F.col("_s")
    found = F.filter(s, lambda e, j: (j > 0) & F.get(s, F.greatest(j - 1, F.lit(0)))["x"].eqNullSafe(e["x"]) | F.get(s, j + 1)["x"].eqNullSafe(e["x"]))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return df.withColumn("_w_repeats", F.when(s.isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("_h", "_s")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns and a struct ``_m`` of the measures of each text.

    A null or empty text has zero words and fails. Code points are counted, not bytes.
    """
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda line: line.rlike(WORD))
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t"))).withColumn("_l", lines)
    df = _repeats(df)
    n_words = F.size("_w").cast("long")
    failed = (n_words < MIN_WORDS) | (100 * F.col("_w_repeats") > MAX_REPEAT_PERCENT * n_words)
    measures = F.struct(
        n_words.alias("n_words"),
        F.length(F.translate("_t", GAP_CHARACTERS, "")).cast("long").alias("word_chars"),
        _length_without(F.col("_t"), _SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_w_repeats").alias("n_repeat_words"),
        failed.alias("base_failed"),
    )
    return df.withColumn("_m", measures).drop("_t", "_w", "_l", "_w_repeats")


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed and rate (shrunk) of each host of (host, base_failed); no row for null."""
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    return measured.sparkSession.sql(
        """
        SELECT host, n, failed, (failed + p.mean * p.strength) / (n + p.strength) AS rate
        FROM (SELECT *, (
            SELECT named_struct('mean', mean, 'strength',
                CASE WHEN mean * (1 - mean) <= 0 THEN 2D
                     ELSE least(1e6D, greatest(2D, mean * (1 - mean) / greatest(spread - mean * (1 - mean) * hosts / docs, 1e-9D) - 1)) END)
            FROM (SELECT sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) - pow(sum(failed) / sum(n), 2) AS spread,
                         count(*) AS hosts, sum(n) AS docs FROM {hosts})
        ) AS p FROM {hosts})
        """,
        hosts=hosts,
    )


def condemned_hosts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    return host_rates(measured).where(F.col("rate") > max_rate).select("host")


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its measures, base_failed, host_failed and kept.

    Rows are judged one by one, so repeated ids and repeated rows each give a row. A null
    host is never condemned. Other columns of docs are not read. An empty table gives none.

    Texts are read once; what is shuffled is a row per host. Verdicts come back by a
    broadcast of the condemned hosts if few, else by a join that splits hot hosts.
    """
    rows = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")))
    measured = storage.save(rows.select("doc_id", "host", "_m.*"), "quality")
    bad = storage.save(condemned_hosts(measured, max_rate), "hosts").withColumn("host_failed", F.lit(True))
    out = measured.join(storage.broadcast_if_small(bad), "host", "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~failed).alias("kept"), failed.alias("host_failed"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that pass, with the columns they had.

    The rules run a second time over the texts, which costs less than joining the first
    run's verdicts to them would: no text is shuffled.
    """
    narrow = measure(docs.select(F.col(host).alias("host"), F.col(text).alias("text"))).select("host", "_m.base_failed")
    measured = storage.save(narrow, "quality")
    bad = storage.save(condemned_hosts(measured, max_rate), "hosts")
    storage.drop(measured)
    text_, host_ = storage.fresh(docs, "_text", "_host")
    tagged = docs.select(F.struct("*").alias("doc"), F.col(text).alias(text_), F.col(host).alias(host_))
    # exploding keeps the verdict above the measures: a filter would be pushed below and work words out anew for each of them
    passed = F.when(~F.col("_m.base_failed"), F.array(F.struct("doc", F.col(host_).alias("host"))))
    good = measure(tagged, text_).select(F.explode(passed).alias("p")).select("p.*")
    return good.join(storage.broadcast_if_small(bad), "host", "left_anti").select("doc.*")
