"""Quality rules with host-level verdicts (DataFrame functions only).

Per document the rule measures are computed inside the row (no explode, no
shuffle of text).  Rule failures are then summed per host, every host's
failure rate is shrunk towards the corpus by an empirical beta prior
(method of moments over the hosts), and a host whose shrunk rate passes
``host_limit`` takes all its documents with it.

Cases: a null text has no words (base_failed); a null host is a host of its
own; rows with equal or null ids are judged row by row; an empty table gives
no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, read, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
HAS_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the word array ``_w``: words covered by
    8-word windows that occur at least twice.  Window hashes are compared
    inside the row by sorting, only in rows where some window repeats."""
    i = list(range(1, WINDOW))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_g", F.when(
        F.size("_h") >= WINDOW,
        F.slice(F.transform("_h", lambda x, p: F.xxhash64(x, *[F.get("_h", p + k) for k in i])),
                1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda x, j: (F.get("_s", j - 1)["h"] == x["h"]) | (F.get("_s", j + 1)["h"] == x["h"])),
        lambda x: x["p"])))
    steps = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")).drop("_h", "_g", "_s", "_p")


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      host_col: str = "source") -> DataFrame:
    """Rule measures per row: id, host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("_t")
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                     text_of(text_col).alias("_t")).withColumn("_w", words(t))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD)))
    df = df.select(
        "doc_id", "host", "_w", F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"))
    df = _repeat_words(df).drop("_w")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(measures: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Per host: documents, failures of each rule, documents that fail any of
    them, shrunk failure rate and verdict.

    Prior: the hosts' rates have mean m and variance v; a beta distribution
    with these moments has strength ``m(1-m)/v - 1`` (at least 1, also where
    the variance is zero or there is one host)."""
    rules = {"few_words": F.col("n_words") < 20,
             "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
             "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
             "dup_lines": F.col("n_dup_lines") >= 3}
    failed = F.greatest(*[c.cast("int") for c in rules.values()])
    hosts = measures.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"),
        *[F.sum(c.cast("int")).alias(f"n_{k}") for k, c in rules.items()])
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    strength = F.greatest(F.lit(1.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
                          .otherwise(F.lit(1.0)))
    # The prior is one row: a nested-loop join with it adds two columns, no pairs.
    return hosts.join(F.broadcast(prior)).withColumn("_s", strength).withColumn(
        "host_rate", (F.col("n_failed") + F.col("m") * F.col("_s")) / (F.col("n_docs") + F.col("_s"))) \
        .withColumn("host_rejected", F.col("host_rate") > host_limit).drop("m", "v", "_s")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_limit: float = 0.5) -> DataFrame:
    """Measures joined with the verdict on the document's host."""
    m = cut(document_measures(docs, id_col, text_col, host_col))
    h = host_verdicts(m, host_limit).select(F.col("host").alias("_host"), "host_rate", "host_rejected")
    return m.join(h, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host") \
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op10_quality_rules(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host", F.round("host_rate", 6).alias("host_rate"))
