"""Quality rules from cross-document line frequency (DataFrame functions only).

Normalised lines are hashed, distinct documents are counted per (host, line), lines above the
limits are taken out, and documents that lose most of their words with them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def _n_repeat_words(placed: str) -> Column:
    """Words inside 3-word windows whose hash occurs at least twice.  ``placed`` names a column of
    (window hash g, position i) sorted by both; it must be a column, as an expression would be
    computed anew for every element of the lambda."""
    repeated = F.filter(F.transform(placed, lambda p, k: F.when(
        (F.get(F.col(placed), k - 1)["g"] == p["g"]) | (F.get(F.col(placed), k + 1)["g"] == p["g"]), p["i"])),
        lambda i: i.isNotNull())
    # a window covers three words, less those that the next repeated window covers too
    return F.aggregate(F.array_sort(repeated), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
                       lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")),
                       lambda a: a["n"])


def text_stats(docs: DataFrame) -> DataFrame:
    """Base statistics per row: doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    s = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"),
                    F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"))
    s = s.select("doc_id", "source", "text_hash", "n_symbols",
                 F.size("words").cast("long").alias("n_words"),
                 F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    s = s.withColumn("grams", F.when(F.col("n_words") >= 3, F.zip_with(
        F.zip_with(F.expr("slice(h, 1, size(h) - 2)"), F.expr("slice(h, 2, size(h) - 2)"), lambda a, b: F.xxhash64(a, b)),
        F.expr("slice(h, 3, size(h) - 2)"), lambda ab, c: F.xxhash64(ab, c))).otherwise(F.array().cast("array<bigint>")))
    s = s.withColumn("placed", F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.array_sort(
        F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    return s.select("doc_id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(_n_repeat_words("placed"), F.lit(0)).cast("long").alias("n_repeat_words"))


def document_lines(docs: DataFrame, host: str) -> DataFrame:
    """(host, line, doc_id, text_hash, n_words): words of each distinct normalised line of each document.
    Normalised: lower case, runs of white space as one space, ends stripped; blank lines are left out.
    ``line`` is the 64-bit hash.  Copies of one row fall together with their words added up."""
    norm = F.trim(F.regexp_replace(F.lower("raw"), f"[{SPACE}]+", " "))
    rows = (docs.where(F.col("text").isNotNull())
            .select(F.col(host).alias("host"), "doc_id", F.xxhash64("text").alias("text_hash"),
                    F.explode(F.split("text", "\n", -1)).alias("raw"))
            .select("host", "doc_id", "text_hash", norm.alias("norm")).where("norm != ''"))
    return (rows.select("host", "doc_id", "text_hash", F.xxhash64("norm").alias("line"),
                        (F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "))) + 1).alias("n_words"))
            .groupBy("host", "line", "doc_id", "text_hash").agg(F.sum("n_words").alias("n_words")))


def frequent_lines(lines: DataFrame, host_limit: int, corpus_limit: int) -> DataFrame:
    """(host, line) of lines in ``host_limit`` distinct documents of a host, however large the host is,
    and of lines in ``corpus_limit`` distinct documents of all hosts together, in every host that has
    them.  Counts are summed before the shuffle, so a line that most documents share is no hot key."""
    per_host = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    # a document that several hosts hold counts once
    spread = (lines.groupBy("line", "doc_id", "text_hash").agg(F.lit(1).alias("one"))
              .groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= corpus_limit))
    everywhere = per_host.join(spread, "line", "left_semi")
    return per_host.where(F.col("n") >= host_limit).unionByName(everywhere).select("host", "line").distinct()


def judge_documents(docs: DataFrame, host_limit: int = 20, corpus_limit: int = 100, min_left: float = 0.75,
                    min_words: int = 50, host: str = "source") -> DataFrame:
    """Base statistics, base rule and line-frequency verdict per document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    left_share (words that remain after frequent lines are taken out, as a share; null without
    words).  A line is frequent in a host where at least ``host_limit`` documents of the host hold it,
    and everywhere if at least ``corpus_limit`` documents hold it.  A document fails the base rule with
    fewer than ``min_words`` words or with more than half of them in repeated 3-word windows; it is
    also rejected when less than ``min_left`` of its words remain.  Null and empty texts have no words
    and fail.  Rows with a null ``host`` form one host.  Repeated rows get equal results and count as
    one document; a null doc_id counts as one id.  Texts of any length are read whole; an empty table
    gives an empty result; columns other than doc_id, text and ``host`` are ignored.
    """
    lines = written(document_lines(docs.select("doc_id", "text", host), host), "document-lines")  # read three times
    hot = frequent_lines(lines, host_limit, corpus_limit).withColumnRenamed("host", "h").withColumnRenamed("line", "l")
    lost = (lines.join(hot, lines["host"].eqNullSafe(hot["h"]) & (lines["line"] == hot["l"]), "left")
            .groupBy("host", "doc_id", "text_hash")
            .agg((F.sum(F.when(F.col("l").isNull(), F.col("n_words")).otherwise(0)) / F.sum("n_words")).alias("left_share")))
    lost = lost.select(F.col("host").alias("h"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "left_share")
    stats = text_stats(docs.select("doc_id", "text", F.col(host).alias("source")))
    out = stats.join(lost, (stats["text_hash"] == lost["t"]) & stats["doc_id"].eqNullSafe(lost["d"])
                     & stats["source"].eqNullSafe(lost["h"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.coalesce("left_share", F.lit(1.0)) >= min_left)).alias("kept"),
                      "left_share")
