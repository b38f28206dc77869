"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are compared without white space.  Rows are grouped by the length of what is left; only rows
that share it are grouped by a hash of the first characters; only rows that share both are hashed in
full, where they are read.  No text is shuffled.  The second reading knows the surviving groups by a
bitmap of fixed size: it may let a lone text through, which costs one more hash, but misses none.
All decisions are grouped aggregations over short rows; copies of a text are dealt out by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import with_totals
from .common import SPACE, written

#: Bits of the bitmap (16 MB): a proven bound on what is broadcast.
SLOTS = 2**27


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _measured(docs: DataFrame, prefix: int) -> DataFrame:
    norm = normalised(F.col("text"))
    return docs.select(F.col("doc_id"), "text").select(
        "doc_id", norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.length(norm).alias("size"), F.xxhash64(F.substring(norm, 1, prefix)).alias("head"))


def _slot() -> Column:
    return F.pmod(F.xxhash64("size", "head"), F.lit(SLOTS)) + 1


def shared_prefixes(docs: DataFrame, prefix: int = 64) -> DataFrame:
    """(size, head) of the groups of two rows or more: first by length, then by prefix hash."""
    rows = written(_measured(docs, prefix).select("size", "head"), "sizes")
    rows = rows.withColumn("tag", F.col("head"))
    same_size = with_totals(rows, ["size"], "tag", {"n": (F.count("*"), F.sum)}).where("n > 1")
    return same_size.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head")


def fully_hashed(docs: DataFrame, prefix: int = 64, hash_all: bool = False) -> DataFrame:
    """(uid, doc_id, n_chars, alone, digest) of every row: sha256 of the whole text for rows whose
    length and prefix hash come twice, null for the others (with ``hash_all`` for those too)."""
    shared = shared_prefixes(docs, prefix)
    bitmap = (shared.select(F.bitmap_bucket_number(_slot()).alias("bucket"), F.bitmap_bit_position(_slot()).alias("bit"))
              .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    rows = _measured(docs, prefix).withColumns({"bucket": F.bitmap_bucket_number(_slot()), "bit": F.bitmap_bit_position(_slot())})
    rows = rows.join(F.broadcast(bitmap), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    out = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", (~met).alias("alone"),
                      (digest if hash_all else F.when(met, digest)).alias("digest"))
    return written(out, "digests")


def duplicates(docs: DataFrame, prefix: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty.  Of equal texts
    the row with the most code points in the original text stays, then the smallest doc_id (a null
    doc_id comes last), then one of the rows that are still equal: ``kept`` is true once per group.
    ``keep_id`` is the doc_id of that row.  ``text_sha256`` is the hash of the whole text without
    white space, null where no other text shared length and prefix (``hash_all``: there too).  Empty
    texts are a group like others; whole texts of any length count.  An empty table gives an empty
    result.  Only doc_id and text are read; other columns are ignored.
    """
    rows = fully_hashed(docs, prefix, hash_all)
    best = F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("uid"))
    grouped = with_totals(rows.where("not alone"), ["digest"], "uid", {"group_size": (F.count("*"), F.sum), "best": (F.min(best), F.min)})
    lone = rows.where("alone").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                      F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    return grouped.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"),
                          F.col("digest").alias("text_sha256")).unionByName(lone)
