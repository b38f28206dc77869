"""Small helpers shared by the operators: scratch tables, sampling of labelled rows, word splitting."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the characters \x20 and \x09-\x0D, for regular expressions of both engines.
SPACE = r"\x20\x09-\x0D"


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one named by ``spark.checkpoint.dir``.  Where that is
    unset, a private folder is made, but only for a local master: on a cluster others cannot see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/synthscore-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="synthscore-llm-"))
    return sc.getCheckpointDir()


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application.  Results that are not written yet read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared scratch and read it back: the lineage
    is cut and a lost executor costs a re-read of files, not a recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no model learns from: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, h, text, label) of the rows of at most ``limit`` labelled ids outside the held-out third;
    ``h`` is a hash of the text.

    The ids with the smallest hashes are taken, so the sample is the same in every run and does
    not depend on partitioning.  An id may have any number of rows: features are taken from them where
    they are read, and ``first_rows`` bounds what a fit sees.  Scoring covers all rows.
    """
    y = F.col(label).cast("int")
    rows = (labels.select("doc_id", y.alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return (docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(rows), "doc_id")
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text", "label"))


def first_rows(features: DataFrame, limit: int) -> DataFrame:
    """Of rows with doc_id and h at most ``limit``: equal rows count once, the first in the order of the
    ids' hashes and of h stay."""
    return features.dropDuplicates(["doc_id", "h"]).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(limit)


# words of letters, digits and every non-ASCII character, on lower-cased UTF-8
_TO_SPACE = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))


def lower_words(text: str) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def term_hashes(text: str, prefixes: tuple[int, ...] = (4, 5)) -> list[int]:
    """32-bit hashes of the distinct words and of the words' distinct beginnings (lengths in bytes),
    which carry over to inflected and compound forms that a sample does not hold."""
    words = set(lower_words(text))
    starts = {b"^" + w[:n] for n in prefixes for w in words if len(w) > n}
    return [zlib.crc32(w) for w in words | starts]


class WordHashes(dict):
    """word -> 64-bit hash.  Only a memo: it is emptied when full, which bounds its memory."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out + h[j:j + n])
    return out
