"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending id, four at least and more where a batch would pass
``batch_rows`` line hashes.  A batch's line hashes are anti-joined with the runs of all earlier batches;
the hashes that are new, with the smallest id that holds them, become a run of level 0.  Whenever a
level has ``fanout`` runs they are compacted into one run of the next level, which is what later
batches read.  Runs are bucketed tables, one sorted file per bucket, and are read in that order: an
anti-join neither shuffles nor sorts them.  A line of a batch stays where its document is the one its
hash came with.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, written

_WHITE = b" \t\n\x0b\x0c\r"
#: A null id sorts after all others.
_NO_ID = 2**63 - 1


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """Per line of the text (null: one empty line) the 128-bit hash of its key, None for keys of
    fewer than ``min_chars`` code points.  Key: ASCII white space stripped, A-Z lower-cased."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower() is A-Z only
        key = line.strip(_WHITE)
        n = len(key)
        if n < 4 * min_chars and (n < min_chars or n - sum(128 <= c < 192 for c in key) < min_chars):
            out.append(None)
        else:
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return out


@dataclass
class Runs:
    """Levels of sorted runs (hash, owner): an owner is the smallest id that holds the line."""

    spark: SparkSession
    buckets: int
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=list)
    read: list[int] = field(default_factory=list)  # the level of every run that a batch was joined with

    def __post_init__(self) -> None:
        # a bucket of one sorted file is read as sorted; Spark checks that it is one file
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _store(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash")
         .option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name))
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """The hashes of ``firsts`` that no run holds."""
        for level, runs in enumerate(self.levels):
            for run in runs:
                firsts = firsts.join(run.select("hash").hint("merge"), "hash", "left_anti")
                self.read.append(level)
        return firsts

    def add(self, firsts: DataFrame) -> DataFrame:
        """Add the hashes of ``firsts`` that no run holds; returns them."""
        firsts = self.unseen(firsts)
        new = self._store(firsts)
        self._put(new, 0)
        return new

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:  # compact: the runs' hashes are disjoint
            merged = self.levels[level][0]
            for r in self.levels[level][1:]:
                merged = merged.unionByName(r)
            self.levels[level] = []
            self._put(self._store(merged), level + 1)


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, batch_rows: int = 1_000_000_000,
                  runs: Runs | None = None) -> DataFrame:
    """(id, hashes): per document the hashes of the lines it loses.  One row per id that loses any.
    ``batches`` is the least number of batches; more are made so that one has about ``batch_rows`` line
    hashes at most.  ``runs`` may hold the runs of earlier documents, with smaller ids."""
    spark = docs.sparkSession
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))

    def hashed(parts):
        for b in parts:
            out_id, out_hash = [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                own = set(line_hashes(text, min_chars)) - {None}
                out_id += [i] * len(own)
                out_hash += own
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_hash, pa.binary())], ["id", "hash"])
    hashes = written(docs.select(ids.alias("id"), "text").mapInArrow(hashed, "id long, hash binary"), "line-hashes")
    batches = max(batches, math.ceil(hashes.count() / batch_rows))
    at = [k / batches for k in range(1, batches)]
    cuts = sorted({int(c) for c in (hashes.approxQuantile("id", at, 0.25 / batches) if at else None) or []})
    batch = sum([(F.col("id") > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    lines = hashes.withColumn("batch", batch)
    runs = runs or Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout)
    dropped = None
    for k in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == k).select("id", "hash")
        new = runs.add(own.groupBy("hash").agg(F.min("id").alias("owner")))
        lost = own.join(new, (own["hash"] == new["hash"]) & (own["id"] == new["owner"]), "left_anti")
        dropped = lost if dropped is None else dropped.unionByName(lost)
    return dropped.groupBy("id").agg(F.collect_set("hash").alias("hashes"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, batch_rows: int = 1_000_000_000) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and columns n_lines (before) and n_dropped.

    Keys of at least ``min_chars`` code points found in two or more documents lose all their lines
    except in the smallest doc_id that holds them; lines repeated inside one document stay.  Rows
    are never dropped; a null or empty text is one empty line and comes back empty.  Rows of one
    doc_id are one document; a null doc_id counts as the largest.  Other columns are passed on,
    but for earlier n_lines and n_dropped.  Whole texts of any length are read; an empty table gives
    an empty result.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    marked = docs.withColumn("__line_dedup_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    lost = dropped_lines(docs, min_chars, batches, fanout, batch_rows).select(F.col("id").alias("__line_dedup_id"), F.col("hashes").alias("__line_dedup_lost"))
    rows = marked.join(lost, "__line_dedup_id", "left").select(*keep, "text", "__line_dedup_lost")

    def cut(parts):
        for b in parts:
            texts, n_lines, n_dropped = [], [], []
            for text, lost_here in zip(b.column("text").to_pylist(), b.column("__line_dedup_lost").to_pylist()):
                lines = (text or "").split("\n")
                kept = lines
                if lost_here:
                    gone = set(lost_here)
                    kept = [x for x, h in zip(lines, line_hashes(text, min_chars)) if h not in gone]
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()),
                                              pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             [*keep, "text", "n_lines", "n_dropped"])
    schema = "".join(f"`{n}` {t}, " for n, t in docs.select(*keep).dtypes) + "text string, n_lines long, n_dropped long"
    return rows.mapInArrow(cut, schema)
