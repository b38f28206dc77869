"""Centroid clustering of integer vectors by bit planes.

Vectors of 64 integer components are shifted to be non-negative and cut into bit planes: plane b holds
bit b of all 64 components in one 64-bit word.  A dot product is the sum over pairs of planes of
2^(a + b) * popcount(plane a of the vector AND plane b of the centroid), and a squared distance is
|v|^2 + |c|^2 - 2 v.c: all exact integers.  The planes are written once; every round reads them, and
only counts and component sums per centroid leave a task, summed before they reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 64
#: Components below this bound in size keep every squared distance below 2^62.
BOUND = 2**27


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null for a vector that is null, has not exactly
    64 components, or holds a null or non-finite one.  Larger results than a long fail."""
    ok = (F.size(vector) == WIDTH) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows x 64) integers in [-2^(planes-1), 2^(planes-1)) -> (rows x planes) words; component 0 is
    the highest bit of a word."""
    shifted = values + (1 << planes - 1)
    bits = (shifted[:, None, :] >> np.arange(planes)[:, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The integers of ``pack``."""
    planes = words.shape[1]
    bits = np.unpackbits(words.astype(">u8")[:, :, None].view(np.uint8), axis=2)
    return np.einsum("rpc,p->rc", bits, 1 << np.arange(planes, dtype=np.int64), dtype=np.int64) - (1 << planes - 1)


def dots(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Dot product of every row of plane words with one centroid's plane words (or row by row)."""
    out = np.zeros(len(words), np.int64)
    for a in range(words.shape[1]):
        for b in range(centre.shape[-1]):
            out += np.bitwise_count(words[:, a] & centre[..., b]).astype(np.int64) << a + b
    return out


def nearest(words: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller number) and the squared distance to it."""
    own, away = dots(words, words), dots(centres, centres)
    best, which = np.full(len(words), np.iinfo(np.int64).max), np.zeros(len(words), np.int32)
    for c in range(len(centres)):
        d = own + away[c] - 2 * dots(words, centres[c])
        closer = d < best
        best[closer], which[closer] = d[closer], c
    return which, best


def _words(col: pa.Array, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, planes)


def _planes(vectors: DataFrame, planes: int) -> DataFrame:
    def packed(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            words = pack(v, planes)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "words"])
    return written(vectors.mapInArrow(packed, "vec_id long, words binary"), "bit-planes")


def _round(rows: DataFrame, centres: np.ndarray, planes: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; empty ones stay."""
    words = pack(centres, planes)

    def summed(batches):
        count, total = np.zeros(len(words), np.int64), np.zeros((len(words), WIDTH), np.int64)
        for b in batches:
            if b.num_rows:
                own = _words(b.column("words"), planes)
                which, _ = nearest(own, words)
                count += np.bincount(which, minlength=len(words))
                order = np.argsort(which, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
                total[which[order][at]] += np.add.reduceat(unpack(own)[order], at, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "total"])
    parts = rows.select("words").mapInArrow(summed, "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(WIDTH)])
    out = centres.copy()
    for r in sums.collect():  # one row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(WIDTH)]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``; rows without an id come last,
    rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, WIDTH)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row of ``vectors`` (vec_id, ``v``: 64 longs, null: takes no
    part), and the final centroids.

    Centroids start as ``first_centroids``; with fewer vectors than ``k`` all are centroids.  Every
    round assigns each vector to the nearest centroid (squared Euclidean distance, ties to the smaller
    number) and moves every centroid that has vectors to the floor of their mean.  Repeated rows and
    rows with a null vec_id are vectors like others.  Components of 2^27 or more in size raise an
    error, as distances could pass a long.  An empty table gives an empty result.  Other columns are
    ignored.  The driver holds the k centroids alone.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where(F.col("v").isNotNull())
    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if low is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, WIDTH), np.int64)
    if low <= -BOUND or high >= BOUND:
        raise OverflowError(f"components from {low} to {high}: bit planes take less than {BOUND} in size")
    planes = max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0) + 1
    rows, centres = _planes(kept, planes), first_centroids(kept, k, seed)
    for _ in range(rounds):
        centres = _round(rows, centres, planes)
    words = pack(centres, planes)

    def assigned(batches):
        for b in batches:
            which, far = nearest(_words(b.column("words"), planes), words)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), pa.array(far, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    return rows.mapInArrow(assigned, "vec_id long, cluster int, distance long"), centres


def with_digest(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (distances summed per cluster and in all; an error beyond a long)
    and centroid_sha256 (of the centroid's components as decimals joined by commas)."""
    rows = written(assigned, "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row per centroid
    per = {r["cluster"]: int(r["s"]) for r in sums}
    total = sum(per.values())
    if total >= 2**63:
        raise OverflowError("the inertia passes a long")
    digest = [(c, per.get(c, 0), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres.tolist())]
    side = rows.sparkSession.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
