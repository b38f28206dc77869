"""Exact top-k inner products by term-at-a-time accumulation.

Query rows and candidates are dealt into blocks of bounded size.  For each pair of a query block and
a candidate block, one task walks the terms (dimensions): a term's query weights and its posting
list (the candidates with a nonzero weight) scatter their products into a dense score array.  The
block's best k per query are selected by partition, and a window merges the blocks' selections.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUND = "query_id long, query_hash long, vec_id long, score long"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component as long; null if the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``width`` terms."""
    arr = col.combine_chunks()
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    n, flat = len(arr), arr.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(arr.offsets.to_numpy())
    out = np.zeros((n, width), np.int64)
    if (sizes == width).all():
        return flat.reshape(n, width)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), term by term.  A posting list that holds most candidates is
    scattered as a whole array, a short one through its indices.  Scores that could pass 2^63 raise an error."""
    bound = np.abs(q).sum(axis=1, dtype=float).max(initial=0) * float(np.abs(c).max(initial=0))
    if bound >= 2**63:
        raise OverflowError(f"inner products up to {bound:.3g} do not fit a long")
    kind = np.int32 if bound < 2**31 else np.int64
    acc = np.zeros((len(q), len(c)), kind)
    for t in range(q.shape[1]):
        rows, posting = np.flatnonzero(q[:, t]), np.flatnonzero(c[:, t])
        weights = c[posting, t].astype(kind)
        if len(posting) * 2 >= len(c):
            whole = c[:, t].astype(kind)
            for r in rows:
                acc[r] += kind(q[r, t]) * whole
        else:
            for r in rows:
                acc[r, posting] += kind(q[r, t]) * weights
    return acc


def _cell(k: int):
    def best(queries: pa.Table, cands: pa.Table) -> pa.Table:
        out = {n: [] for n in ("query_id", "query_hash", "vec_id", "score")}
        if queries.num_rows and cands.num_rows:
            cands = cands.sort_by("vec_id")
            width = max(int(queries["n"].to_numpy().max()), int(cands["n"].to_numpy().max()))
            ids = cands["vec_id"].to_numpy()
            qid, qh = queries["vec_id"].to_numpy(), queries["h"].to_numpy()
            scores = accumulate(_matrix(queries["v"], width), _matrix(cands["v"], width))
            for r in range(len(qid)):
                s, others = scores[r], np.flatnonzero(ids != qid[r])
                s = s[others]
                m = min(k, len(s))
                if not m:
                    continue
                edge = np.partition(s, len(s) - m)[len(s) - m]
                above = np.flatnonzero(s > edge)
                ties = np.flatnonzero(s == edge)[: m - len(above)]  # ids ascend: ties to the smaller
                take = others[np.concatenate([above, ties])]
                out["vec_id"].append(ids[take])
                out["score"].append(scores[r, take].astype(np.int64))
                out["query_id"].append(np.full(m, qid[r]))
                out["query_hash"].append(np.full(m, qh[r]))
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for n, v in out.items()})
    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = 512, cand_block: int = 8192) -> DataFrame:
    """``k`` best candidates of every query row: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and ``v`` (array of integers, null: the row takes no part); rows with
    ``is_query`` are queries, candidates are all rows of other ids.  Ties go to the smaller vec_id;
    with fewer than ``k`` candidates all are returned.  Vectors of different lengths are padded
    with zeros.  Rows with a null vec_id take no part; equal rows count once; rows of one id with
    different vectors are separate queries and candidates.  An empty table gives an empty result.
    Scores are longs: vectors whose products could reach 2^63 raise an error.
    Every (query block, candidate block) pair is one bounded group; block numbers follow the counts.
    """
    v = (vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.col("vec_id").cast("long"), "v")
         .withColumn("q", F.coalesce(is_query, F.lit(False))).dropDuplicates(["vec_id", "v"])
         .withColumns({"h": F.xxhash64("v"), "n": F.size("v")}))
    n, nq = v.agg(F.count("*"), F.count_if("q")).first()
    n_cb, n_qb = max(1, math.ceil(n / cand_block)), max(1, math.ceil(nq / query_block))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = v.where("q").withColumn("qb", F.pmod(F.xxhash64("vec_id", "h"), F.lit(n_qb)).cast("int")).withColumn("cb", each(n_cb))
    cands = v.withColumn("cb", F.pmod(F.xxhash64("vec_id", "h"), F.lit(n_cb)).cast("int")).withColumn("qb", each(n_qb))
    found = (queries.select("qb", "cb", "vec_id", "h", "n", "v").groupBy("qb", "cb")
             .cogroup(cands.select("qb", "cb", "vec_id", "n", "v").groupBy("qb", "cb"))
             .applyInArrow(_cell(k), FOUND))
    w = W.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
