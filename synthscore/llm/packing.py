"""Best-fit packing by patterns: non-negative least squares on the histogram of piece lengths.

Texts become token pieces of at most ``size``.  Patterns of one to three length classes that fill a
sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what remains, with all short pieces, goes best-fit into the gaps and
into new sequences.  Plan and histogram are bounded by ``size``, not by the corpus: only counts per
length reach the driver.  Pieces get their places by their rank among pieces of equal length.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(tokenizer: str):
    """text -> ids by the byte-level BPE file ``tokenizer`` (its .tiktoken twin, if present, gives the
    same ids faster; texts that spell a special token are left to the file itself)."""
    import os

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    ranks = tokenizer.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    return lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: only longer ones are cut; the first piece takes the remainder."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    def cut(batches):
        encode = encoder(tokenizer)
        for b in batches:
            rows, ids = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                all_ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (at, n) in enumerate(piece_bounds(len(all_ids), size)):
                    own = all_ids[at:at + n]
                    rows.append((doc, k, at, n, zlib.crc32(own.tobytes())))
                    if keep_ids:
                        ids.append(own.astype(np.int64))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(cut, PIECE + (", ids array<long>" if keep_ids else "")))


def nnls(a: np.ndarray, b: np.ndarray, max_steps: int = 1000) -> np.ndarray:
    """min |a x - b| with x >= 0, by active sets: the column with the steepest gradient comes in,
    columns that would turn negative go out."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * len(b)
    for _ in range(max_steps):
        grad = a.T @ (b - a @ x)
        grad[inside] = -np.inf
        if not len(grad) or grad.max() <= tol:
            break
        inside[int(grad.argmax())] = True
        while True:
            cols = np.flatnonzero(inside)
            s = np.linalg.solve(a[:, cols].T @ a[:, cols] + 1e-9 * np.eye(len(cols)), a[:, cols].T @ b)
            if (s > 0).all():
                x[:] = 0
                x[cols] = s
                break
            low = s <= 0
            step = (x[cols][low] / np.maximum(x[cols][low] - s[low], 1e-300)).min()
            x[cols] += step * (s - x[cols])
            out = cols[(x[cols] <= 1e-9) & low]
            x[out], inside[out] = 0, False
    return x


def class_patterns(classes: int, least: int) -> list[tuple[int, ...]]:
    """Up to three classes, each ``least`` or more, whose sum is ``classes``."""
    two = [(a, classes - a) for a in range(least, classes // 2 + 1)]
    three = [(a, b, classes - a - b) for a in range(least, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return [(classes,)] + two + three


def plan(histogram: dict[int, int], size: int, classes: int = 256) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, repeats) for all pieces of the histogram (length -> count)."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    groups: dict[tuple[int, ...], int] = Counter()
    if left[size]:
        groups[(size,)] += left.pop(size)
    unit = max(1, size // classes)
    classes, short = size // unit, max(1, size // unit // 16)
    of_class = defaultdict(list)
    for n in sorted(left):
        of_class[math.ceil(n / unit)].append(n)
    count = np.array([sum(left[n] for n in of_class[c]) for c in range(classes + 1)], float)
    count[:short + 1] = 0  # short pieces are for the gaps
    patterns = class_patterns(classes, short + 1)
    a = np.zeros((classes + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            a[c, j] += 1
    scale = max(1.0, count.max(initial=0))
    repeats = np.floor(nnls(a, count / scale) * scale + 1e-6).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[j])
        while todo > 0:  # the longest members of each class first, as long as the same lengths serve
            take = Counter()
            try:
                lengths = []
                for c in patterns[j]:
                    n = next(n for n in reversed(of_class[c]) if left[n] > take[n])
                    take[n] += 1
                    lengths.append(n)
            except StopIteration:
                break
            r = min([todo, *(left[n] // k for n, k in take.items())])
            groups[tuple(lengths)] += r
            for n, k in take.items():
                left[n] -= r * k
            todo -= r
    # best fit, longest first, into the smallest gap that holds a piece
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(Counter)
    for g, r in groups.items():
        gaps[size - sum(g)][g] += r
    for n in sorted((n for n in left if left[n]), reverse=True):
        todo = left[n]
        for gap in range(n, size):
            here = gaps[gap] if gap in gaps else {}
            while todo and here:
                g, r = next(iter(here.items()))
                each = min(gap // n, todo)
                used = min(r, todo // each)
                del here[g]
                if r > used:
                    here[g] = r - used
                gaps[gap - each * n][g + (n,) * each] += used
                todo -= used * each
            if not todo:
                break
        each = size // n
        if todo >= each:
            gaps[size - each * n][(n,) * each] += todo // each
        if todo % each:
            gaps[size - (todo % each) * n][(n,) * (todo % each)] += 1
    return [(g, r) for at in sorted(gaps) for g, r in sorted(gaps[at].items()) if r]


def slots(packing: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of places by (length, first rank): the piece of rank first + i goes to sequence + i at offset."""
    rows, used, sequence = [], Counter(), 0
    for lengths, r in packing:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += r
            offset += n
        sequence += r
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "sequence", "offset"))}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False,
         bucket_rows: int = 50_000) -> DataFrame:
    """Pack all rows into sequences of at most ``size`` tokens.

    A document is its ids and ``end_id``; only longer ones are cut, the first piece taking the
    remainder.  Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids).  Null and empty texts are the end id alone; repeated rows and null ids are packed like
    others.  The pieces are written once to the shared scratch folder, so texts are tokenised once.
    Ranks are counted in buckets of about ``bucket_rows`` pieces, so a length that most pieces
    share is no hot group.
    """
    own = written(pieces(docs, tokenizer, size, end_id, keep_ids), "pieces")
    total = own.count()
    n_buckets = max(1, math.ceil(total / bucket_rows))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    counts = own.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    place = slots(plan(histogram, size))
    high = np.int64(2**40)
    keys = place["length"] * high + place["first"]

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def placed(batches):
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy() * high + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(place["sequence"][at] + rank - place["first"][at]), pa.array(place["offset"][at])],
                [*kept, "sequence_id", "offset"])
    by = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (own.withColumn("in_bucket", F.row_number().over(by) - 1).join(before, ["length", "bucket"])
              .select(*kept, (F.col("before") + F.col("in_bucket")).alias("rank")))
    return ranked.mapInArrow(placed, PIECE + (", ids array<long>" if keep_ids else "") + ", sequence_id long, offset long")
