"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete binary trees of one depth, kept as arrays (feature, threshold, leaf value),
so a batch of documents walks all trees with a few numpy operations per level.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_rows, held_out, labelled_sample

# byte classes of UTF-8 text
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SHOUT, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _chars, _kind in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b" \t\n\r\x0b\x0c", _SPACE),
                      (b".,;:'\"()-?", _STOP), (b"!", _SHOUT), (range(128, 256), _OTHER)):
    _CLASS[list(_chars)] = _kind

STATS = ("n_words", "word_length", "upper", "digit", "stop", "shout", "symbol", "other", "distinct", "top_word",
         "repeats", "bigrams", "line_length", "repeated_lines", "newlines")


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of ``STATS``; zeros for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * len(STATS)
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    return [np.log1p(n), (size - c[_SPACE] * size) / n, c[_UPPER], c[_DIGIT], c[_STOP], c[_SHOUT], c[_SYMBOL], c[_OTHER],
            len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / pairs,
            len(set(zip(words, words[1:]))) / pairs, np.log1p(size / len(lines)), 1 - len(set(lines)) / len(lines), len(lines) / n]


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where x > cut
    leaf: np.ndarray  # trees x leaves
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += leaf[at - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2,
        l2: float = 1.0, min_rows: float = 10.0) -> Trees:
    """Newton boosting of the logistic loss.  Cuts are quantiles of the sample; per level one
    histogram of gradients per feature gives every node's best cut."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    bias, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not 0 < y.sum() < len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = [np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T)]  # bin b: cuts[b-1] < x <= cuts[b]
    z, features, values, leaves = np.full(len(y), bias), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gain, pick = np.full(nodes, 1e-6), np.full((nodes, 2), -1)
            for f, b in enumerate(binned):
                k = len(cuts[f]) + 1
                cell = (at - first) * k + b
                gl, hl, nl = (np.bincount(cell, w, nodes * k).reshape(nodes, k).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                value = (gl**2 / (hl + l2) + (gt - gl)**2 / (ht - hl + l2) - gt**2 / (ht + l2))
                value[(nl < min_rows) | (nt - nl < min_rows)] = 0
                best = value[:, :-1].argmax(axis=1) if k > 1 else np.zeros(nodes, np.int64)
                v = value[np.arange(nodes), best]
                better = v > gain
                gain[better], pick[better, 0], pick[better, 1] = v[better], f, best[better]
            for i, (f, b) in enumerate(pick):
                if f >= 0:
                    feature[first + i], cut[first + i] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + l2)
        z += leaf[at - inner]
        features.append(feature)
        values.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(values), np.array(leaves), bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **params) -> Trees:
    """Fit on at most ``max_rows`` labelled rows outside the held-out third."""
    def measured(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("label").cast(pa.int32()), *map(pa.array, x.T.copy())],
                                             ["doc_id", "h", "label", *STATS])
    schema = "doc_id long, h long, label int, " + ", ".join(f"{s} double" for s in STATS)
    sample = first_rows(labelled_sample(docs, labels, label, max_rows).mapInArrow(measured, schema), max_rows).drop("doc_id", "h").toPandas()
    sample = sample.sort_values(list(sample.columns), kind="stable")  # equal sums whatever the partitioning
    return fit(sample[list(STATS)].to_numpy(), sample["label"].to_numpy(float), **params)


def score_documents(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` that are asked for by name are kept: see ``score_rows``.  Returns
    doc_id, held_out, score, predicted for every row; null and empty texts are scored with zero
    statistics, a null doc_id is not held out, repeated rows stay."""
    out = score_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_rows(docs: DataFrame, model: Trees, keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``score``; ``text`` may be left out of the result."""
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != "text")]

    def scored(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(model.score(x))], [*kept, "score"])
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes) + ", score double"
    return docs.mapInArrow(scored, schema)
