"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words' 32-bit hashes.  The machine has a weight and a short vector per
term; the inner products of the vectors are weights of term pairs, so a pair can count for more, or
less, than its terms do alone.  It learns from a bounded sample and scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_rows, held_out, labelled_sample, term_hashes


@dataclass(frozen=True)
class FactorizationMachine:
    terms: np.ndarray  # sorted uint32 hashes
    bias: float
    w: np.ndarray  # weight per term
    v: np.ndarray  # terms x factors

    def score(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        """Probability per row, for the (row, term index) cells that are set."""
        z = self.bias + np.bincount(row, self.w[col], n)
        for f in range(self.v.shape[1]):
            x = self.v[col, f]
            z += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def cells(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else np.empty(0, np.uint32)
        at = np.searchsorted(self.terms, flat)
        hit = np.flatnonzero(at < len(self.terms))
        hit = hit[self.terms[at[hit]] == flat[hit]]
        return np.repeat(np.arange(len(docs)), sizes)[hit], at[hit]


def signed_terms(docs: list[np.ndarray], y: np.ndarray, min_docs: int) -> np.ndarray:
    """The terms in ``min_docs`` rows or more that tell the classes apart on their own, by chi-squared."""
    flat = np.concatenate([*docs, np.empty(0, np.uint32)])
    terms, at = np.unique(flat, return_inverse=True)
    df = np.bincount(at, minlength=len(terms)).astype(float)
    pos = np.bincount(at, np.repeat(y, [len(d) for d in docs]).astype(float), len(terms))
    n, p = float(len(y)), float(y.sum())
    chi = n * (pos * n - df * p) ** 2 / np.maximum(df * (n - df) * p * (n - p), 1e-9)
    return terms[(df >= min_docs) & (chi > 3.84)]  # 5 % level: others carry no sign of the class


def _descend(fm: FactorizationMachine, docs: list[np.ndarray], y: np.ndarray, steps: int, rate: float, l2: float,
             shared: bool):
    """The machine after each step of full-batch Adam on the logistic loss.  ``shared``: one step size for
    all weights and one for all vectors, so that a term moves by its gradient and rare terms by little."""
    n, (m, factors) = len(y), fm.v.shape
    blocks = [fm.cells(docs[i:i + 1000]) for i in range(0, n, 1000)]
    row = np.concatenate([(r + 1000 * i).astype(np.int32) for i, (r, _) in enumerate(blocks)])
    col = np.concatenate([c.astype(np.int32) for _, c in blocks])
    del blocks
    by_col = row[np.argsort(col, kind="stable")]
    size, width = np.bincount(col, minlength=m), np.bincount(row, minlength=n)
    terms, full = np.flatnonzero(size), np.flatnonzero(width)  # terms with cells, rows with cells
    term_at, row_at = np.cumsum(size)[terms] - size[terms], np.cumsum(width)[full] - width[full]
    theta = np.concatenate([[fm.bias], np.column_stack([fm.w, fm.v]).ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros(3) if shared else np.zeros_like(theta)
    kind = np.concatenate([[0], np.tile([1, *[2] * factors], m)])
    for step in range(1, steps + 1):
        p = theta[1:].reshape(m, factors + 1)
        z, sums = np.full(n, theta[0]), np.zeros((n, factors))
        if len(row):
            z[full] += np.add.reduceat((p[:, 0] - 0.5 * (p[:, 1:] ** 2).sum(axis=1))[col], row_at)
            for f in range(factors):  # one factor at a time bounds the memory
                sums[full, f] = np.add.reduceat(p[:, f + 1].copy()[col], row_at)
        z += 0.5 * (sums**2).sum(axis=1)
        d = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.zeros_like(p)
        if len(row):
            g[terms, 0] = np.add.reduceat(d[by_col], term_at)
            for f in range(factors):
                g[terms, f + 1] = np.add.reduceat((d * sums[:, f])[by_col], term_at)
        g[:, 1:] += (10 * l2 - g[:, :1]) * p[:, 1:]
        g[:, 0] += l2 * p[:, 0]
        g = np.concatenate([[d.sum()], g.ravel()])
        m1 = 0.9 * m1 + 0.1 * g
        size = np.array([g[0] ** 2, *(np.abs(g[kind == k]).max() ** 2 for k in (1, 2))]) if shared else g * g
        m2 = 0.999 * m2 + 0.001 * size
        scale = np.sqrt(m2 / (1 - 0.999**step)) + 1e-8
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (scale[kind] if shared else scale)
        p = theta[1:].reshape(m, factors + 1)
        yield FactorizationMachine(fm.terms, float(theta[0]), p[:, 0], p[:, 1:])


def known_terms(docs: list[np.ndarray], min_docs: int) -> np.ndarray:
    """All terms in ``min_docs`` rows or more, whether or not they carry a sign of the class alone."""
    terms, df = np.unique(np.concatenate([*docs, np.empty(0, np.uint32)]), return_counts=True)
    return terms[df >= min_docs].astype(np.uint32)


def _start(docs, y, terms, min_docs, factors, steps, rate, l2, seed, spread) -> FactorizationMachine:
    """A machine over all ``terms`` in which those that tell the classes apart on their own are fitted;
    the others have no weight and random vectors of size ``spread``."""
    signed = signed_terms(docs, y, min_docs).astype(np.uint32)
    share, rng = y.mean(), np.random.default_rng(seed)
    fm = FactorizationMachine(signed, float(np.log(share / (1 - share))), np.zeros(len(signed)), rng.normal(0, 0.05, (len(signed), factors)))
    if len(signed):
        for fm in _descend(fm, docs, y, steps, rate, l2, shared=False):
            pass
    w, v = np.zeros(len(terms)), rng.normal(0, 1, (len(terms), factors)) * spread
    known = np.isin(signed, terms)  # a fit on fewer rows may know terms that are rare in them
    at = np.searchsorted(terms, signed[known])
    w[at], v[at] = fm.w[known], fm.v[known]
    return FactorizationMachine(terms, fm.bias, w, v)


def _loss(fm: FactorizationMachine, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> float:
    s = np.clip(fm.score(row, col, len(y)), 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn the log odds ``z`` of rows a machine has not learned from into
    probabilities: a logistic fit with targets a little inside 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal, x = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.array([1.0, 0.0])
    line = lambda v: np.clip(v[0] * z + v[1], -500, 500)
    loss = lambda v: float((np.logaddexp(0, line(v)) - goal * line(v)).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-line(x)))
        q, d = p * (1 - p) + 1e-9, p - goal
        move = np.linalg.solve(np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-6 * np.eye(2),
                               np.array([(d * z).sum(), d.sum()]))
        step = 1.0
        while loss(x - step * move) > loss(x) and step > 1e-6:
            step /= 2
        x = x - step * move
        if np.abs(step * move).max() < 1e-8:
            break
    a, c = x
    return (float(a), float(c)) if np.isfinite(a + c) and a > 0 else (1.0, 0.0)


def fit(docs: list[np.ndarray], y: np.ndarray, min_docs: int = 3, factors: int = 4,
        steps: int = 300, rate: float = 0.05, l2: float = 1e-4, seed: int = 7, patience: int = 40) -> FactorizationMachine:
    """Weights and vectors of all terms in ``min_docs`` rows or more.

    The terms with a sign of their own, however many, are fitted first; from there all terms are fitted
    together, so that a pair is found whose terms say nothing one by one.  As many steps are taken as
    lower the loss of every fifth row, held back for that.  The scores are calibrated by the log odds that
    rows of three such folds get from machines that have not seen them.  Then all rows are learned from.  Without both classes the score is the share of toxic rows.
    """
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    terms = known_terms(docs, min_docs) if 0 < y.sum() < len(y) else np.empty(0, np.uint32)
    if not len(terms):
        return FactorizationMachine(terms, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    how = (min_docs, factors, steps, rate, l2, seed)
    taken, seen = 0, []
    for j in range(3):
        back = np.arange(len(y)) % 5 == j
        if not (0 < y[back].sum() < back.sum() and 0 < y[~back].sum() < (~back).sum()):
            continue
        learn, own = [x for x, b in zip(docs, back) if not b], y[~back]
        fm = _start(learn, own, terms, *how, spread=0.01 if not j or taken else 0.0)
        row, col = fm.cells([x for x, b in zip(docs, back) if b])
        odds = lambda m: np.log((s := np.clip(m.score(row, col, int(back.sum())), 1e-9, 1 - 1e-9)) / (1 - s))  # noqa: B023, E731
        least, z = _loss(fm, row, col, y[back]), odds(fm)
        for k, fm in enumerate(_descend(fm, learn, own, taken if j else steps, rate, l2, shared=True) if taken or not j else (), 1):
            loss = _loss(fm, row, col, y[back])
            if j:
                z = odds(fm)
            elif loss < least:
                taken, least, z = k, loss, odds(fm)
            elif k - taken >= patience:
                break
        seen.append((z, y[back]))
    slope, shift = calibration(*map(np.concatenate, zip(*seen))) if seen else (1.0, 0.0)
    fm = _start(docs, y, terms, *how, spread=0.01 if taken else 0.0)
    for fm in _descend(fm, docs, y, taken, rate, l2, shared=True) if taken else ():
        pass
    says = (fm.w != 0) | fm.v.any(axis=1)  # the rest add nothing to a score
    return FactorizationMachine(fm.terms[says], slope * fm.bias + shift, slope * fm.w[says], np.sqrt(slope) * fm.v[says])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, **params) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out third."""
    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), b.column("label").cast(pa.int32()),
                 pa.array([np.array(term_hashes(t), np.uint32).tobytes() for t in b.column("text").to_pylist()], pa.binary())],
                ["doc_id", "h", "label", "terms"])
    sample = labelled_sample(docs, labels, label, max_rows).mapInArrow(hashed, "doc_id long, h long, label int, terms binary")
    sample = first_rows(sample, max_rows).select("label", "terms").toPandas()
    # equal rows in equal order, whatever the partitioning
    sample = sample.sort_values(["label", "terms"], kind="stable")
    return fit([np.frombuffer(t, np.uint32) for t in sample["terms"]], sample["label"].to_numpy(float), **params)


def score_documents(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Null and empty texts have no terms: they
    get the score of the bias alone.  A null doc_id is not held out.  Repeated rows stay."""
    def scored(batches):
        for b in batches:
            terms = [np.array(term_hashes(t or ""), np.uint32) for t in b.column("text").to_pylist()]
            row, col = model.cells(terms)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(row, col, len(terms)))], ["doc_id", "score"])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
