"""Mixing sources to target weights by soft membership (DataFrame functions only).

A classifier learned from labelled rows (naive Bayes over hashed words) gives every document a
posterior over the domains.  A document of n tokens and posterior p adds rate * n * p[k] expected
tokens to domain k.  The least squares fit looks for the rates nearest to 1, none below a bound,
whose expected domain totals match the targets.  Its gradient steps are taken on one multiplier per
domain: a document's rate is the projection max(bound, 1 + p . u) of what the multipliers u ask for,
so no rate has to be stored between steps.  A step uses the second moments too (a Newton step), needs
one aggregation over all documents, and only a sum per domain and a domains x domains matrix reach
the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written


def _words(text: Column) -> Column:
    return F.split(F.lower(text), f"[{SPACE}]+")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = 20_000,
          buckets: int = 65_536, smoothing: float = 0.5) -> DataFrame:
    """(bucket, l0, l1, ...): log word probability per domain and hash bucket, plus bucket -1 with the
    log priors.  ``labelled`` has doc_id and domain; at most ``max_rows`` rows, those with the
    smallest id hashes, are learned from.  The result has at most ``buckets`` + 1 rows."""
    rows = (labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id")
            .agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    words = (docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
             .select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word != ''"))
    one = lambda k: (F.col("domain") == domains[k]).cast("long")
    ks = range(len(domains))
    counts = words.groupBy(_bucket(F.col("word"), buckets).alias("bucket")).agg(*[F.sum(one(k)).alias(f"c{k}") for k in ks])
    totals = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"t{k}") for k in ks])
    grid = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    likely = grid.join(counts, "bucket", "left").crossJoin(F.broadcast(totals)).select("bucket", *[  # totals: one row
        F.log((F.coalesce(f"c{k}", F.lit(0)) + smoothing) / (F.col(f"t{k}") + smoothing * buckets)).alias(f"l{k}") for k in ks])
    n = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(one(k)), F.lit(0)).alias(f"n{k}") for k in ks])
    priors = n.select(F.lit(-1).alias("bucket"), *[F.log((F.col(f"n{k}") + 1) / (F.col("n") + len(domains))).alias(f"l{k}") for k in ks])
    return written(likely.unionByName(priors), "domain-words")


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str], buckets: int = 65_536) -> DataFrame:
    """(doc_id, text_hash, rows, tokens, p0, p1, ...) per distinct row: words and domain posterior.

    The evidence is tempered by the root of the word count, so memberships of long documents stay
    soft.  Words are exploded and summed per document inside the scan's own stage; what is shuffled
    is one row per document.  Null and blank texts have no tokens and the prior as posterior.
    """
    ks = range(len(domains))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # element 0 is no word but the mark (bucket -1) that counts the row and brings the priors
    words = rows.select("doc_id", "text_hash", F.posexplode(F.concat(F.array(F.lit("")), F.coalesce(_words(F.col("text")), F.array()))).alias("i", "word"))
    words = words.where("i = 0 or word != ''").withColumn("bucket", F.when(F.col("i") == 0, F.lit(-1)).otherwise(_bucket(F.col("word"), buckets)))
    mark = F.col("i") == 0
    sums = words.join(F.broadcast(model), "bucket").groupBy("doc_id", "text_hash").agg(  # the model is bounded by its buckets
        F.count_if(mark).alias("rows"), F.count_if(~mark).alias("tokens"),
        *[F.sum(F.when(~mark, F.col(f"l{k}")).otherwise(0.0)).alias(f"s{k}") for k in ks],
        *[F.max(F.when(mark, F.col(f"l{k}"))).alias(f"q{k}") for k in ks])
    per = sums.withColumns({"tokens": (F.col("tokens") / F.col("rows")).cast("long")})
    z = [F.col(f"q{k}") + F.when(F.col("tokens") > 0, F.col(f"s{k}") / F.col("rows") / F.sqrt("tokens")).otherwise(0.0) for k in ks]
    per = per.select("doc_id", "text_hash", "rows", "tokens", *[c.alias(f"z{k}") for k, c in enumerate(z)])
    top = F.greatest(*[f"z{k}" for k in ks]) if len(domains) > 1 else F.col("z0")
    per = per.select("doc_id", "text_hash", "rows", "tokens", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in ks])
    norm = sum((F.col(f"e{k}") for k in ks), F.lit(0.0))
    return per.select("doc_id", "text_hash", "rows", "tokens", *[(F.col(f"e{k}") / norm).alias(f"p{k}") for k in ks])


def fit_rates(members: DataFrame, weights: list[float], total_tokens: float | None = None, steps: int = 100,
              tolerance: float = 1e-4, least: float = 0.0) -> tuple[Column, dict]:
    """Rates as a column over ``members``, and a report of targets and reached totals.

    The rates r >= ``least`` nearest to 1 (squares weighted by tokens) with A r = t: r = max(least, 1 + p . u).
    Every step moves u by the gradient A r - t in the metric of the second moments of the rows that the
    bound does not hold, halved until the dual objective falls; it is one aggregation whose sums are a
    number per domain and pair of domains.  ``total_tokens`` None: the smallest total that shrinks no
    domain, or with ``least`` 1 or more the total that needs the least change of the rates.  The report
    says whether the tolerance was ``converged`` to; targets outside the span of the memberships are not.
    """
    ks = range(len(weights))
    mass = F.col("rows") * F.col("tokens")
    p = [F.col(f"p{k}") for k in ks]
    share = np.array(weights, float) / sum(weights)
    free = total_tokens is None and least >= 1  # the total follows: share . u = 0

    def at(u: np.ndarray) -> tuple[Column, np.ndarray, np.ndarray, float]:
        line = F.lit(1.0) + sum((p[k] * float(u[k]) for k in ks), F.lit(0.0))
        rate, loose = F.greatest(F.lit(float(least)), line), line >= least
        cost = F.when(loose, line * line / 2).otherwise(least * least / 2 + least * (line - least))
        total = lambda c: F.coalesce(F.sum(mass * c), F.lit(0.0))
        sums = members.agg(*[total(rate * p[k]) for k in ks], total(cost),
                           *[total(F.when(loose, p[j] * p[k]).otherwise(0.0)) for j in ks for k in ks]).first()
        return rate, np.array(sums[:len(ks)]), np.array(sums[len(ks) + 1:]).reshape(len(ks), -1), sums[len(ks)]

    u = np.zeros(len(ks))
    rate, reached, moment, cost = at(u)
    have = reached if least <= 1 else np.array(members.agg(*[F.coalesce(F.sum(mass * p[k]), F.lit(0.0)) for k in ks]).first())
    held = np.where(share > 0, have / np.maximum(share, 1e-12), 0.0)
    goal = held.max() if total_tokens is None else total_tokens
    target = share * (reached.sum() if free else goal)
    near = lambda: np.abs(reached - target).max() <= tolerance * max(1.0, target.max())
    taken, stuck = 1, False
    while taken < steps and not near() and not stuck and moment.any():
        if free:
            unit = np.trace(moment)  # tokens and shares in one scale, or the shares' row counts as zero
            system = np.block([[moment / unit, -share[:, None]], [share[None, :], np.zeros((1, 1))]])
            move = np.linalg.lstsq(system, np.append(-reached / unit, -share @ u), rcond=1e-12)[0][:-1]
        else:
            move = np.linalg.lstsq(moment, target - reached, rcond=1e-12)[0]
        slope = float((reached - target) @ move)
        length, stuck = 1.0, slope >= 0
        while taken < steps and not stuck:
            new = at(u + length * move)
            taken += 1
            fall = new[3] - cost - (0.0 if free else length * float(target @ move))
            if fall <= 1e-4 * length * slope + 1e-12 * abs(cost):
                u = u + length * move
                rate, reached, moment, cost = new
                target = share * (reached.sum() if free else goal)
                break
            length /= 2
            stuck = length < 1e-6
    return rate, {"before": have.tolist(), "target": target.tolist(), "reached": reached.tolist(), "steps": taken,
                  "converged": bool(near())}


def fit_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total_tokens: float | None = None,
            keep_all: bool = True, max_rows: int = 20_000, seed: int = 11) -> tuple[DataFrame, dict]:
    """Rate and number of copies of every distinct row: doc_id, text_hash, rows, tokens, p_<domain>...,
    rate, copies; and the report of ``fit_rates``.

    ``copies`` rounds the rate up with the probability of its fraction, by a hash of the row, so
    expected totals are kept; with ``keep_all`` rates are fitted at 1 or more, so that no row falls
    out.  Empty tables give no rows; null and blank texts have no tokens, and a rate like others of
    their posterior.
    """
    domains = sorted(targets)
    model = train(docs, labelled, domains, max_rows)
    members = written(posteriors(docs, model, domains), "memberships")
    rate, report = fit_rates(members, [targets[d] for d in domains], total_tokens, least=1.0 if keep_all else 0.0)
    out = members.withColumn("rate", rate)
    u = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.lit(2**30)) / F.lit(float(2**30))
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return out.select("doc_id", "text_hash", "rows", "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)],
                      "rate", copies.alias("copies")), report


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total_tokens: float | None = None,
        keep_all: bool = True, max_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """The rows of ``fit_mix`` and ``converged``, the same in every row: whether the rates reach the
    targets.  Where they do not, it warns with the report; the rates are then the last step's."""
    out, report = fit_mix(docs, labelled, targets, total_tokens, keep_all, max_rows, seed)
    if not report["converged"]:
        warnings.warn(f"the memberships were not mixed to the targets: {report}", RuntimeWarning, stacklevel=2)
    return out.withColumn("converged", F.lit(bool(report["converged"])))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs``, every row repeated as often as ``mixed`` says."""
    m = mixed.select(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_text"), F.col("copies").alias("__mix_copies"))
    rows = docs.join(m, docs["doc_id"].cast("long").eqNullSafe(m["__mix_id"]) & (F.xxhash64(docs["text"]) == m["__mix_text"]))
    return rows.where("__mix_copies > 0").select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_n")).drop("__mix_n")
