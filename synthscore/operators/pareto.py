"""Non-dominated trials per study (fidelity up, utility up, privacy risk down).

A trial is dominated when another trial of its study is at least as good on all three scores and
better on one.  Exact, as a distributed sort-filter skyline:

1. each study's trials are spread over hash blocks of at most ``block`` rows and every block keeps its
   own skyline (a skyline point is never dominated inside its block, so nothing is lost);
2. the survivors are cut into ranges of falling fidelity.  Seen from a range, all points of earlier
   ranges are better on fidelity, so all that matters of them is their *staircase*: the pairs
   (utility, risk) that no other pair beats;
3. staircases are carried along the ranges by doubling: after step i every range has that of the 2^i
   ranges before it, so log2(ranges) small joins replace all pairs of ranges;
4. a range is filtered once, best fidelity first, against the staircase it was carried and its own.

What is shipped is one staircase per range and step: it grows with the front, not with the square of
the number of ranges.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .windows import value_cuts, with_bucket

SCORE_COLS = ("fidelity", "utility", "privacy_risk")


class Staircase:
    """Pairs (utility up, risk down) of which none beats another, by rising utility, hence rising risk."""

    def __init__(self, pairs=()):
        self.u: list[float] = []
        self.p: list[float] = []
        for u, p in pairs:
            self.add(u, p)

    def covers(self, u: float, p: float) -> bool:
        """Some pair is at least as good on both."""
        at = bisect_left(self.u, u)  # the least utility of u or more has the least risk of them
        return at < len(self.u) and self.p[at] <= p

    def add(self, u: float, p: float) -> None:
        if self.covers(u, p):
            return
        hi = bisect_left(self.u, u)
        hi += hi < len(self.u) and self.u[hi] == u
        lo = bisect_left(self.p, p, 0, hi)  # pairs of less utility and as much risk or more
        self.u[lo:hi], self.p[lo:hi] = [u], [p]


def sort_filter(f: np.ndarray, u: np.ndarray, p: np.ndarray, carried: Staircase | None = None) -> np.ndarray:
    """True per point that no other point dominates.  ``carried`` is the staircase of points of more fidelity."""
    stairs, keep = carried or Staircase(), np.zeros(len(f), bool)
    order = np.lexsort((p, -u, -f))  # equal fidelity: what can dominate comes first
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and f[order[end]] == f[order[at]]:
            end += 1
        same = order[at:end]
        own, last = Staircase(), None
        for i in same:
            pair = (u[i], p[i])
            if pair == last or not own.covers(*pair):  # equal points do not dominate each other
                keep[i] = not stairs.covers(*pair)
                own.add(*pair)
                last = pair
        for a, b in zip(own.u, own.p):
            stairs.add(a, b)
        at = end
    return keep


def skyline(trials: DataFrame, keys: Sequence[str], id_col: str, block: int = 2048) -> DataFrame:
    """Non-dominated rows (keys, id, scores) among trials with all three scores present.  Equal trials
    stay together; a study without scored trials has no row."""
    k = list(keys)
    t = trials.where(F.col("fidelity").isNotNull() & F.col("utility").isNotNull()
                     & F.col("privacy_risk").isNotNull() & ~F.isnan("fidelity") & ~F.isnan("utility")
                     & ~F.isnan("privacy_risk")).select(*k, id_col, *SCORE_COLS)
    out_schema = t.schema
    cols = [c for c in t.columns]

    def scores(rows: pd.DataFrame):
        return [rows[c].to_numpy(float) for c in SCORE_COLS]

    n = t.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    dealt = t.join(n, k).withColumn("_blk", F.pmod(F.xxhash64(F.lit("k35"), id_col), F.ceil(F.col("_n") / F.lit(block))).cast("int")).drop("_n")

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[sort_filter(*scores(rows)), cols]

    cand = cut_lineage(dealt.groupBy(*k, "_blk").applyInPandas(local, out_schema))
    # ranges of falling fidelity; _r 0 has the most
    cand = cand.withColumn("_f", -F.col("fidelity"))
    cand = with_bucket(cand, value_cuts(cand, k, "_f", rows_per_bucket=block), k, "_f").drop("_f").withColumnRenamed("_b", "_r")

    stair_schema = ", ".join([f"`{c}` {out_schema[c].dataType.simpleString()}" for c in k] + ["_r int", "u array<double>", "p array<double>"])

    def stairs(rows: pd.DataFrame) -> pd.DataFrame:
        s = Staircase(zip(rows["utility"].to_numpy(float), rows["privacy_risk"].to_numpy(float)))
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in k}, "_r": [rows["_r"].iloc[0]], "u": [s.u], "p": [s.p]})

    own = cut_lineage(cand.select(*k, "_r", "utility", "privacy_risk").groupBy(*k, "_r").applyInPandas(stairs, stair_schema))
    last = own.agg(F.max("_r")).first()[0] or 0
    carried = None
    if last:
        # range r first holds the staircase of range r - 1, then of the 2, 4, ... ranges before it; every
        # range of the study takes part, also one that no candidate fell into
        span = own.groupBy(*k).agg(F.max("_r").alias("_top"))
        grid = span.select(*k, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_r"))
        carried = grid.join(own.withColumn("_r", F.col("_r") + 1), [*k, "_r"], "left")
        merged = F.udf(_merged, "struct<u: array<double>, p: array<double>>")
        for i in range(math.ceil(math.log2(last + 1))):
            before = carried.select(*k, (F.col("_r") + 2**i).alias("_r"), F.col("u").alias("_u"), F.col("p").alias("_p"))
            both = carried.join(before, [*k, "_r"], "left").withColumn("_m", merged("u", "p", "_u", "_p"))
            carried = cut_lineage(both.select(*k, "_r", F.col("_m.u").alias("u"), F.col("_m.p").alias("p")))

    if carried is None:
        def filtered(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.loc[sort_filter(*scores(rows)), cols]
        return cand.groupBy(*k, "_r").applyInPandas(filtered, out_schema)

    def filtered_after(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows[cols]
        s = Staircase(zip(before["u"].iloc[0], before["p"].iloc[0])) if len(before) and before["u"].iloc[0] is not None else None
        return rows.loc[sort_filter(*scores(rows), s), cols]
    return cand.groupBy(*k, "_r").cogroup(carried.groupBy(*k, "_r")).applyInPandas(filtered_after, out_schema)


def _merged(u, p, u2, p2):
    """The staircase of two staircases."""
    s = Staircase([*zip(u or [], p or []), *zip(u2 or [], p2 or [])])
    return s.u, s.p
