"""The sort-filter skyline equals a brute-force dominance check, with tiny blocks so that local
skylines, ranges and carried staircases all work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscore.operators import pareto
from synthscore.operators.pareto import Staircase, skyline, sort_filter
from synthscore.plans.common import scored

from .conftest import SF_SMALL

KEYS = ["dataset", "generator", "sampler", "seed"]


def brute(f, u, p):
    v = np.column_stack([f, u, -np.asarray(p)])
    return np.array([not ((v >= x).all(axis=1) & (v > x).any(axis=1)).any() for x in v], bool)


def test_kernel():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(0, 40))
        f, u, p = rng.integers(0, int(rng.integers(1, 8)), (3, n)).astype(float)
        assert (sort_filter(f, u, p) == brute(f, u, p)).all()
    s = Staircase([(1, 1), (2, 3), (1, 2), (3, 2), (3, 2), (0, 0)])
    assert list(zip(s.u, s.p)) == [(0, 0), (1, 1), (3, 2)] and s.covers(2, 2) and not s.covers(2, 1.5)


@pytest.mark.parametrize("block", [4, 2048])
def test_skyline_matches_brute_force(spark, block):
    s = scored(spark, SF_SMALL).where(F.col("state") == "COMPLETE").where(F.col("fidelity").isNotNull())
    # coarse scores create ties, which exercise the "better on one" rule
    s = s.withColumn("utility", F.round("utility", 1)).withColumn("privacy_risk", F.round("privacy_risk", 1))
    got = {r["event_id"] for r in skyline(s, KEYS, "event_id", block=block).select("event_id").collect()}
    pdf = s.select(*KEYS, "event_id", "fidelity", "utility", "privacy_risk").toPandas()
    want = set()
    for _, g in pdf.groupby(KEYS):
        want |= set(g["event_id"][brute(g["fidelity"], g["utility"], g["privacy_risk"])])
    assert got == want and len(got) > 0
    assert skyline(s.limit(0), KEYS, "event_id").collect() == []


def test_shipped_staircases_grow_with_the_front(spark, monkeypatch):
    """A large front in one study: what the ranges are sent is a staircase per step, not every other range."""
    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(3000, 3)))
    v /= np.linalg.norm(v, axis=1)[:, None]  # on a sphere: all on the front
    rows = [("s", i, float(a), float(b), float(1 - c)) for i, (a, b, c) in enumerate(v)] + [("s", 9000, 0.1, 0.1, 0.99), ("t", 1, 0.5, 0.5, 0.5)]
    t = spark.createDataFrame(rows, "study string, id long, fidelity double, utility double, privacy_risk double")
    shipped, real = [], pareto.cut_lineage
    monkeypatch.setattr(pareto, "cut_lineage", lambda df: shipped.append(real(df)) or shipped[-1])
    got = {(r["study"], r["id"]) for r in skyline(t, ["study"], "id", block=100).collect()}
    assert got == {("s", i) for i in range(3000)} | {("t", 1)}
    ranges = shipped[1].where("study = 's'").count()
    assert ranges >= 20
    sent = sum(df.select(F.coalesce(F.sum(F.size("u")), F.lit(0))).first()[0] for df in shipped[2:])
    assert len(shipped[2:]) <= 6 and sent < 3000 * ranges / 4  # all pairs of ranges would be 3000 * ranges / 2
