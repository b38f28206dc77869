"""FX-6 golden test: ranks, Friedman, Wilcoxon and Holm reproduce the published numbers."""

import pytest
from pyspark.sql import functions as F

from synthscore.operators import rankstats as M

from .golden_ranks import EXPECTED_AVG_RANK, EXPECTED_FRIEDMAN, EXPECTED_WILCOXON, GOLDEN_MEANS

PAIRS = [("standard_tpe", "multivariate_tpe", "Standard TPE vs Multivariate TPE"),
         ("standard_tpe", "gp", "Standard TPE vs Gaussian Process"),
         ("multivariate_tpe", "gp", "Multivariate TPE vs Gaussian Process")]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN_MEANS, "dataset string, sampler string, mean_best_j double")


def test_average_ranks(golden):
    r = M.average_ranks(golden, "dataset", "mean_best_j")
    got = {x["sampler"]: x["average_rank"] for x in M.mean_ranks(r, "sampler").collect()}
    for k, v in EXPECTED_AVG_RANK.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_friedman(golden):
    f = M.friedman(golden, "dataset", "sampler", "mean_best_j").collect()[0]
    assert f["n_blocks"] == 15 and f["df"] == 2
    assert f["chi2"] == pytest.approx(EXPECTED_FRIEDMAN["chi2"], abs=1e-9)
    assert f["p_value"] == pytest.approx(EXPECTED_FRIEDMAN["p_value"], abs=1e-12)
    assert f["kendalls_w"] == pytest.approx(EXPECTED_FRIEDMAN["kendalls_w"], abs=1e-9)


def test_wilcoxon_holm(golden):
    w = M.holm(M.wilcoxon_pairs(golden, "dataset", "sampler", "mean_best_j", PAIRS))
    got = {x["comparison"]: (x["wilcoxon_stat"], x["p_raw"], x["p_holm"]) for x in w.collect()}
    for k, (stat, p, ph) in EXPECTED_WILCOXON.items():
        assert got[k][0] == pytest.approx(stat)
        assert got[k][1] == pytest.approx(p, abs=1e-15)
        assert got[k][2] == pytest.approx(ph, abs=1e-15)


def test_holm_monotone_and_ge_raw(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "comparison string, p_raw double")
    rows = sorted(M.holm(df).collect(), key=lambda r: r["p_raw"])
    assert all(r["p_holm"] >= r["p_raw"] for r in rows)
    assert [r["p_holm"] for r in rows] == sorted(r["p_holm"] for r in rows)
    assert rows[0]["p_holm"] == pytest.approx(0.04)


def test_holm_ties(spark):
    # two tied p-values at the bottom of three: both get 3 * p (published 3-seed archive)
    df = spark.createDataFrame([("x", 0.330261), ("y", 0.018066), ("z", 0.018066)], "comparison string, p_raw double")
    got = {r["comparison"]: r["p_holm"] for r in M.holm(df).collect()}
    assert got["y"] == pytest.approx(0.054198) and got["z"] == pytest.approx(0.054198)


def test_chi2_sf_closed_forms(spark):
    df = spark.createDataFrame([(5.2, 2), (3.84145882, 1), (7.81472790, 3), (0.0, 4), (9.48772904, 4)],
                               "x double, df int")
    got = [r[0] for r in df.select(M.chi2_sf_expr(F.col("x"), F.col("df"))).collect()]
    assert got[0] == pytest.approx(0.0742735782143343, abs=1e-12)
    assert got[1] == pytest.approx(0.05, abs=1e-6)   # odd df goes through erfc (1.2e-7 fit)
    assert got[2] == pytest.approx(0.05, abs=1e-6)
    assert got[3] == 1.0
    assert got[4] == pytest.approx(0.05, abs=1e-8)


def test_wilcoxon_all_zero_differences(spark):
    rows = [(f"d{i}", s, 0.5) for i in range(6) for s in ("standard_tpe", "gp")]
    df = spark.createDataFrame(rows, "dataset string, sampler string, mean_best_j double")
    w = M.wilcoxon_pairs(df, "dataset", "sampler", "mean_best_j", [("standard_tpe", "gp", "x")]).collect()[0]
    assert w["wilcoxon_stat"] == 0.0 and w["p_raw"] == 1.0
