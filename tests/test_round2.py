"""Fixes outside the fixtures: durations, duplicate runs, absent treatments, NULL targets, session folder."""

import pytest
from pyspark.sql import functions as F

from synthscore.functions.scalars import duration_to_seconds
from synthscore.operators import rankstats as M
from synthscore.operators import sampling as E
from synthscore.operators import trials as T


@pytest.mark.parametrize("text, seconds", [
    ("0 days 00:01:01.15", 61.15), ("00:01:01.15", 61.15), ("2 days 01:00:00", 176400.0), ("1 day, 0:00:02", 86402.0),
    ("00:00:05.5 (estimated)", 5.5), ("-1 days 00:00:01", -86399.0), ("12.5", 12.5), ("soon", None), (None, None), ("", None)])
def test_duration(spark, text, seconds):
    got = spark.createDataFrame([(text,)], "d string").select(duration_to_seconds(F.col("d"))).first()[0]
    assert got == pytest.approx(seconds) if seconds is not None else got is None


def test_pairwise_takes_the_best_of_duplicate_runs(spark):
    rows = [("d", "g", 0, "standard_tpe", 0.5, 10.0), ("d", "g", 0, "standard_tpe", None, 99.0), ("d", "g", 0, "gp", 0.7, 20.0),
            ("d", "g", 0, "gp", 0.6, 30.0)]
    runs = spark.createDataFrame(rows, "dataset string, generator string, seed long, sampler string, best_objective double, total_time_s double")
    got = {r["pair"]: r for r in T.pairwise(runs).collect()}
    assert got["GP-ST"]["mean_delta_best_j"] == pytest.approx(0.2) and got["GP-ST"]["mean_delta_time_s"] == pytest.approx(10.0)


def test_absent_treatment_leaves_no_complete_block(spark):
    rows = [(b, t, float(i)) for b in ("x", "y") for i, t in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "block string, treat string, value double")
    assert M.complete_only(df, "block", "treat", "value").count() == 4
    assert M.complete_only(df, "block", "treat", "value", treatments=["a", "b", "c"]).count() == 0


def test_split_with_null_targets(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, target string")
    sp = E.train_test_split(df, "id", "target", 0.25)
    assert sp.where("split = 'test'").count() == 10  # a quarter of the 40 rows with a class
    assert sp.where("split = 'test' and target is null").count() == 0


def test_export_complete_trials(spark, tmp_path):
    from synthscore.sources.runs import export_complete_trials

    for study, rows in (("adult/gp", [(0, "COMPLETE", '{"lr": "0.1", "layers": "[2, 2]"}'), (1, "FAIL", "{}")]), ("wine/tpe", [(0, "complete", '{"lr": "0.2"}')])):
        spark.createDataFrame(rows, "number long, state string, params string").write.json(f"{tmp_path}/{study}/trials.json")
    df = spark.read.schema("number long, state string, params string").json([f"{tmp_path}/adult/gp/trials.json", f"{tmp_path}/wine/tpe/trials.json"])
    out = export_complete_trials(df, r"([^/]+)/([^/]+)/trials\.json/", ["dataset", "sampler"], "params", ["lr", "layers"])
    assert sorted(tuple(r) for r in out.select("dataset", "sampler", "number", "param_lr", "param_layers").collect()) == [
        ("adult", "gp", 0, "0.1", "[2, 2]"), ("wine", "tpe", 0, "0.2", None)]


def test_rescore_keeps_old_columns(spark):
    from synthscore.operators.fidelity import rescore_trials

    real = spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
                                  F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    synth = real.withColumn("trial_id", F.lit(0).cast("long")).unionByName(
        real.withColumn("trial_id", F.lit(1).cast("long")).withColumn("x", F.col("x") + 100))
    log = spark.createDataFrame([(0, 0.4), (1, 0.5), (2, 0.6)], "trial_id long, fidelity double")
    got = {r["trial_id"]: r for r in rescore_trials(log, real, synth, ["x", "y"], ["c"]).collect()}
    assert [got[t]["fidelity_old"] for t in range(3)] == [0.4, 0.5, 0.6]
    assert got[0]["fidelity"] == pytest.approx(1.0) and got[1]["fidelity"] < 0.95 and got[2]["fidelity"] is None
