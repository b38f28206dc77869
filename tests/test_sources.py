"""Readers and writers round-trip the trial log."""

from pyspark.sql import functions as F

from synthscore.plans.common import scored, summaries
from synthscore.sources import runs as S

from .conftest import SF_SMALL


def test_dataset_config_merges_defaults():
    reg = {"defaults": {"sep": ",", "target": None}, "datasets": {"adult": {"target": "income"}}}
    assert S.dataset_config(reg, "adult") == {"sep": ",", "target": "income"}
    assert S.layered({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_csv_files_of_two_widths_union_by_name(spark, tmp_path):
    t = scored(spark, SF_SMALL)
    left = t.where(F.col("sampler") == "gp").select("event_id", "state", "fidelity")
    right = t.where(F.col("sampler") != "gp").select("event_id", "state", "utility", "duration_s")
    p1, p2 = str(tmp_path / "a"), str(tmp_path / "b")
    left.coalesce(1).write.option("header", "true").csv(p1)
    right.coalesce(2).write.option("header", "true").csv(p2)
    paths = [str(f) for d in (tmp_path / "a", tmp_path / "b") for f in d.glob("*.csv")]
    got = S.read_trial_files(spark, paths, "csv")
    assert set(got.columns) == {"event_id", "state", "fidelity", "utility", "duration_s"}
    assert got.count() == t.count()
    assert got.where(F.col("fidelity").isNotNull()).count() == left.where(F.col("fidelity").isNotNull()).count()


def test_trials_written_by_study_and_keys_read_from_path(spark, tmp_path):
    t = scored(spark, SF_SMALL)
    out = str(tmp_path / "trials")
    S.write_trials(t, out)
    back = spark.read.parquet(out)
    assert back.count() == t.count()
    one = back.where((F.col("dataset") == "d1") & (F.col("sampler") == "gp"))
    assert one.count() == t.where((F.col("dataset") == "d1") & (F.col("sampler") == "gp")).count()
    raw = spark.read.parquet(out + "/dataset=d1/generator=g0/sampler=gp/seed=0")
    k = S.with_keys_from_path(raw, r"dataset=([^/]+)/generator=([^/]+)/sampler=([^/]+)", ["dataset", "generator",
                                                                                           "sampler"])
    assert {tuple(r) for r in k.select("dataset", "generator", "sampler").distinct().collect()} == {("d1", "g0", "gp")}


def test_master_log_append_and_ragged_csv(spark, tmp_path):
    s = summaries(spark, SF_SMALL).select("dataset", "generator", "status",
                                          F.col("best_objective").alias("objective"))
    out = str(tmp_path / "master")
    S.append_master(s, out)
    S.append_master(s, out)
    m = S.read_master(spark, out)
    assert m.columns == S.MASTER_COLUMNS and m.count() == 2 * s.count()
    csv = tmp_path / "old.csv"
    csv.write_text(",".join(S.MASTER_COLUMNS) + "\nd0,g0,completed,0.5,10\n")
    r = S.read_master(spark, str(csv), "csv").collect()
    assert len(r) == 1 and r[0]["elapsed_sec"] == 10.0 and r[0]["error"] is None


def test_summary_tree_missing_cells_and_corrupt_files(spark, tmp_path):
    import json
    s = summaries(spark, SF_SMALL).where((F.col("sampler") == "gp") & (F.col("seed") == 0))
    rows = s.select("dataset", "generator", "sampler", "seed", "best_objective").collect()
    for r in rows[:-1]:  # the last study has no summary file
        d = tmp_path / "tree" / r["sampler"] / r["dataset"] / r["generator"] / f"seed{r['seed']}"
        d.mkdir(parents=True)
        (d / "summary.json").write_text(json.dumps({"best_objective": r["best_objective"], "status": "completed"}))
    bad = tmp_path / "tree" / "gp" / "dx" / "g9" / "seed0"
    bad.mkdir(parents=True)
    (bad / "summary.json").write_text("{not json")
    found = S.read_study_summaries(spark, str(tmp_path / "tree"), r"/([^/]+)/([^/]+)/([^/]+)/seed(\d+)/summary\.json$",
                                   ["sampler", "dataset", "generator", "seed"])
    found = found.withColumn("seed", F.col("seed").cast("bigint"))
    miss = S.missing_cells(found, s)
    assert [tuple(x) for x in miss.select("dataset", "generator").collect()] == [(rows[-1]["dataset"], rows[-1]["generator"])]
    ok = S.read_json_permissive(spark, str(tmp_path / "tree" / "*" / "*" / "*" / "*" / "summary.json"))
    assert ok.count() == len(rows) - 1


def test_model_scores_flattened(spark, tmp_path):
    import json
    doc = {"Gaussian Copula": {"mean_tstr_accuracy": 0.7, "mean_trtr_accuracy": 0.8, "accuracy_gap": 0.1,
                               "per_clf_tstr_accuracy": {"logistic_regression": 0.6, "random_forest": 0.8}},
           "tvae": {"mean_tstr_accuracy": 0.5, "per_clf_trtr_accuracy": {"linear_regression": 0.9}}}
    (tmp_path / "acc.json").write_text(json.dumps(doc))
    from synthscore.functions.scalars import normalise_generator
    got = {r["generator"]: r for r in S.read_model_scores(spark, str(tmp_path / "acc.json"), normalise_generator).collect()}
    assert got["gaussian_copula"]["tstr_lr"] == 0.6 and got["gaussian_copula"]["tstr_rf"] == 0.8
    assert got["gaussian_copula"]["tstr_dt"] is None and got["tvae"]["trtr_lr"] == 0.9 and got["tvae"]["gap"] is None
