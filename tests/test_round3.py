"""Planted cases of the third round: coding, neighbours, wide correlations, failed candidates, ragged files,
copula families, versioned reports, and operators that no query calls."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscore.operators import clean, coding, copula, families, fidelity, loader, prep, privacy, scoring, synth
from synthscore.plans.common import scored
from synthscore.sources import runs, tables
from synthscore.streaming import live

from .conftest import SF_SMALL


def test_codes_of_a_million_levels(spark):
    """No window holds the column: codes are those of the sorted order, per key."""
    n = 1_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 < 9, F.lit("wide")).otherwise(F.lit("thin")).alias("k"),
                                 F.md5(F.col("id").cast("string")).alias("level"))
    out = coding.dense_codes(rows, ["k"], ["level"]).cache()
    per = {r["k"]: r for r in out.groupBy("k").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"),
                                                   F.countDistinct("code").alias("d")).collect()}
    assert {k: (r["n"], r["lo"], r["hi"], r["d"]) for k, r in per.items()} == {"wide": (900_000, 0, 899_999, 900_000), "thin": (100_000, 0, 99_999, 100_000)}
    some = out.where("code % 5000 = 17").select("k", "level", "code").collect()
    levels = {k: np.sort(np.array([r["level"] for r in rows.where(F.col("k") == k).collect()])) for k in ("thin",)}
    assert all(levels["thin"][r["code"]] == r["level"] for r in some if r["k"] == "thin") and len(some) == 200
    out.unpersist()
    plan = coding.dense_codes(rows.limit(100), ["k"], ["level"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" in plan and "level" not in plan.split("windowspecdefinition")[1].split("]")[0]


def test_codes_with_nulls_ties_and_none(spark):
    rows = spark.createDataFrame([("a", 3), ("a", None), ("a", 1), (None, 2), (None, 1), ("b", 1), ("b", 1)], "k string, v int")
    got = sorted(((r["k"], r["v"], r["code"]) for r in coding.dense_codes(rows, ["k"], ["v"]).collect()), key=repr)
    assert got == sorted([("a", None, 0), ("a", 1, 1), ("a", 3, 2), (None, 1, 0), (None, 2, 1), ("b", 1, 0), ("b", 1, 1)], key=repr)
    assert coding.dense_codes(rows.limit(0), ["k"], ["v"]).collect() == []


def brute_knn(base, query, k):
    d = np.sqrt(((query[:, None, :] - base[None]) ** 2).sum(axis=2))
    order = np.lexsort((np.broadcast_to(np.arange(len(base)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def test_neighbours_visit_few_vectors(spark):
    """Low dimension, dense clusters, equal vectors: exact, and the rings under the real bound are few."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 3)) * 20
    base = np.concatenate([centres[i % 40] + rng.normal(size=3) for i in range(6000)]).reshape(-1, 3)
    base[:900] = base[0]  # one vector 900 times
    query = np.concatenate([centres[i % 40] + rng.normal(size=3) for i in range(300)]).reshape(-1, 3)
    bdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, v array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)], "id long, v array<double>")
    nn, visits = privacy.knn(bdf, qdf, 3, base_id="id", query_id="id", vec="v", base_block=64, query_block=64, visits=True)
    ids, dist = brute_knn(base, query, 3)
    got = {(r["qid"], r["rank"]): (r["bid"], r["distance"]) for r in nn.collect()}
    assert len(got) == 900
    for (q, rank), (b, d) in got.items():
        assert d == pytest.approx(dist[q, rank - 1], abs=1e-9) and (b == ids[q, rank - 1] or dist[q, rank - 1] == pytest.approx(np.linalg.norm(base[b] - query[q])))
    seen = [r["n_vectors"] for r in visits.collect()]
    assert len(seen) == 300 and np.mean(seen) < 0.15 * len(base)
    few = privacy.knn(bdf.limit(2), qdf, 3, base_id="id", query_id="id", vec="v").collect()  # fewer than k
    assert len(few) == 600
    assert privacy.knn(bdf.limit(0), qdf, 3, base_id="id", query_id="id", vec="v").collect() == []


def test_wide_correlations_equal_the_narrow_path(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 300)) @ np.diag(rng.uniform(0.1, 1e4, 300)) + 1e6
    x[:, 7] = 5.0  # constant
    x[:, 8] = x[:, 9]
    x[rng.random(x.shape) < 0.05] = np.nan
    cols = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([(i % 2, *[None if v != v else float(v) for v in r]) for i, r in enumerate(x)], "trial_id long, " + ", ".join(f"{c} double" for c in cols))
    some = cols[:12]
    for group in (None, "trial_id"):
        key = lambda r: (*([r["trial_id"]] if group else []), r["col_a"], r["col_b"])
        wide = {key(r): r["rho"] for r in fidelity.pearson_blocked(df, cols, group, width=64, height=50).collect()}
        narrow = {key(r): r["rho"] for r in fidelity.pearson_pairs(df, some, [group] if group else []).collect()}
        assert len(wide) == 300 * 299 // 2 * (2 if group else 1)
        for k, v in narrow.items():
            assert (v is None) == (wide[k] is None) and (v is None or wide[k] == pytest.approx(v, abs=1e-7)), k
    import pandas as pd
    pdf = pd.DataFrame(x, columns=cols)
    want = pdf.corr()
    flat = {(r["col_a"], r["col_b"]): r["rho"] for r in fidelity.pearson_blocked(df, cols).collect()}
    for a, b in [("c0", "c299"), ("c63", "c64"), ("c8", "c9"), ("c130", "c131")]:
        assert flat[a, b] == pytest.approx(want.loc[a, b], abs=1e-7)


def test_failed_candidates_are_rows(spark):
    """A generator that failed, one without rows, one without fidelity, one whose models failed, one that is scored."""
    params = spark.createDataFrame([(0, {"noise_std": "0.01"}), (1, {"noise_std": "many"}), (2, {"noise_std": "-1"}), (3, {}), (4, None), (5, {"noise_std": "NaN"})],
                                   "trial_id long, params map<string,string>")
    errors = {r["trial_id"]: r["error"] for r in synth.candidate_errors(params, synth.BOOTSTRAP_SPACE).collect()}
    assert errors == {0: None, 1: "ValueError: noise_std=many is not a number", 2: "ValueError: noise_std=-1 is below 0", 3: None, 4: None,
                      5: "ValueError: noise_std=NaN is not a number"}
    cand = spark.createDataFrame([(0, None), (1, "ValueError: bad"), (2, None), (3, None), (4, None)], "trial_id long, error string")
    counts = spark.createDataFrame([(0, 10), (3, 5), (4, 9)], "trial_id long, n_rows long")
    fid = spark.createDataFrame([(0, 0.9), (3, None), (4, 0.5)], "trial_id long, sdv_quality double")
    util = spark.createDataFrame([(0, 0.8, None), (3, 0.5, None), (4, 0.0, "mlp: ValueError: x")], "trial_id long, utility double, utility_error string")
    priv = spark.createDataFrame([(0, 0.25), (3, 0.5), (4, 1.0)], "trial_id long, privacy_risk double")
    got = {r["trial_id"]: r for r in scoring.scoring_rows(cand, counts, fid, util, priv).collect()}
    assert len(got) == 5 and {t: r["state"] for t, r in got.items()} == {0: "COMPLETE", 1: "PRUNED", 2: "PRUNED", 3: "PRUNED", 4: "COMPLETE"}
    assert got[0]["objective"] == pytest.approx(0.4 * 0.9 + 0.4 * 0.8 - 0.2 * 0.25) and got[0]["error"] is None
    assert got[1]["error"] == "generator failed: ValueError: bad" and got[2]["error"] == "generator failed: no rows"
    assert got[3]["error"].startswith("FidelityUnavailableError") and got[3]["objective"] is None and got[3]["utility"] is None
    assert got[4]["utility_error"] == "mlp: ValueError: x" and got[4]["objective"] == pytest.approx(0.0)


def test_rescored_trials_keep_their_log_rows(spark):
    """Two trials share a table, one has no rows, one failed to be rebuilt."""
    rng = np.random.default_rng(4)
    real = spark.createDataFrame([(float(a), float(b), "xy"[int(c)]) for a, b, c in zip(rng.normal(size=60), rng.normal(size=60), rng.integers(0, 2, 60))], "a double, b double, c string")
    syn = real.withColumn("trial_id", F.lit(1).cast("long"))
    log = spark.createDataFrame([(10, 1, 0.4), (11, 1, 0.7), (12, 2, 0.1), (13, 3, None)], "event long, cand long, fidelity double")
    errors = spark.createDataFrame([(3, "ValueError: no")], "trial_id long, error string")
    got = {r["event"]: r for r in fidelity.rescore_trials(log, real, syn, ["a", "b"], ["c"], "cand", errors).collect()}
    assert set(got) == {10, 11, 12, 13} and got[10]["fidelity_old"] == 0.4 and got[11]["fidelity_old"] == 0.7
    assert got[10]["fidelity"] == got[11]["fidelity"] == pytest.approx(1.0) and not got[10]["sdv_unavailable"] and got[10]["error"] is None
    assert got[12]["error"] == "no rebuilt rows" and got[13]["error"] == "ValueError: no"
    assert got[12]["sdv_unavailable"] and got[13]["sdv_unavailable"] and got[12]["fidelity"] is None


def test_hundred_ragged_files(spark, tmp_path):
    """A4: ten widths in a hundred files, quoted fields, an empty file and one with a header alone."""
    want = []
    for f in range(100):
        names = ["id", "state"] + [f"p{j}" for j in range(f % 10)]
        lines = [",".join(reversed(names) if f % 3 == 0 else names)]
        for r in range(4):
            row = {"id": f * 10 + r, "state": 'COMPLETE, "late"' if r == 1 else "FAIL", **{f"p{j}": (f + j) / 2 if r != 2 else "" for j in range(f % 10)}}
            want.append(tuple(row.get(k) if row.get(k) != "" else None for k in ["id", "state"] + [f"p{j}" for j in range(9)]))
            cell = lambda v: '"' + str(v).replace('"', '""') + '"' if "," in str(v) else str(v)
            lines.append(",".join(cell(row[k]) for k in (reversed(names) if f % 3 == 0 else names)))
        (tmp_path / f"t{f}.csv").write_text("\n".join(lines) + ("\n\n" if f % 2 else ""))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id,state,extra\n")
    df = runs.read_trial_files(spark, [str(tmp_path)])
    assert set(df.columns) == {"id", "state", "extra"} | {f"p{j}" for j in range(9)}
    kinds = dict(df.dtypes)
    assert kinds["id"] == "bigint" and kinds["state"] == "string" and kinds["p0"] == "double" and kinds["extra"] == "string"
    got = [tuple(r) for r in df.select("id", "state", *[f"p{j}" for j in range(9)]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("family, draw", [("beta", lambda r: r.beta(2, 5, 4000) * 10 + 3), ("gamma", lambda r: r.gamma(2.5, 3, 4000) + 7),
                                          ("truncnorm", lambda r: (lambda x: x[(x > -0.5) & (x < 2)][:4000] * 4 + 1)(r.normal(size=9000)))])
def test_copula_families(spark, family, draw):
    """Close to the column they are fitted to: moments, quantiles, bounds, rank correlation."""
    rng = np.random.default_rng(6)
    x = draw(rng)
    y = x + rng.normal(size=len(x)) * x.std() / 2
    real = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    m = copula.fit_copula(real, "k", ["x", "y"], family=family)
    got = copula.sample_copula(spark, m, 6000, seed=3).toPandas()
    assert abs(got["x"].mean() - x.mean()) < 0.06 * x.std() and abs(got["x"].std() - x.std()) < 0.06 * x.std()
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        assert abs(got["x"].quantile(q) - np.quantile(x, q)) < 0.12 * x.std(), q
    assert got["x"].min() >= x.min() and got["x"].max() <= x.max()
    ranks = [df[["x", "y"]].corr(method="spearman").iloc[0, 1] for df in (got, real.toPandas())]
    assert abs(ranks[0] - ranks[1]) < 0.06
    assert families.quantile_table(family, 2.0, 0.0, 2.0, 2.0)[0] == 2.0


def test_reports_are_never_missing(spark, tmp_path):
    """A reader during the batches sees an old or a new report; pending cells; the last equals the batch answer."""
    s = scored(spark, SF_SMALL)
    folder = str(tmp_path / "trials")
    for k in range(4):
        s.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    none = spark.createDataFrame([("gp", "d_none", "g0"), ("gp", "d_queued", "g0")], list(live.LIVE_KEYS))
    grid = s.select(*live.LIVE_KEYS).distinct().union(none)
    queued = none.where("dataset = 'd_queued'")
    path, seen, stop, wrong = str(tmp_path / "live"), [], threading.Event(), []

    def reader():
        while not stop.is_set():
            df = live.read_version(spark, f"{path}/report")
            if df is None:
                if seen:
                    wrong.append("gone")
                continue
            try:
                seen.append(df.agg(F.count("*"), F.sum("n_attempted")).first())
            except Exception as e:  # a version that was deleted or torn under the reader
                wrong.append(str(e)[:200])

    t = threading.Thread(target=reader)
    t.start()
    try:
        stream = live.trial_event_stream(spark, folder, s.schema, max_files_per_trigger=1)
        live.start_live_report(stream, grid, 5, path, str(tmp_path / "ck"), queued=queued).awaitTermination(300)
    finally:
        stop.set()
        t.join()
    assert not wrong and {n for n, _ in seen} == {grid.count()}
    totals = [x for _, x in seen]
    assert totals == sorted(totals) and len(live.versions(spark, f"{path}/report")) == 2
    last = live.read_version(spark, f"{path}/report")
    cols = [*live.LIVE_KEYS, "status", "n_complete", "n_attempted", "best_objective"]
    want = live.live_status(live.live_counts(s), grid, 5, queued=queued)
    norm = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    assert norm(last) == norm(want)
    assert {r["dataset"]: r["status"] for r in last.where("dataset like 'd\\\\_%'").collect()} == {"d_none": "missing", "d_queued": "pending"}
    live.write_version(want.limit(1), f"{path}/report", 99)
    assert live.read_version(spark, f"{path}/report").count() == 1 and live.read_version(spark, f"{path}/report", before=99).count() == grid.count()
