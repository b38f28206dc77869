"""Run collection and report tables (inventory A7, N1-N4).

A *run* is one finished study per (dataset, sampler, seed, generator) with its artefacts:
``metrics`` (best-trial scores), ``completed`` (marker with the search's best
value), ``params`` (best hyperparameters, long form: one row per parameter),
``timing`` and an optional recomputed utility block (``util``).  All tables are
one row per run (or per run and parameter), so every join here is on a key that
is unique on at least one side; the windows rank the generators of one
(dataset, sampler, seed), a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clip01

REPORT_KEYS = ["dataset", "sampler", "seed"]
RUN_KEYS = [*REPORT_KEYS, "generator"]

# Objective weights used by the report ranking (search objective O1).
REPORT_WEIGHTS = {"fidelity": 0.4, "utility": 0.4, "privacy_risk": 0.2}


def collect_runs(metrics: DataFrame, completed: DataFrame, timing: DataFrame | None = None,
                 util: DataFrame | None = None) -> DataFrame:
    """Metrics inner-join completed (a run without a completion marker is not reported),
    left-join timing and the recomputed utility block."""
    m = metrics.alias("m").join(completed.select(*RUN_KEYS, F.col("best_value").alias("c_best_value"),
                                                 F.col("elapsed_sec").alias("c_elapsed_sec")), RUN_KEYS, "inner")
    if timing is not None:
        m = m.join(timing.select(*RUN_KEYS, F.col("elapsed_sec").alias("t_elapsed_sec"),
                                 F.col("n_trials").alias("t_n_trials")), RUN_KEYS, "left")
    else:
        m = m.withColumn("t_elapsed_sec", F.lit(None).cast("double")).withColumn("t_n_trials", F.lit(None).cast("bigint"))
    if util is not None:
        m = m.join(util.select(*RUN_KEYS, *[F.col(c).alias(f"u_{c}") for c in ("tstr", "trtr", "gap", "utility")]),
                   RUN_KEYS, "left")
    else:
        for c in ("tstr", "trtr", "gap", "utility"):
            m = m.withColumn(f"u_{c}", F.lit(None).cast("double"))
    return m


def _gap_utility(tstr: Column, trtr: Column) -> Column:
    return F.lit(1.0) - clip01(F.greatest(trtr - tstr, F.lit(0.0)))


def report_rows(runs: DataFrame) -> DataFrame:
    """N1 (P-35): report utility is the recomputed block when it has both TSTR and TRTR,
    else the search-time metrics; objective re-weighted; ranked per report, best first."""
    has_block = F.col("u_tstr").isNotNull() & F.col("u_trtr").isNotNull()
    tstr = F.when(has_block, F.col("u_tstr")).otherwise(F.col("mean_tstr"))
    trtr = F.when(has_block, F.col("u_trtr")).otherwise(F.col("mean_trtr"))
    pos_gap = F.greatest(trtr - tstr, F.lit(0.0))
    gap = F.when(has_block, F.coalesce(F.col("u_gap"), pos_gap)).otherwise(F.coalesce(F.col("ref_gap"), pos_gap))
    util = F.when(has_block, F.coalesce(F.col("u_utility"), _gap_utility(tstr, trtr))).otherwise(
        F.coalesce(F.col("utility"), F.lit(1.0) - clip01(F.greatest(gap, F.lit(0.0)))))
    w = REPORT_WEIGHTS
    r = runs.select(
        *RUN_KEYS, F.col("fidelity"), util.alias("report_utility"), F.col("privacy_risk"),
        tstr.alias("tstr"), trtr.alias("trtr"), gap.alias("gap"),
        F.coalesce(F.col("c_best_value"), F.col("objective")).alias("obj_hpo"),
        F.coalesce(F.col("t_elapsed_sec"), F.col("c_elapsed_sec"), F.lit(0.0)).alias("time_s"),
        F.coalesce(F.col("t_n_trials"), F.lit(0)).cast("bigint").alias("n_trials"),
    )
    r = r.withColumn("report_objective", F.lit(w["fidelity"]) * F.col("fidelity")
                     + F.lit(w["utility"]) * F.col("report_utility")
                     - F.lit(w["privacy_risk"]) * F.col("privacy_risk"))
    order = Window.partitionBy(*REPORT_KEYS).orderBy(F.col("report_objective").desc(), F.col("generator"))
    return r.withColumn("rank", F.row_number().over(order).cast("bigint"))


def param_matrix(params_long: DataFrame, preferred: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """One column per hyperparameter, preferred ones first; the value list is given, so
    the pivot needs no extra distinct pass and the width is fixed by the search space."""
    cols = list(preferred) + [c for c in others if c not in preferred]
    p = params_long.groupBy(*RUN_KEYS).pivot("param", cols).agg(F.first("value", ignorenulls=True))
    return p.select(*RUN_KEYS, *[F.col(c).alias(f"p_{c}") for c in cols])


def headline_winners(rows: DataFrame) -> DataFrame:
    """Per report the objective winner, top fidelity, top utility and lowest risk; a tie
    goes to the generator ranked first by the report objective."""
    first = -F.col("rank")
    return rows.groupBy(*REPORT_KEYS).agg(
        F.max_by("generator", F.struct("report_objective", first)).alias("winner"),
        F.max("report_objective").alias("winner_objective"),
        F.max_by("generator", F.struct("fidelity", first)).alias("top_fidelity"),
        F.max("fidelity").alias("top_fidelity_value"),
        F.max_by("generator", F.struct("report_utility", first)).alias("top_utility"),
        F.max("report_utility").alias("top_utility_value"),
        F.min_by("generator", F.struct("privacy_risk", F.col("rank"))).alias("lowest_risk"),
        F.min("privacy_risk").alias("lowest_risk_value"),
    )


def missing_generators(runs: DataFrame, datasets: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected generators without a reported run, per report (scaffold by explode of the
    configured list, then anti-join on the run keys)."""
    scaffold = datasets.select(*REPORT_KEYS).distinct().withColumn(
        "generator", F.explode(F.array(*[F.lit(g) for g in expected])))
    return scaffold.join(runs.select(*RUN_KEYS), RUN_KEYS, "left_anti")
