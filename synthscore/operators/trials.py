"""K3 .. K34: relational operators over the trial log.

The trial log has one row per trial: study keys (dataset, generator, sampler,
seed), trial_number, state, the three components, objective, duration and
start time.  Every operator is a grouped aggregation, a join against a small
scaffold, or a running window — no per-study Python loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import std_or_zero
from .quantiles import exact_quantiles
from .windows import running_max

STUDY_KEYS = ["dataset", "generator", "sampler", "seed"]
# Sampler order and the challenger/baseline pairs of the comparison.
SAMPLER_ORDER = ["standard_tpe", "multivariate_tpe", "gp"]
PAIRS = [("multivariate_tpe", "standard_tpe", "MT-ST"),
         ("gp", "standard_tpe", "GP-ST"),
         ("gp", "multivariate_tpe", "GP-MT")]
# Run status preference when de-duplicating (lower wins, unknown = 9).
STATUS_RANK = {"completed": 0, "skipped_resume": 1, "partial": 2, "failed": 3}

def _complete() -> Column:
    return F.col("state") == "COMPLETE"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for kv in d.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def _epoch_s(c: Column) -> Column:
    """Seconds since epoch of a timestamp / timestamp_ntz (session time zone UTC)."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


# ------------------------------------------------------------------ K3 / K4
def study_summary(scored: DataFrame, keys: Sequence[str] = STUDY_KEYS) -> DataFrame:
    """K3: one row per study.  Best trial = max objective among _complete(), ties -> lowest trial_number."""
    best = F.max_by(
        F.struct("objective", "fidelity", "utility", "privacy_risk", "trial_number"),
        F.when(_complete() & F.col("objective").isNotNull(),
               F.struct(F.col("objective"), (-F.col("trial_number")).alias("neg_trial"))),
    )
    s = scored.groupBy(*keys).agg(
        F.count_if(_complete()).alias("n_complete"),
        F.count_if(F.col("state") == "FAIL").alias("n_fail"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
        F.count(F.lit(1)).alias("n_attempted"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_time_s"),
        F.avg("duration_s").alias("mean_trial_time_s"),
        best.alias("_best"),
        F.min("started").alias("_first_start"),
        F.max(_epoch_s(F.col("started")) + F.coalesce(F.col("duration_s"), F.lit(0.0))).alias("_last_end"),
    )
    return s.select(
        *keys,
        F.when(F.col("n_complete") > 0, F.lit("completed")).otherwise(F.lit("empty")).alias("status"),
        F.col("_best.objective").alias("best_objective"),
        F.col("_best.fidelity").alias("best_fidelity"),
        F.col("_best.utility").alias("best_utility"),
        F.col("_best.privacy_risk").alias("best_privacy_risk"),
        F.col("_best.trial_number").alias("best_trial_number"),
        "n_complete", "n_fail", "n_pruned", "n_attempted", "total_time_s", "mean_trial_time_s",
        (F.col("_last_end") - _epoch_s(F.col("_first_start"))).alias("study_wall_clock_s"),
    )


def prefer_summary_time(summaries: DataFrame) -> DataFrame:
    """K4 / P-25: total_time_s = sum of trial durations, or the wall clock when that is NULL or 0."""
    return summaries.withColumn(
        "total_time_s", F.coalesce(F.when(F.col("total_time_s") != 0, F.col("total_time_s")),
                                   F.col("study_wall_clock_s")))


# ------------------------------------------------------------------ K5
def dedupe_runs(runs: DataFrame, keys: Sequence[str] = STUDY_KEYS, order_col: str | None = None) -> DataFrame:
    """K5 / P-30: one row per study, best status wins (completed < skipped_resume < partial < failed < other).

    A grouped ``min_by`` (partial aggregation on the map side) instead of a
    window, so a key with many duplicate runs never sorts on one task.
    """
    rank = F.coalesce(F.element_at(_lit_map(STATUS_RANK), F.col("status")), F.lit(9))
    tie = F.col(order_col) if order_col else F.lit(0)
    others = [c for c in runs.columns if c not in keys]
    return (runs.groupBy(*keys)
            .agg(F.min_by(F.struct(*others), F.struct(rank.alias("r"), tie.alias("t"))).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]))


# ------------------------------------------------------------------ K6
def seed_aggregate(runs: DataFrame) -> DataFrame:
    """K6 / P-26: mean, sample std (1 value -> 0, none -> NULL), min, max and time over seeds."""
    nj = F.count("best_objective")
    nt = F.count("total_time_s")
    return runs.groupBy("dataset", "generator", "sampler").agg(
        nj.alias("n_seeds_finished"),
        F.avg("best_objective").alias("best_j_mean"),
        std_or_zero(F.col("best_objective"), nj).alias("best_j_std"),
        F.min("best_objective").alias("best_j_min"),
        F.max("best_objective").alias("best_j_max"),
        F.avg("total_time_s").alias("total_time_mean_s"),
        std_or_zero(F.col("total_time_s"), nt).alias("total_time_std_s"),
    )


# ------------------------------------------------------------------ K7 / K18
def _pairs_frame(spark: SparkSession, pairs=PAIRS) -> DataFrame:
    return spark.createDataFrame(pairs, "challenger string, baseline string, pair string")


def pairwise(runs: DataFrame, pairs=PAIRS) -> DataFrame:
    """K7: challenger - baseline per seed, then mean dJ, wins, mean dtime, n per (dataset, generator, pair).
    Of several run rows of one sampler and seed the one with the best objective counts."""
    spark = runs.sparkSession
    one = runs.groupBy("dataset", "generator", "seed", "sampler").agg(
        F.max_by(F.struct("best_objective", "total_time_s"), F.struct(F.coalesce("best_objective", F.lit(float("-inf"))), "total_time_s")).alias("r"))
    per_seed = one.groupBy("dataset", "generator", "seed").agg(
        F.map_from_entries(F.collect_list(F.struct("sampler", "r.best_objective"))).alias("_j"),
        F.map_from_entries(F.collect_list(F.struct("sampler", "r.total_time_s"))).alias("_t"),
    )  # one entry per sampler: bounded by the sampler count
    x = per_seed.crossJoin(F.broadcast(_pairs_frame(spark, pairs)))
    jc, jb = F.element_at("_j", F.col("challenger")), F.element_at("_j", F.col("baseline"))
    tc, tb = F.element_at("_t", F.col("challenger")), F.element_at("_t", F.col("baseline"))
    x = x.select("dataset", "generator", "pair", "challenger", "baseline",
                 (jc - jb).alias("dj"), (tc - tb).alias("dt"))
    both = F.col("dj").isNotNull()
    return (x.where(both).groupBy("dataset", "generator", "pair", "challenger", "baseline").agg(
        F.count(F.lit(1)).alias("n_seeds_compared"),
        F.avg("dj").alias("mean_delta_best_j"),
        F.count_if(F.col("dj") > 0).alias("challenger_wins"),
        F.avg("dt").alias("mean_delta_time_s"),
    ))


def gain_vs_cost(pair_table: DataFrame) -> DataFrame:
    """Objective vs cost deltas against the standard sampler, in hours."""
    return (pair_table.where(F.col("pair").isin("MT-ST", "GP-ST"))
            .select("dataset", "generator", "pair", "mean_delta_best_j",
                    (F.col("mean_delta_time_s") / F.lit(3600.0)).alias("delta_hours")))


# ------------------------------------------------------------------ K8
def complete_blocks(runs: DataFrame, n_seeds: int = 3, samplers: Sequence[str] = SAMPLER_ORDER, expected: DataFrame | None = None):
    """K8: (dataset, generator) blocks where every sampler has >= n_seeds finished seeds.

    Returns (blocks, dropped).  Blocks carry one mean column per sampler;
    dropped blocks carry the reason text ``sampler:n/needed; ...`` in sampler order.  ``expected``
    (a grid of studies) adds the blocks that never ran.
    """
    spark = runs.sparkSession
    order = spark.createDataFrame([(s, i) for i, s in enumerate(samplers)], "sampler string, s_order int")
    cells = runs.groupBy("dataset", "generator", "sampler").agg(
        F.count("best_objective").alias("n_ok"), F.avg("best_objective").alias("j_mean"))
    scaffold = (runs if expected is None else expected).select("dataset", "generator").distinct().crossJoin(F.broadcast(order))
    c = scaffold.join(cells, ["dataset", "generator", "sampler"], "left").fillna(0, ["n_ok"])
    bad = F.col("n_ok") < n_seeds
    per_block = c.groupBy("dataset", "generator").agg(
        F.count_if(bad).alias("n_bad"),
        F.array_sort(F.collect_list(F.when(bad, F.struct(
            F.col("s_order"), F.concat(F.col("sampler"), F.lit(":"), F.col("n_ok").cast("string"),
                                       F.lit(f"/{n_seeds}")).alias("txt"))))).alias("_r"),
        *[F.max(F.when(F.col("sampler") == s, F.col("j_mean"))).alias(f"j_{s}") for s in samplers],
    )
    blocks = per_block.where(F.col("n_bad") == 0).select("dataset", "generator", *[f"j_{s}" for s in samplers])
    dropped = per_block.where(F.col("n_bad") > 0).select(
        "dataset", "generator", F.array_join(F.transform("_r", lambda r: r["txt"]), "; ").alias("reason"))
    return blocks, dropped


# ------------------------------------------------------------------ K9 .. K11
def running_best(scored: DataFrame, keys: Sequence[str] = STUDY_KEYS, block_size: int = 4096) -> DataFrame:
    """K9 / P-32: one value per trial number (max over duplicates), then the cumulative max."""
    per_trial = (scored.where(_complete() & F.col("objective").isNotNull())
                 .groupBy(*keys, "trial_number").agg(F.max("objective").alias("objective")))
    return running_max(per_trial, keys, "trial_number", "objective", "best_so_far", block_size)


def running_best_elapsed(scored: DataFrame, keys: Sequence[str] = STUDY_KEYS, block_size: int = 4096) -> DataFrame:
    """Running best of _complete() trials against seconds since the study's first trial start.

    elapsed = (start + duration) - start of the lowest-numbered trial; trial
    number when no timestamp exists.
    """
    t0 = scored.groupBy(*keys).agg(F.min_by("started", "trial_number").alias("_t0"))
    c = scored.where(_complete() & F.col("objective").isNotNull()).join(t0, list(keys))
    c = c.withColumn("elapsed_s", F.coalesce(
        _epoch_s(F.col("started")) + F.col("duration_s") - _epoch_s(F.col("_t0")),
        F.col("trial_number").cast("double")))
    c = c.select(*keys, "trial_number", "objective", "elapsed_s")
    return running_max(c, keys, "trial_number", "objective", "best_so_far", block_size)


def convergence_band(curves: DataFrame) -> DataFrame:
    """Mean and sample std (NULL -> 0) of running-best curves over (dataset, seed)
    per generator x sampler x trial number; no forward fill."""
    return curves.groupBy("generator", "sampler", "trial_number").agg(
        F.count("best_so_far").alias("n_curves"),
        F.avg("best_so_far").alias("mean_best"),
        F.coalesce(F.stddev_samp("best_so_far"), F.lit(0.0)).alias("std_best"),
    )


# ------------------------------------------------------------------ K12 / K13 / K17
def study_cost(scored: DataFrame, keys: Sequence[str] = STUDY_KEYS) -> DataFrame:
    """K12 / P-33: state counts, best trial, mean / median / sum seconds of _complete() trials, error
    count, the error list (trial, state) and the running-best list (trials that improved the best)."""
    base = scored.groupBy(*keys).agg(
        F.count_if(_complete()).alias("n_complete"),
        F.count_if(F.col("state") == "FAIL").alias("n_fail"),
        F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
        F.count(F.lit(1)).alias("n_attempted"),
        F.max_by("trial_number", F.when(_complete(), F.struct(F.col("objective"), -F.col("trial_number")))
                 ).alias("best_trial_number"),
        F.max(F.when(_complete(), F.col("objective"))).alias("best_objective"),
        F.avg(F.when(_complete(), F.col("duration_s"))).alias("mean_complete_s"),
        F.sum(F.when(_complete(), F.col("duration_s"))).alias("sum_complete_s"),
        F.count_if(F.col("state").isin("FAIL", "PRUNED")).alias("n_errors"),
        F.array_sort(F.collect_list(F.when(F.col("state").isin("FAIL", "PRUNED"), F.struct("trial_number", "state")))).alias("errors"),
    )
    curve = running_best(scored, keys)
    w = Window.partitionBy(*keys).orderBy("trial_number")
    better = curve.withColumn("_p", F.lag("best_so_far").over(w)).where(F.col("_p").isNull() | (F.col("best_so_far") > F.col("_p")))
    best = better.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trial_number", F.col("best_so_far").alias("best")))).alias("running_best"))
    base = base.join(best, list(keys), "left")
    med = exact_quantiles(scored.where(_complete()), keys, "duration_s", [0.5], out_names=["median_complete_s"])
    return base.join(med, list(keys), "left")


def duration_distribution(scored: DataFrame, group_cols: Sequence[str] = ("dataset", "generator", "sampler"),
                          probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Distribution of _complete() trial durations (box-plot quantiles) per group."""
    names = [f"p{int(round(p * 100)):02d}_s" for p in probs]
    q = exact_quantiles(scored.where(_complete()), list(group_cols), "duration_s", list(probs), out_names=names)
    n = scored.where(_complete() & F.col("duration_s").isNotNull()).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_trials"))
    return q.join(n, list(group_cols), "inner")


def elapsed_by_precedence(runs: DataFrame, cost: DataFrame, timing: DataFrame, completed: DataFrame,
                          keys: Sequence[str] = STUDY_KEYS) -> DataFrame:
    """Elapsed seconds of each run from its cost record, else its timing record, else its
    completion marker (each with the keys and ``elapsed_sec``), and where they came from."""
    out = runs.select(*keys)
    for name, df in (("cost", cost), ("timing", timing), ("completed", completed)):
        out = out.join(df.select(*keys, F.col("elapsed_sec").alias(f"_{name}")), list(keys), "left")
    source = (F.when(F.col("_cost").isNotNull(), F.lit("cost")).when(F.col("_timing").isNotNull(), F.lit("timing"))
              .when(F.col("_completed").isNotNull(), F.lit("completed")))
    return out.select(*keys, F.coalesce("_cost", "_timing", "_completed").alias("elapsed_sec"), source.alias("elapsed_source"))


def sampler_comparison(summaries: DataFrame, cost: DataFrame) -> DataFrame:
    """One row per (sampler, dataset, generator); elapsed from the wall clock, then the
    duration sum; efficiency = best J per hour (NULL when hours <= 0)."""
    keys = ["dataset", "generator", "sampler", "seed"]
    j = summaries.join(cost.select(*keys, "mean_complete_s"), keys, "left")
    elapsed = F.coalesce(F.col("study_wall_clock_s"), F.col("total_time_s"))
    return j.select(
        *keys, F.col("best_objective").alias("best_value"), F.col("best_trial_number").alias("best_trial"),
        elapsed.alias("elapsed_sec"), F.col("mean_complete_s").alias("mean_trial_sec"),
        "n_attempted", "n_complete", "n_pruned", "n_fail",
        F.when(F.col("best_objective").isNotNull() & (elapsed > 0),
               F.try_divide(F.col("best_objective"), elapsed / F.lit(3600.0))).alias("efficiency_obj_per_hour"),
    )


# ------------------------------------------------------------------ K14 / K15 / K16
def wide_pivot(table: DataFrame, index: Sequence[str], value_cols: Sequence[str],
               samplers: Sequence[str] = SAMPLER_ORDER) -> DataFrame:
    """Side-by-side pivot, one column per (value, sampler); sampler list given so no extra pass."""
    aggs = [F.first(F.col(v), ignorenulls=True).alias(v) for v in value_cols]
    p = table.groupBy(*index).pivot("sampler", list(samplers)).agg(*aggs)
    if len(value_cols) == 1:
        p = p.select(*index, *[F.col(s).alias(f"{value_cols[0]}_{s}") for s in samplers])
    else:
        p = p.select(*index, *[F.col(f"{s}_{v}").alias(f"{v}_{s}") for v in value_cols for s in samplers])
    return p


def headlines(table: DataFrame, index: Sequence[str] = ("dataset", "generator")) -> DataFrame:
    """Best objective and fastest sampler per pair (NULLs ignored, ties -> sampler order)."""
    order = F.array_position(F.array(*[F.lit(s) for s in SAMPLER_ORDER]), F.col("sampler"))
    return table.groupBy(*index).agg(
        F.max("best_value").alias("best_value"),
        F.max_by("sampler", F.when(F.col("best_value").isNotNull(),
                                   F.struct(F.col("best_value"), -order))).alias("best_sampler"),
        F.min("elapsed_sec").alias("fastest_sec"),
        F.min_by("sampler", F.when(F.col("elapsed_sec").isNotNull(),
                                   F.struct(F.col("elapsed_sec"), order))).alias("fastest_sampler"),
    )


def two_sampler_rollups(runs: DataFrame, challenger: str = "multivariate_tpe", baseline: str = "standard_tpe"):
    """Per study pair (same dataset, generator, seed) join two samplers; roll up by
    dataset and by generator in one grouping-sets aggregation."""
    a = runs.where(F.col("sampler") == baseline).select(
        "dataset", "generator", "seed", F.col("best_objective").alias("j_a"), F.col("total_time_s").alias("s_a"))
    b = runs.where(F.col("sampler") == challenger).select(
        "dataset", "generator", "seed", F.col("best_objective").alias("j_b"), F.col("total_time_s").alias("s_b"))
    j = a.join(b, ["dataset", "generator", "seed"]).where(F.col("j_a").isNotNull() & F.col("j_b").isNotNull())
    g = j.groupingSets([["dataset"], ["generator"]], "dataset", "generator").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("j_a").alias("j_baseline"), F.avg("j_b").alias("j_challenger"),
        F.avg(F.col("j_b") - F.col("j_a")).alias("delta_j"),
        F.count_if(F.col("j_b") > F.col("j_a")).alias("challenger_wins"),
        F.sum("s_a").alias("s_baseline"), F.sum("s_b").alias("s_challenger"),
    )
    return g.select(
        F.when(F.col("dataset").isNotNull(), F.lit("dataset")).otherwise(F.lit("generator")).alias("level"),
        F.coalesce("dataset", "generator").alias("key"),
        "n", "j_baseline", "j_challenger", "delta_j", "challenger_wins", "s_baseline", "s_challenger")


# ------------------------------------------------------------------ K19 .. K23
def study_grid(trials: DataFrame) -> DataFrame:
    """The job grid = cross product of the four key lists (each list small: a distinct)."""
    lists = [trials.select(k).distinct() for k in STUDY_KEYS]
    g = lists[0]
    for other in lists[1:]:
        g = g.crossJoin(F.broadcast(other))
    return g


def study_inventory(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """Every grid study with counts (0 for absent studies) and best params as JSON."""
    s = scored.groupBy(*STUDY_KEYS).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if(_complete()).alias("n_complete"),
        F.max_by(F.struct("fidelity", "utility", "privacy_risk"),
                 F.when(_complete(), F.struct(F.col("objective"), -F.col("trial_number")))).alias("_b"),
        F.max(F.when(_complete(), F.col("objective"))).alias("best_objective"))
    j = grid.join(s, STUDY_KEYS, "left")
    return j.select(*STUDY_KEYS, F.coalesce("n_trials", F.lit(0)).alias("n_trials"),
                    F.coalesce("n_complete", F.lit(0)).alias("n_complete"), "best_objective",
                    F.when(F.col("_b").isNotNull(), F.to_json("_b")).alias("best_json"))


def best_generator(runs: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """Best generator per (dataset, sampler, seed); a recorded best wins over the
    recomputed one; ties -> first generator in name order."""
    r = runs
    if recorded is not None:
        r = r.join(recorded, STUDY_KEYS, "left").withColumn(
            "best_objective", F.coalesce(F.col("recorded_best"), F.col("best_objective")))
    return r.groupBy("dataset", "sampler", "seed").agg(
        F.max("best_objective").alias("best_objective"),
        F.min_by("generator", F.when(F.col("best_objective").isNotNull(), F.struct(
            -F.col("best_objective"), F.col("generator")))).alias("best_generator"),
    )


def work_left(grid: DataFrame, summaries: DataFrame, target_trials: int | Column) -> DataFrame:
    """Completed studies skipped; remaining = max(0, target - attempted)."""
    done = summaries.where(F.col("n_complete") >= F.lit(target_trials)).select(*STUDY_KEYS)
    todo = grid.join(done, STUDY_KEYS, "left_anti").join(
        summaries.select(*STUDY_KEYS, "n_attempted"), STUDY_KEYS, "left")
    att = F.coalesce(F.col("n_attempted"), F.lit(0))
    return todo.select(*STUDY_KEYS, att.alias("n_attempted"),
                       F.greatest(F.lit(0), F.lit(target_trials) - att).alias("remaining"))


def trial_budget(studies: DataFrame, by_pair: DataFrame, by_generator: DataFrame, default: int) -> DataFrame:
    """Budget from (dataset, generator), else generator, else default (small tables broadcast)."""
    return (studies.join(F.broadcast(by_pair), ["dataset", "generator"], "left")
            .join(F.broadcast(by_generator), ["generator"], "left")
            .withColumn("budget", F.coalesce("pair_budget", "generator_budget", F.lit(default)).cast("bigint"))
            .drop("pair_budget", "generator_budget"))


# ------------------------------------------------------------------ K25, K27 .. K29, K32 .. K34
def rescore_queue(scored: DataFrame, cache: DataFrame, generators: Sequence[str] | None = None) -> DataFrame:
    """_complete() trials without a cached score, optionally for some generators."""
    q = scored.where(_complete())
    if generators:
        q = q.where(F.col("generator").isin(list(generators)))
    return q.join(cache.select(*STUDY_KEYS, "trial_number"), STUDY_KEYS + ["trial_number"], "left_anti")


def validation_notes(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """Expected vs loaded studies, NULL best, missing cells, duplicate keys — one row."""
    dups = runs.groupBy(*STUDY_KEYS).count().where(F.col("count") > 1)
    missing = grid.join(runs.select(*STUDY_KEYS), STUDY_KEYS, "left_anti")
    a = runs.agg(F.count(F.lit(1)).alias("n_loaded"),
                 F.count_if(F.col("best_objective").isNull()).alias("n_null_best"))
    b = grid.agg(F.count(F.lit(1)).alias("n_expected"))
    c = missing.agg(F.count(F.lit(1)).alias("n_missing"))
    d = dups.agg(F.count(F.lit(1)).alias("n_duplicate_keys"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four one-row frames


def unknown_keys(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that are not known (set difference)."""
    return requested.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def runs_counters(summaries: DataFrame, group_cols: Sequence[str] = ("sampler",)) -> DataFrame:
    """Completed / skipped / failed run counters."""
    st = F.col("status")
    return summaries.groupBy(*group_cols).agg(
        F.count_if(st == "completed").alias("n_completed"),
        F.count_if(st == "skipped_resume").alias("n_skipped"),
        F.count_if(st.isin("failed", "empty")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_runs"))


def close_stuck(trials: DataFrame, cutoff: Column) -> DataFrame:
    """RUNNING trials started before the cutoff are closed as FAIL."""
    return trials.withColumn("state", F.when((F.col("state") == "RUNNING") & (F.col("started") < cutoff),
                                             F.lit("FAIL")).otherwise(F.col("state")))


def unfinished(grid: DataFrame, summaries: DataFrame, sampler_order: Sequence[str] = SAMPLER_ORDER) -> DataFrame:
    """Grid cells without a completed study, in (sampler order, dataset, generator, seed) order."""
    done = summaries.where(F.col("status") == "completed").select(*STUDY_KEYS)
    order = F.array_position(F.array(*[F.lit(s) for s in sampler_order]), F.col("sampler"))
    return (grid.join(done, STUDY_KEYS, "left_anti")
            .withColumn("sampler_rank", order)
            .orderBy("sampler_rank", "dataset", "generator", "seed"))


def failed_study_rows(grid: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every grid study yields a summary row; absent ones are 'failed' with an error text."""
    j = grid.join(summaries, STUDY_KEYS, "left")
    return j.withColumn("error", F.when(F.col("status").isNull(), F.lit("no summary written"))) \
            .withColumn("status", F.coalesce(F.col("status"), F.lit("failed")))


# ------------------------------------------------------------------ K31
def param_importance(trials: DataFrame, params: dict[str, str], keys: Sequence[str] = STUDY_KEYS,
                     bins: int = 10, top_k: int | None = None) -> DataFrame:
    """K31 (re-aimed from fANOVA): correlation ratio eta^2 = between-bin SS / total SS of the
    objective per parameter and study, normalised to sum 1 over the study's parameters.

    ``params`` maps column -> ``"float"`` (equal-width bins between the study's min and max)
    or ``"cat"`` (one bin per value).  A parameter counts when the study has >= 3 COMPLETE
    trials with a value and >= 2 occupied bins.  Everything is a grouped aggregate over
    (study, parameter[, bin]); the per-bin table is small and joined back by key."""
    k = list(keys)
    items = [F.struct(F.lit(name).alias("param"), F.lit(kind).alias("kind"),
                      F.col(name).cast("double" if kind == "float" else "string").cast("string").alias("raw"))
             for name, kind in params.items()]
    long = (trials.where(_complete() & F.col("objective").isNotNull())
            .select(*k, "objective", F.explode(F.array(*items)).alias("p"))
            .select(*k, "objective", "p.param", "p.kind", "p.raw").where(F.col("raw").isNotNull()))
    num = F.col("raw").cast("double")
    rng = long.where(F.col("kind") == "float").groupBy(*k, "param").agg(F.min(num).alias("lo"), F.max(num).alias("hi"))
    long = long.join(rng, k + ["param"], "left")
    fbin = F.when(F.col("hi") > F.col("lo"), F.least(
        F.floor((num - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    long = long.withColumn("bin", F.when(F.col("kind") == "float", fbin.cast("bigint").cast("string"))
                           .otherwise(F.col("raw")))
    per_bin = long.groupBy(*k, "param", "bin").agg(F.count(F.lit(1)).alias("n_b"), F.avg("objective").alias("m_b"))
    tot = long.groupBy(*k, "param").agg(F.count(F.lit(1)).alias("n"), F.avg("objective").alias("m"),
                                        F.var_pop("objective").alias("v"))
    between = per_bin.join(tot.select(*k, "param", "m"), k + ["param"]).groupBy(*k, "param").agg(
        F.sum(F.col("n_b") * (F.col("m_b") - F.col("m")) * (F.col("m_b") - F.col("m"))).alias("ss_between"),
        F.count(F.lit(1)).alias("n_bins"))
    e = tot.join(between, k + ["param"]).where((F.col("n") >= 3) & (F.col("n_bins") >= 2) & (F.col("v") > 0))
    e = e.select(*k, "param", (F.col("ss_between") / (F.col("v") * F.col("n"))).alias("eta2"))
    study = Window.partitionBy(*k)
    e = e.withColumn("importance", F.try_divide(F.col("eta2"), F.sum("eta2").over(study)))
    e = e.withColumn("rank", F.row_number().over(study.orderBy(F.round("importance", 9).desc(), F.col("param"))))
    return e.where(F.col("rank") <= top_k) if top_k else e
