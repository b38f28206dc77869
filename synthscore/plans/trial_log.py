"""Trial-log queries (inventory K) over the FX-4 trial log built from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rescore_seed, trial_seed
from ..operators import trials as T
from ..operators.objective import PRESETS_SQL, clip_sql, presets_frame, score_under_presets
from ..sources.fixtures import fx4_trials
from ..session import cut_lineage
from .common import KEYS_SQL, r9, scored, summaries, trial_sql
from .registry import register

K = T.STUDY_KEYS


GRID_CTE = ("grid", f"""select d.dataset, g.generator, s.sampler, e.seed
  from (select distinct dataset from fx4_trials) d, (select distinct generator from fx4_trials) g,
       (select distinct sampler from fx4_trials) s, (select distinct seed from fx4_trials) e""")
# the expected grid has a generator that was never run
XGRID_CTE = ("xgrid", """select * from grid
  union all select dataset, 'g9', 'gp', cast(3 as bigint) from (select distinct dataset from fx4_trials)""")
ORDER_CTE = ("sorder", "select 'standard_tpe' as sampler, 1 as s_order union all select 'multivariate_tpe', 2 "
                       "union all select 'gp', 3")


# ---------------------------------------------------------------- K1, K2
@register("k1_objective", trial_sql(
    "select event_id, dataset, generator, sampler, seed, trial_number, state, round(objective, 9) as objective "
    "from scored", summary=False))
def k1_objective(spark, sf_dir):
    """K1: objective per trial; COMPLETE without fidelity -> PRUNED, unscored."""
    s = scored(spark, sf_dir)
    return r9(s.select("event_id", *K, "trial_number", "state", "objective"), "objective")


@register("k2_preset_objectives", trial_sql(f"""
select s.event_id, p.preset,
       round(p.w_fidelity * {clip_sql('s.fidelity')} + p.w_utility * {clip_sql('s.utility')}
             - p.w_privacy_risk * {clip_sql('s.privacy_risk')}, 9) as objective
from scored s, ({PRESETS_SQL}) p where s.state = 'COMPLETE'""", summary=False))
def k2_preset_objectives(spark, sf_dir):
    """K2: every COMPLETE trial scored under each weight preset O1..O5."""
    x = score_under_presets(scored(spark, sf_dir), presets_frame(spark))
    return r9(x.select("event_id", "preset", "objective"), "objective")


# ---------------------------------------------------------------- K3 .. K8
SUMMARY_COLS = ("status, round(best_objective, 9) as best_objective, best_fidelity, best_utility, best_privacy_risk, "
                "best_trial_number, n_complete, n_fail, n_pruned, n_attempted, round(total_time_s, 9) as total_time_s, "
                "round(mean_trial_time_s, 9) as mean_trial_time_s, round(study_wall_clock_s, 9) as study_wall_clock_s")


@register("k3_study_summary", trial_sql(f"select {KEYS_SQL}, {SUMMARY_COLS} from summary"))
def k3_study_summary(spark, sf_dir):
    """K3: study summary from raw trials (counts, best trial, time sum / mean)."""
    return r9(summaries(spark, sf_dir), "best_objective", "total_time_s", "mean_trial_time_s", "study_wall_clock_s")


@register("k4_summary_runs", trial_sql(f"""
select {KEYS_SQL}, status, round(best_objective, 9) as best_objective,
       round(coalesce(nullif(total_time_s, 0), study_wall_clock_s), 9) as total_time_s,
       round(study_wall_clock_s, 9) as study_wall_clock_s
from summary"""))
def k4_summary_runs(spark, sf_dir):
    """K4: summary rows with total_time_s = duration sum, or wall clock when that is NULL / 0."""
    s = T.prefer_summary_time(summaries(spark, sf_dir))
    return r9(s.select(*K, "status", "best_objective", "total_time_s", "study_wall_clock_s"),
              "best_objective", "total_time_s", "study_wall_clock_s")


def _mixed_runs(spark, sf_dir):
    s = summaries(spark, sf_dir)
    a = s.select(*K, F.when(F.col("seed") == 3, F.lit("failed")).otherwise(F.col("status")).alias("status"),
                 "best_objective", F.lit(0).alias("src"))
    b = s.select(*K, F.lit("partial").alias("status"), (F.col("best_objective") - F.lit(0.01)).alias("best_objective"),
                 F.lit(1).alias("src"))
    return a.unionByName(b)


MIXED_CTE = ("mixed", f"""
select {KEYS_SQL}, case when seed = 3 then 'failed' else status end as status, best_objective, 0 as src from summary
union all
select {KEYS_SQL}, 'partial' as status, best_objective - 0.01e0 as best_objective, 1 as src from summary""")


@register("k5_dedupe_runs", trial_sql(f"""
select {KEYS_SQL}, status, round(best_objective, 9) as best_objective from (
  select *, row_number() over (partition by {KEYS_SQL} order by
      case status when 'completed' then 0 when 'skipped_resume' then 1 when 'partial' then 2 when 'failed' then 3 else 9 end,
      src) as rn
  from mixed) where rn = 1""", MIXED_CTE))
def k5_dedupe_runs(spark, sf_dir):
    """K5: one run per study, best status wins (completed < skipped_resume < partial < failed)."""
    d = T.dedupe_runs(_mixed_runs(spark, sf_dir), order_col="src")
    return r9(d.select(*K, "status", "best_objective"), "best_objective")


def _std_sql(c: str) -> str:
    return f"case when count({c}) = 0 then null when count({c}) = 1 then 0e0 else stddev_samp({c}) end"


@register("k6_seed_aggregate", trial_sql(f"""
select dataset, generator, sampler, count(best_objective) as n_seeds_finished,
       round(avg(best_objective), 9) as best_j_mean, round({_std_sql('best_objective')}, 9) as best_j_std,
       round(min(best_objective), 9) as best_j_min, round(max(best_objective), 9) as best_j_max,
       round(avg(total_time_s), 9) as total_time_mean_s, round({_std_sql('total_time_s')}, 9) as total_time_std_s
from (select *, coalesce(nullif(total_time_s, 0), study_wall_clock_s) as tt from summary) x
group by dataset, generator, sampler"""))
def k6_seed_aggregate(spark, sf_dir):
    """K6: mean / std / min / max of best J and time over seeds."""
    a = T.seed_aggregate(T.prefer_summary_time(summaries(spark, sf_dir)))
    return r9(a, "best_j_mean", "best_j_std", "best_j_min", "best_j_max", "total_time_mean_s", "total_time_std_s")


PAIRS_CTE = ("pairs", "select 'multivariate_tpe' as challenger, 'standard_tpe' as baseline, 'MT-ST' as pair "
                      "union all select 'gp', 'standard_tpe', 'GP-ST' union all select 'gp', 'multivariate_tpe', 'GP-MT'")
PAIRWISE_CTE = ("pw", """
select c.dataset, c.generator, p.pair, p.challenger, p.baseline,
       count(*) as n_seeds_compared, avg(c.best_objective - b.best_objective) as mean_delta_best_j,
       count_if(c.best_objective - b.best_objective > 0) as challenger_wins,
       avg(c.total_time_s - b.total_time_s) as mean_delta_time_s
from pairs p join summary c on c.sampler = p.challenger
join summary b on b.sampler = p.baseline and b.dataset = c.dataset and b.generator = c.generator and b.seed = c.seed
where c.best_objective is not null and b.best_objective is not null
group by c.dataset, c.generator, p.pair, p.challenger, p.baseline""")


@register("k7_pairwise", trial_sql("""
select dataset, generator, pair, challenger, baseline, n_seeds_compared, round(mean_delta_best_j, 9) as mean_delta_best_j,
       challenger_wins, round(mean_delta_time_s, 9) as mean_delta_time_s from pw""", PAIRS_CTE, PAIRWISE_CTE))
def k7_pairwise(spark, sf_dir):
    """K7: paired challenger - baseline deltas per seed (mean dJ, wins, mean dtime)."""
    return r9(T.pairwise(summaries(spark, sf_dir)), "mean_delta_best_j", "mean_delta_time_s")


BLOCK_CTE = ("blk", """
select sc.dataset, sc.generator,
       count_if(coalesce(c.n_ok, 0) < 4) as n_bad,
       string_agg(case when coalesce(c.n_ok, 0) < 4 then sc.sampler || ':' || cast(coalesce(c.n_ok, 0) as varchar) || '/4' end,
                  '; ' order by sc.s_order) as reason,
       max(case when sc.sampler = 'standard_tpe' then c.j_mean end) as j_standard_tpe,
       max(case when sc.sampler = 'multivariate_tpe' then c.j_mean end) as j_multivariate_tpe,
       max(case when sc.sampler = 'gp' then c.j_mean end) as j_gp
from (select d.dataset, d.generator, o.sampler, o.s_order
      from (select distinct dataset, generator from xgrid) d, sorder o) sc
left join (select dataset, generator, sampler, count(best_objective) as n_ok, avg(best_objective) as j_mean
           from summary group by dataset, generator, sampler) c
  on c.dataset = sc.dataset and c.generator = sc.generator and c.sampler = sc.sampler
group by sc.dataset, sc.generator""")


@register("k8_complete_blocks", trial_sql("""
select dataset, generator, round(j_standard_tpe, 9) as j_standard_tpe, round(j_multivariate_tpe, 9) as j_multivariate_tpe,
       round(j_gp, 9) as j_gp from blk where n_bad = 0""", GRID_CTE, XGRID_CTE, ORDER_CTE, BLOCK_CTE))
def k8_complete_blocks(spark, sf_dir):
    """K8: (dataset, generator) blocks where every sampler finished all 4 seeds."""
    blocks, _ = T.complete_blocks(summaries(spark, sf_dir), n_seeds=4, expected=_expected_grid(spark, sf_dir))
    return r9(blocks, "j_standard_tpe", "j_multivariate_tpe", "j_gp")


@register("k8_dropped_blocks", trial_sql("select dataset, generator, reason from blk where n_bad > 0",
                                         GRID_CTE, XGRID_CTE, ORDER_CTE, BLOCK_CTE))
def k8_dropped_blocks(spark, sf_dir):
    """K8: incomplete blocks of the expected grid with the reason text."""
    _, dropped = T.complete_blocks(summaries(spark, sf_dir), n_seeds=4, expected=_expected_grid(spark, sf_dir))
    return dropped


# ---------------------------------------------------------------- K9 .. K11
CURVE_CTE = ("curve", f"""
select {KEYS_SQL}, trial_number, objective,
       max(objective) over (partition by {KEYS_SQL} order by trial_number rows between unbounded preceding and current row) as best_so_far
from (select {KEYS_SQL}, trial_number, max(objective) as objective from scored
      where state = 'COMPLETE' and objective is not null group by {KEYS_SQL}, trial_number) t""")


@register("k9_running_best", trial_sql(
    f"select {KEYS_SQL}, trial_number, round(objective, 9) as objective, round(best_so_far, 9) as best_so_far from curve",
    CURVE_CTE, summary=False))
def k9_running_best(spark, sf_dir):
    """K9: running best objective per study (one value per trial number, cumulative max)."""
    return r9(T.running_best(scored(spark, sf_dir)), "objective", "best_so_far")


@register("k10_running_best_elapsed", trial_sql(f"""
select {KEYS_SQL}, trial_number, round(objective, 9) as objective, round(elapsed_s, 9) as elapsed_s,
       round(max(objective) over (partition by {KEYS_SQL} order by trial_number rows between unbounded preceding and current row), 9) as best_so_far
from (select s.*, coalesce(epoch_us(s.started) / 1e6 + s.duration_s - epoch_us(t.t0) / 1e6, cast(s.trial_number as double)) as elapsed_s
      from scored s join (select {KEYS_SQL}, arg_min(started, trial_number) as t0 from scored group by {KEYS_SQL}) t
      using ({KEYS_SQL})
      where s.state = 'COMPLETE' and s.objective is not null) x""", summary=False))
def k10_running_best_elapsed(spark, sf_dir):
    """Running best against elapsed seconds since the study's first trial start."""
    c = T.running_best_elapsed(scored(spark, sf_dir))
    return r9(c.select(*K, "trial_number", "objective", "elapsed_s", "best_so_far"), "objective", "elapsed_s", "best_so_far")


@register("k11_convergence", trial_sql("""
select generator, sampler, trial_number, count(best_so_far) as n_curves, round(avg(best_so_far), 9) as mean_best,
       round(coalesce(stddev_samp(best_so_far), 0e0), 9) as std_best
from curve group by generator, sampler, trial_number""", CURVE_CTE, summary=False))
def k11_convergence(spark, sf_dir):
    """Mean / std band of running-best curves over (dataset, seed)."""
    return r9(T.convergence_band(T.running_best(scored(spark, sf_dir))), "mean_best", "std_best")


# ---------------------------------------------------------------- K12 .. K18
COST_CTE = ("cost", f"""
select a.*, b.trial_number as best_trial_number from (
  select {KEYS_SQL},
         count_if(state = 'COMPLETE') as n_complete, count_if(state = 'FAIL') as n_fail,
         count_if(state = 'PRUNED') as n_pruned, count(*) as n_attempted,
         max(case when state = 'COMPLETE' then objective end) as best_objective,
         avg(case when state = 'COMPLETE' then duration_s end) as mean_complete_s,
         median(case when state = 'COMPLETE' then duration_s end) as median_complete_s,
         sum(case when state = 'COMPLETE' then duration_s end) as sum_complete_s,
         count_if(state in ('FAIL', 'PRUNED')) as n_errors,
         string_agg(case when state in ('FAIL', 'PRUNED') then cast(trial_number as varchar) || ':' || state end, ',' order by trial_number)
           as errors
  from scored group by {KEYS_SQL}) a
left join (select {KEYS_SQL}, trial_number, row_number() over (partition by {KEYS_SQL} order by objective desc, trial_number) as rn
           from scored where state = 'COMPLETE') b using ({KEYS_SQL})
where b.rn = 1 or b.rn is null""")


@register("k12_study_cost", trial_sql(f"""
select {KEYS_SQL}, n_complete, n_fail, n_pruned, n_attempted, best_trial_number, round(best_objective, 9) as best_objective,
       round(mean_complete_s, 9) as mean_complete_s, round(median_complete_s, 9) as median_complete_s,
       round(sum_complete_s, 9) as sum_complete_s, n_errors,
       coalesce(errors, '') as errors, coalesce(r.improved, '') as improved_at
from cost left join (
  select {KEYS_SQL}, string_agg(cast(trial_number as varchar), ',' order by trial_number) as improved
  from (select *, lag(best_so_far) over (partition by {KEYS_SQL} order by trial_number) as p from curve)
  where p is null or best_so_far > p group by {KEYS_SQL}) r using ({KEYS_SQL})""", COST_CTE, CURVE_CTE, summary=False))
def k12_study_cost(spark, sf_dir):
    """Per-study cost (state counts, best trial, mean / median / sum seconds of COMPLETE, the
    failed and pruned trials, the trials that improved the best)."""
    log = cut_lineage(scored(spark, sf_dir).select(*K, "trial_number", "state", "objective", "duration_s"))  # read by every part
    c = T.study_cost(log)
    text = F.transform("errors", lambda e: F.concat_ws(":", e["trial_number"].cast("string"), e["state"]))
    c = c.withColumn("errors", F.array_join(text, ",")).withColumn("improved_at", F.coalesce(F.array_join(
        F.transform("running_best", lambda b: b["trial_number"].cast("string")), ","), F.lit(""))).drop("running_best")
    return r9(c, "best_objective", "mean_complete_s", "median_complete_s", "sum_complete_s")


CMP_CTE = ("cmp", f"""
select s.dataset, s.generator, s.sampler, s.seed, s.best_objective as best_value, s.best_trial_number as best_trial,
       coalesce(s.study_wall_clock_s, s.total_time_s) as elapsed_sec, c.mean_complete_s as mean_trial_sec,
       s.n_attempted, s.n_complete, s.n_pruned, s.n_fail,
       case when s.best_objective is not null and coalesce(s.study_wall_clock_s, s.total_time_s) > 0
            then s.best_objective / (coalesce(s.study_wall_clock_s, s.total_time_s) / 3600e0) end as efficiency_obj_per_hour
from summary s left join cost c using ({KEYS_SQL})""")


def _comparison(spark, sf_dir):
    sc = scored(spark, sf_dir)
    return T.sampler_comparison(T.study_summary(sc), T.study_cost(sc))


@register("k13_sampler_comparison", trial_sql(f"""
select {KEYS_SQL}, round(best_value, 9) as best_value, best_trial, round(elapsed_sec, 9) as elapsed_sec,
       round(mean_trial_sec, 9) as mean_trial_sec, n_attempted, n_complete, n_pruned, n_fail,
       round(efficiency_obj_per_hour, 9) as efficiency_obj_per_hour from cmp""", COST_CTE, CMP_CTE))
def k13_sampler_comparison(spark, sf_dir):
    """Sampler comparison table with efficiency J per hour."""
    return r9(_comparison(spark, sf_dir), "best_value", "elapsed_sec", "mean_trial_sec", "efficiency_obj_per_hour")


@register("k13_elapsed_precedence", trial_sql(f"""
select {KEYS_SQL}, round(case when seed = 0 and sum_s is not null then sum_s when seed <= 1 and generator <> 'g2' then total_time_s
                              when generator <> 'g1' then study_wall_clock_s end, 9) as elapsed_sec,
       case when seed = 0 and sum_s is not null then 'cost' when seed <= 1 and generator <> 'g2' and total_time_s is not null then 'timing'
            when generator <> 'g1' and study_wall_clock_s is not null then 'completed' end as elapsed_source
from summary join (select {KEYS_SQL}, sum(case when state = 'COMPLETE' then duration_s end) as sum_s from scored group by {KEYS_SQL})
  using ({KEYS_SQL})"""))
def k13_elapsed_precedence(spark, sf_dir):
    """Elapsed seconds by precedence cost, timing, completed (seed 0 has cost records, seeds 0 and 1
    timing but for g2, all but g1 a completion marker)."""
    s = summaries(spark, sf_dir)
    cost = scored(spark, sf_dir).where((F.col("state") == "COMPLETE") & (F.col("seed") == 0)).groupBy(*K).agg(F.sum("duration_s").alias("elapsed_sec"))
    timing = s.where((F.col("seed") <= 1) & (F.col("generator") != "g2")).select(*K, F.col("total_time_s").alias("elapsed_sec"))
    done = s.where(F.col("generator") != "g1").select(*K, F.col("study_wall_clock_s").alias("elapsed_sec"))
    return r9(T.elapsed_by_precedence(s, cost, timing, done), "elapsed_sec")


@register("k14_wide_pivot", trial_sql("""
select dataset, generator, seed,
       round(max(case when sampler = 'standard_tpe' then best_value end), 9) as best_value_standard_tpe,
       round(max(case when sampler = 'multivariate_tpe' then best_value end), 9) as best_value_multivariate_tpe,
       round(max(case when sampler = 'gp' then best_value end), 9) as best_value_gp,
       round(max(case when sampler = 'standard_tpe' then elapsed_sec end), 9) as elapsed_sec_standard_tpe,
       round(max(case when sampler = 'multivariate_tpe' then elapsed_sec end), 9) as elapsed_sec_multivariate_tpe,
       round(max(case when sampler = 'gp' then elapsed_sec end), 9) as elapsed_sec_gp
from cmp group by dataset, generator, seed""", COST_CTE, CMP_CTE))
def k14_wide_pivot(spark, sf_dir):
    """Side-by-side pivot of best value and seconds per sampler."""
    p = T.wide_pivot(_comparison(spark, sf_dir), ["dataset", "generator", "seed"], ["best_value", "elapsed_sec"])
    return r9(p, *[c for c in p.columns if c.startswith(("best_value_", "elapsed_sec_"))])


@register("k15_headlines", trial_sql("""
select b.dataset, b.generator, b.seed, round(b.best_value, 9) as best_value, b.sampler as best_sampler,
       round(f.elapsed_sec, 9) as fastest_sec, f.sampler as fastest_sampler
from (select *, row_number() over (partition by dataset, generator, seed order by best_value desc, s_order) as rn
      from cmp join sorder using (sampler) where best_value is not null) b
join (select *, row_number() over (partition by dataset, generator, seed order by elapsed_sec, s_order) as rn
      from cmp join sorder using (sampler) where elapsed_sec is not null) f
  on b.dataset = f.dataset and b.generator = f.generator and b.seed = f.seed and f.rn = 1
where b.rn = 1""", COST_CTE, CMP_CTE, ORDER_CTE))
def k15_headlines(spark, sf_dir):
    """Best objective and fastest sampler per (dataset, generator, seed)."""
    h = T.headlines(_comparison(spark, sf_dir), ["dataset", "generator", "seed"])
    return r9(h, "best_value", "fastest_sec")


def _rollup_sql(level: str) -> str:
    return f"""
select '{level}' as level, {level} as key, count(*) as n, round(avg(j_a), 9) as j_baseline, round(avg(j_b), 9) as j_challenger,
       round(avg(j_b - j_a), 9) as delta_j, count_if(j_b > j_a) as challenger_wins,
       round(sum(s_a), 9) as s_baseline, round(sum(s_b), 9) as s_challenger
from pairs2 group by {level}"""


@register("k16_two_sampler_rollup", trial_sql(
    _rollup_sql("dataset") + " union all " + _rollup_sql("generator"),
    ("pairs2", """select a.dataset, a.generator, a.seed, a.best_objective as j_a, a.total_time_s as s_a,
                         b.best_objective as j_b, b.total_time_s as s_b
                  from summary a join summary b on a.dataset = b.dataset and a.generator = b.generator and a.seed = b.seed
                  where a.sampler = 'standard_tpe' and b.sampler = 'multivariate_tpe'
                    and a.best_objective is not null and b.best_objective is not null""")))
def k16_two_sampler_rollup(spark, sf_dir):
    """Two-sampler rollups by dataset and by generator (grouping sets)."""
    g = T.two_sampler_rollups(summaries(spark, sf_dir))
    return r9(g, "j_baseline", "j_challenger", "delta_j", "s_baseline", "s_challenger")


@register("k17_duration_distribution", trial_sql("""
select dataset, generator, sampler, round(quantile_cont(duration_s, 0.0), 9) as p00_s,
       round(quantile_cont(duration_s, 0.25), 9) as p25_s, round(quantile_cont(duration_s, 0.5), 9) as p50_s,
       round(quantile_cont(duration_s, 0.75), 9) as p75_s, round(quantile_cont(duration_s, 1.0), 9) as p100_s,
       count(duration_s) as n_trials
from scored where state = 'COMPLETE' and duration_s is not null group by dataset, generator, sampler""", summary=False))
def k17_duration_distribution(spark, sf_dir):
    """Distribution (quantiles) of COMPLETE trial durations per dataset x generator x sampler."""
    d = T.duration_distribution(scored(spark, sf_dir))
    return r9(d, "p00_s", "p25_s", "p50_s", "p75_s", "p100_s")


@register("k18_gain_vs_cost", trial_sql("""
select dataset, generator, pair, round(mean_delta_best_j, 9) as mean_delta_best_j,
       round(mean_delta_time_s / 3600e0, 9) as delta_hours
from pw where pair in ('MT-ST', 'GP-ST')""", PAIRS_CTE, PAIRWISE_CTE))
def k18_gain_vs_cost(spark, sf_dir):
    """Objective gain vs cost in hours relative to the standard sampler."""
    return r9(T.gain_vs_cost(T.pairwise(summaries(spark, sf_dir))), "mean_delta_best_j", "delta_hours")


# ---------------------------------------------------------------- K19 .. K25
def _grid(spark, sf_dir):
    return T.study_grid(fx4_trials(spark, sf_dir))


def _expected_grid(spark, sf_dir):
    """The job grid and, per dataset, a study of a generator that was never run."""
    extra = fx4_trials(spark, sf_dir).select("dataset").distinct().select(
        "dataset", F.lit("g9").alias("generator"), F.lit("gp").alias("sampler"), F.lit(3).cast("bigint").alias("seed"))
    return _grid(spark, sf_dir).select(*K).unionByName(extra)


@register("k19_study_inventory", trial_sql(f"""
select g.dataset, g.generator, g.sampler, g.seed, coalesce(a.n_trials, 0) as n_trials,
       coalesce(a.n_complete, 0) as n_complete, round(a.best_objective, 9) as best_objective
from xgrid g
left join (select {KEYS_SQL}, count(*) as n_trials, count_if(state = 'COMPLETE') as n_complete,
                  max(case when state = 'COMPLETE' then objective end) as best_objective
           from scored group by {KEYS_SQL}) a using ({KEYS_SQL})""", GRID_CTE, XGRID_CTE, summary=False))
def k19_study_inventory(spark, sf_dir):
    """Study inventory with zero rows for absent studies."""
    inv = T.study_inventory(scored(spark, sf_dir), _expected_grid(spark, sf_dir))
    return r9(inv.drop("best_json"), "best_objective")


@register("k20_best_generator", trial_sql("""
select dataset, sampler, seed, round(max(best_objective), 9) as best_objective,
       arg_min(generator, struct_pack(a := -best_objective, b := generator)) as best_generator
from summary where best_objective is not null group by dataset, sampler, seed"""))
def k20_best_generator(spark, sf_dir):
    """Best generator per (dataset, sampler, seed); ties -> first generator by name."""
    return r9(T.best_generator(summaries(spark, sf_dir)), "best_objective")


@register("k21_job_grid", trial_sql("select dataset, generator, sampler, seed from grid", GRID_CTE, summary=False))
def k21_job_grid(spark, sf_dir):
    """Job grid = cross product of dataset, generator, sampler and seed lists."""
    return _grid(spark, sf_dir)


WORK_TARGET = 36


@register("k22_work_left", trial_sql(f"""
select g.dataset, g.generator, g.sampler, g.seed, coalesce(s.n_attempted, 0) as n_attempted,
       greatest(0, {WORK_TARGET} - coalesce(s.n_attempted, 0)) as remaining
from xgrid g left join summary s using ({KEYS_SQL})
where not exists (select 1 from summary d where d.n_complete >= {WORK_TARGET} and d.dataset = g.dataset
                  and d.generator = g.generator and d.sampler = g.sampler and d.seed = g.seed)""",
    GRID_CTE, XGRID_CTE))
def k22_work_left(spark, sf_dir):
    """Studies still to run and trials remaining (max(0, target - attempted))."""
    w = T.work_left(_expected_grid(spark, sf_dir), summaries(spark, sf_dir), WORK_TARGET)
    return w.withColumn("remaining", F.col("remaining").cast("bigint"))


# An example trial-budget configuration (pair overrides, generator overrides, default).
BUDGET_BY_PAIR = [("d0", "g0", 30), ("d1", "g2", 10)]
BUDGET_BY_GENERATOR = [("g1", 25)]
BUDGET_DEFAULT = 20


@register("k23_trial_budget", trial_sql(f"""
select s.dataset, s.generator, s.sampler, s.seed, cast(coalesce(p.b, g.b, {BUDGET_DEFAULT}) as bigint) as budget
from summary s
left join ({' union all '.join(f"select '{d}' as dataset, '{g}' as generator, {b} as b" for d, g, b in BUDGET_BY_PAIR)}) p
  on p.dataset = s.dataset and p.generator = s.generator
left join ({' union all '.join(f"select '{g}' as generator, {b} as b" for g, b in BUDGET_BY_GENERATOR)}) g
  on g.generator = s.generator"""))
def k23_trial_budget(spark, sf_dir):
    """Trial budget by (dataset, generator), then generator, then default."""
    studies = summaries(spark, sf_dir).select(*K)
    bp = spark.createDataFrame(BUDGET_BY_PAIR, "dataset string, generator string, pair_budget int")
    bg = spark.createDataFrame(BUDGET_BY_GENERATOR, "generator string, generator_budget int")
    return T.trial_budget(studies, bp, bg, BUDGET_DEFAULT).select(*K, "budget")


@register("k24_trial_seeds", trial_sql("""
select event_id, cast((seed * 1000003 + trial_number * 97) % 2147483647 as bigint) as trial_seed,
       cast(seed * 100000 + trial_number as bigint) as rescore_seed from fx4_trials""", summary=False))
def k24_trial_seeds(spark, sf_dir):
    """Per-trial seed and the re-score fallback seed."""
    t = fx4_trials(spark, sf_dir)
    return t.select("event_id", trial_seed(F.col("seed"), F.col("trial_number")).cast("bigint").alias("trial_seed"),
                    rescore_seed(F.col("seed"), F.col("trial_number")).alias("rescore_seed"))


@register("k25_rescore_queue", trial_sql(f"""
select {KEYS_SQL}, trial_number from scored s
where state = 'COMPLETE' and generator in ('g0', 'g1')
  and not exists (select 1 from scored c where c.state = 'COMPLETE' and c.sampler = 'gp' and c.dataset = s.dataset
                  and c.generator = s.generator and c.sampler = s.sampler and c.seed = s.seed
                  and c.trial_number = s.trial_number)""", summary=False))
def k25_rescore_queue(spark, sf_dir):
    """COMPLETE trials (generators g0, g1) without a cached re-score (cache = gp trials)."""
    s = scored(spark, sf_dir)
    cache = s.where((F.col("state") == "COMPLETE") & (F.col("sampler") == "gp"))
    return T.rescore_queue(s, cache, ["g0", "g1"]).select(*K, "trial_number")


# ---------------------------------------------------------------- K27 .. K34
@register("k27_validation", trial_sql(f"""
select (select count(*) from runs) as n_loaded,
       (select count_if(best_objective is null) from runs) as n_null_best,
       (select count(*) from xgrid) as n_expected,
       (select count(*) from xgrid g where not exists (select 1 from runs r where r.dataset = g.dataset
          and r.generator = g.generator and r.sampler = g.sampler and r.seed = g.seed)) as n_missing,
       (select count(*) from (select {KEYS_SQL} from runs group by {KEYS_SQL} having count(*) > 1) d) as n_duplicate_keys""",
    GRID_CTE, XGRID_CTE,
    ("runs", f"select {KEYS_SQL}, best_objective from summary union all "
             f"select {KEYS_SQL}, best_objective from summary where dataset = 'd0' and generator = 'g0'")))
def k27_validation(spark, sf_dir):
    """Validation notes (loaded vs expected, NULL best, missing cells, duplicate keys)."""
    vs = summaries(spark, sf_dir).select(*K, "best_objective")
    runs = vs.unionByName(vs.where((F.col("dataset") == "d0") & (F.col("generator") == "g0")))
    return T.validation_notes(runs, _expected_grid(spark, sf_dir))


@register("k28_unknown_keys", trial_sql("""
select distinct r.dataset from (select concat('d', cast(seed + 3 as varchar)) as dataset from fx4_trials) r
where r.dataset not in (select distinct dataset from fx4_trials)""", summary=False))
def k28_unknown_keys(spark, sf_dir):
    """Requested dataset keys that are unknown (set difference)."""
    t = fx4_trials(spark, sf_dir)
    req = t.select(F.concat(F.lit("d"), (F.col("seed") + 3).cast("string")).alias("dataset"))
    return T.unknown_keys(req, t, "dataset")


@register("k29_runs_counters", trial_sql(f"""
select sampler, count_if(status = 'completed') as n_completed, count_if(status = 'skipped_resume') as n_skipped,
       count_if(status in ('failed', 'empty')) as n_failed, count(*) as n_runs
from (select *, row_number() over (partition by {KEYS_SQL} order by
      case status when 'completed' then 0 when 'skipped_resume' then 1 when 'partial' then 2 when 'failed' then 3 else 9 end,
      src) as rn from mixed) where rn = 1 group by sampler""", MIXED_CTE))
def k29_runs_counters(spark, sf_dir):
    """Completed / skipped / failed counters per sampler after run de-duplication."""
    return T.runs_counters(T.dedupe_runs(_mixed_runs(spark, sf_dir), order_col="src"))


STUCK_CUTOFF = "2024-01-29 00:00:00"


@register("k32_close_stuck", trial_sql(f"""
select t.event_id,
       case when (case when t.trial_number = m.last_trial then 'RUNNING' else t.state end) = 'RUNNING'
                 and t.started < timestamp '{STUCK_CUTOFF}' then 'FAIL'
            else (case when t.trial_number = m.last_trial then 'RUNNING' else t.state end) end as state
from fx4_trials t join (select {KEYS_SQL}, max(trial_number) as last_trial from fx4_trials group by {KEYS_SQL}) m
  using ({KEYS_SQL})""", summary=False))
def k32_close_stuck(spark, sf_dir):
    """Trials stuck in RUNNING (last trial of each study) before the cutoff are closed as FAIL."""
    t = fx4_trials(spark, sf_dir)
    last = t.groupBy(*K).agg(F.max("trial_number").alias("_last"))
    running = t.join(last, K).withColumn(
        "state", F.when(F.col("trial_number") == F.col("_last"), F.lit("RUNNING")).otherwise(F.col("state")))
    closed = T.close_stuck(running, F.lit(STUCK_CUTOFF).cast("timestamp_ntz"))
    return closed.select("event_id", "state")


@register("k33_unfinished", trial_sql(f"""
select g.dataset, g.generator, g.sampler, g.seed, o.s_order as sampler_rank
from xgrid g join sorder o using (sampler)
where not exists (select 1 from summary s where s.status = 'completed' and s.dataset = g.dataset
                  and s.generator = g.generator and s.sampler = g.sampler and s.seed = g.seed)""",
    GRID_CTE, XGRID_CTE, ORDER_CTE))
def k33_unfinished(spark, sf_dir):
    """Unfinished studies in sampler order."""
    u = T.unfinished(_expected_grid(spark, sf_dir), summaries(spark, sf_dir))
    return u.withColumn("sampler_rank", F.col("sampler_rank").cast("int"))


@register("k34_failed_summary", trial_sql(f"""
select g.dataset, g.generator, g.sampler, g.seed, coalesce(s.status, 'failed') as status,
       case when s.status is null then 'no summary written' end as error, s.n_attempted
from xgrid g left join summary s using ({KEYS_SQL})""", GRID_CTE, XGRID_CTE))
def k34_failed_summary(spark, sf_dir):
    """A failed study still yields a summary row (status failed, error text)."""
    f = T.failed_study_rows(_expected_grid(spark, sf_dir), summaries(spark, sf_dir))
    return f.select(*K, "status", "error", "n_attempted")


# ---------------------------------------------------------------- K35
@register("k35_pareto_front", trial_sql(f"""
select p.event_id, p.{KEYS_SQL.replace(', ', ', p.')}, p.fidelity, p.utility, p.privacy_risk
from scored p
where p.state = 'COMPLETE' and p.fidelity is not null and p.utility is not null and p.privacy_risk is not null
  and not isnan(p.fidelity)
  and not exists (
    select 1 from scored q
    where q.state = 'COMPLETE' and q.fidelity is not null and q.utility is not null and q.privacy_risk is not null
      and not isnan(q.fidelity)
      and q.dataset = p.dataset and q.generator = p.generator and q.sampler = p.sampler and q.seed = p.seed
      and q.fidelity >= p.fidelity and q.utility >= p.utility and q.privacy_risk <= p.privacy_risk
      and (q.fidelity > p.fidelity or q.utility > p.utility or q.privacy_risk < p.privacy_risk))""", summary=False))
def k35_pareto_front(spark, sf_dir):
    """Non-dominated COMPLETE trials per study (F up, U up, P down); brute force in the oracle."""
    from ..operators.pareto import skyline
    s = scored(spark, sf_dir).where(F.col("state") == "COMPLETE")
    return skyline(s, K, "event_id")
