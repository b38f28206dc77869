"""Run-collection and report queries (inventory A7, N1-N4) over FX-5 run artefacts.

FX-5 derives one run from every FX-4 study summary.  Gaps are built in so the fallbacks are exercised:
no completion marker for d3/g1, no timing for g0, no params for g2, no reference gap
for g2, and a recomputed utility block for d0 and d1 only (without its own utility for d1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators.objective import clip_sql
from .common import r9, summaries, trial_sql
from .registry import register

# Generator list the report expects and the preferred parameter order.
EXPECTED_GENERATORS = ["g0", "g1", "g2", "g3"]
PREFERRED_PARAMS = ["best_trial", "n_complete"]
OTHER_PARAMS = ["n_pruned"]


def fx5(spark, sf_dir):
    s = summaries(spark, sf_dir)
    g, d = F.col("generator"), F.col("dataset")
    metrics = s.select(
        *R.RUN_KEYS, F.col("best_fidelity").alias("fidelity"), F.col("best_utility").alias("utility"),
        F.col("best_privacy_risk").alias("privacy_risk"), (F.col("best_utility") * 0.8).alias("mean_tstr"),
        F.col("best_fidelity").alias("mean_trtr"),
        F.when(g == "g2", F.lit(None).cast("double"))
        .otherwise(F.col("best_fidelity") - F.col("best_utility") * 0.8).alias("ref_gap"),
        F.col("best_objective").alias("objective"))
    completed = s.where(~((d == "d3") & (g == "g1"))).select(
        *R.RUN_KEYS, F.col("best_objective").alias("best_value"), F.col("study_wall_clock_s").alias("elapsed_sec"))
    timing = s.where(g != "g0").select(*R.RUN_KEYS, F.col("total_time_s").alias("elapsed_sec"),
                                        F.col("n_attempted").alias("n_trials"))
    util = s.where(d.isin("d0", "d1")).select(
        *R.RUN_KEYS, (F.col("best_utility") * 0.7).alias("tstr"), F.col("best_fidelity").alias("trtr"),
        F.when(g == "g1", F.lit(None).cast("double")).otherwise(F.lit(0.05)).alias("gap"),
        F.when(d == "d1", F.lit(None).cast("double")).otherwise(F.col("best_utility")).alias("utility"))
    params = s.where(g != "g2").select(*R.RUN_KEYS, F.explode(F.create_map(
        F.lit("best_trial"), F.col("best_trial_number").cast("string"),
        F.lit("n_complete"), F.col("n_complete").cast("string"),
        F.lit("n_pruned"), F.col("n_pruned").cast("string"))).alias("param", "value"))
    return metrics, completed, timing, util, params


FX5_CTES = [
    ("s0", "select * from summary"),
    ("metrics", """select dataset, sampler, seed, generator, best_fidelity as fidelity, best_utility as utility,
        best_privacy_risk as privacy_risk, best_utility * 0.8e0 as mean_tstr, best_fidelity as mean_trtr,
        case when generator = 'g2' then null else best_fidelity - best_utility * 0.8e0 end as ref_gap,
        best_objective as objective from s0"""),
    ("completed", """select dataset, sampler, seed, generator, best_objective as best_value, study_wall_clock_s as elapsed_sec
        from s0 where not (dataset = 'd3' and generator = 'g1')"""),
    ("timing", "select dataset, sampler, seed, generator, total_time_s as elapsed_sec, n_attempted as n_trials from s0 "
               "where generator <> 'g0'"),
    ("util", """select dataset, sampler, seed, generator, best_utility * 0.7e0 as tstr, best_fidelity as trtr,
        case when generator = 'g1' then null else 0.05e0 end as gap,
        case when dataset = 'd1' then null else best_utility end as utility from s0 where dataset in ('d0', 'd1')"""),
    ("params", """select dataset, sampler, seed, generator, 'best_trial' as param, cast(best_trial_number as varchar) as value
        from s0 where generator <> 'g2'
        union all select dataset, sampler, seed, generator, 'n_complete', cast(n_complete as varchar) from s0 where generator <> 'g2'
        union all select dataset, sampler, seed, generator, 'n_pruned', cast(n_pruned as varchar) from s0 where generator <> 'g2'"""),
    ("runs", """select m.*, c.best_value as c_best_value, c.elapsed_sec as c_elapsed_sec,
        t.elapsed_sec as t_elapsed_sec, t.n_trials as t_n_trials,
        u.tstr as u_tstr, u.trtr as u_trtr, u.gap as u_gap, u.utility as u_utility
        from metrics m join completed c using (dataset, sampler, seed, generator)
        left join timing t using (dataset, sampler, seed, generator) left join util u using (dataset, sampler, seed, generator)"""),
    ("rrows", f"""select dataset, sampler, seed, generator, fidelity, report_utility, privacy_risk, tstr, trtr, gap, obj_hpo,
        time_s, n_trials, report_objective,
        row_number() over (partition by dataset, sampler, seed order by report_objective desc, generator) as rank
      from (select *, 0.4e0 * fidelity + 0.4e0 * report_utility - 0.2e0 * privacy_risk as report_objective
      from (select dataset, sampler, seed, generator, fidelity, privacy_risk,
          case when hb then u_tstr else mean_tstr end as tstr,
          case when hb then u_trtr else mean_trtr end as trtr,
          case when hb then coalesce(u_gap, greatest(u_trtr - u_tstr, 0e0))
               else coalesce(ref_gap, greatest(mean_trtr - mean_tstr, 0e0)) end as gap,
          case when hb then coalesce(u_utility, 1e0 - {clip_sql('greatest(u_trtr - u_tstr, 0e0)')})
               else coalesce(utility, 1e0 - {clip_sql('greatest(coalesce(ref_gap, greatest(mean_trtr - mean_tstr, 0e0)), 0e0)')})
          end as report_utility,
          coalesce(c_best_value, objective) as obj_hpo,
          coalesce(t_elapsed_sec, c_elapsed_sec, 0e0) as time_s,
          cast(coalesce(t_n_trials, 0) as bigint) as n_trials
        from (select *, u_tstr is not null and u_trtr is not null as hb from runs) x) y) z"""),
]


def _rows(spark, sf_dir):
    metrics, completed, timing, util, _ = fx5(spark, sf_dir)
    return R.report_rows(R.collect_runs(metrics, completed, timing, util))


@register("a7_collect_runs", trial_sql("""
select dataset, sampler, seed, generator, round(fidelity, 9) as fidelity, round(privacy_risk, 9) as privacy_risk,
       round(c_best_value, 9) as c_best_value, round(c_elapsed_sec, 9) as c_elapsed_sec,
       round(t_elapsed_sec, 9) as t_elapsed_sec, t_n_trials, round(u_tstr, 9) as u_tstr, round(u_utility, 9) as u_utility
from runs""", *FX5_CTES))
def a7_collect_runs(spark, sf_dir):
    """Metrics x completed (inner) with timing and recomputed utility (left)."""
    metrics, completed, timing, util, _ = fx5(spark, sf_dir)
    r = R.collect_runs(metrics, completed, timing, util)
    return r9(r.select(*R.RUN_KEYS, "fidelity", "privacy_risk", "c_best_value", "c_elapsed_sec", "t_elapsed_sec",
                       "t_n_trials", "u_tstr", "u_utility"),
              "fidelity", "privacy_risk", "c_best_value", "c_elapsed_sec", "t_elapsed_sec", "u_tstr", "u_utility")


N1_FLOATS = ["fidelity", "report_utility", "privacy_risk", "tstr", "trtr", "gap", "obj_hpo", "time_s",
             "report_objective"]


@register("n1_ranked_generators", trial_sql(
    "select dataset, sampler, seed, generator, " + ", ".join(f"round({c}, 9) as {c}" for c in N1_FLOATS)
    + ", n_trials, cast(rank as bigint) as rank from rrows", *FX5_CTES))
def n1_ranked_generators(spark, sf_dir):
    """Generators per (dataset, sampler, seed) ranked by the report objective (recomputed utility, P-35)."""
    r = _rows(spark, sf_dir)
    return r9(r.select(*R.RUN_KEYS, *N1_FLOATS, "n_trials", "rank"), *N1_FLOATS)


@register("n2_param_matrix", trial_sql(
    "select dataset, sampler, seed, generator, "
    + ", ".join(f"max(case when param = '{p}' then value end) as p_{p}" for p in PREFERRED_PARAMS + OTHER_PARAMS)
    + " from params group by dataset, sampler, seed, generator", *FX5_CTES))
def n2_param_matrix(spark, sf_dir):
    """Best hyperparameters as a matrix, preferred parameters first."""
    *_, params = fx5(spark, sf_dir)
    return R.param_matrix(params, PREFERRED_PARAMS, OTHER_PARAMS)


N3_SQL = """
select dataset, sampler, seed,
       max(case when r_o = 1 then generator end) as winner, round(max(report_objective), 9) as winner_objective,
       max(case when r_f = 1 then generator end) as top_fidelity, round(max(fidelity), 9) as top_fidelity_value,
       max(case when r_u = 1 then generator end) as top_utility, round(max(report_utility), 9) as top_utility_value,
       max(case when r_p = 1 then generator end) as lowest_risk, round(min(privacy_risk), 9) as lowest_risk_value
from (select *, row_number() over (partition by dataset, sampler, seed order by report_objective desc, rank) as r_o,
             row_number() over (partition by dataset, sampler, seed order by fidelity desc, rank) as r_f,
             row_number() over (partition by dataset, sampler, seed order by report_utility desc, rank) as r_u,
             row_number() over (partition by dataset, sampler, seed order by privacy_risk, rank) as r_p from rrows) t
group by dataset, sampler, seed"""


@register("n3_headline_winners", trial_sql(N3_SQL, *FX5_CTES))
def n3_headline_winners(spark, sf_dir):
    """Winner by report objective, top fidelity, top utility, lowest risk per report."""
    return r9(R.headline_winners(_rows(spark, sf_dir)), "winner_objective", "top_fidelity_value",
              "top_utility_value", "lowest_risk_value")


N4_GEN_SQL = " union all ".join(f"select '{g}' as generator" for g in EXPECTED_GENERATORS)


@register("n4_missing_generators", trial_sql(f"""
select d.dataset, d.sampler, d.seed, g.generator
from (select distinct dataset, sampler, seed from metrics) d, ({N4_GEN_SQL}) g
where not exists (select 1 from runs r where r.dataset = d.dataset and r.sampler = d.sampler and r.seed = d.seed
                  and r.generator = g.generator)""", *FX5_CTES))
def n4_missing_generators(spark, sf_dir):
    """Expected generators with no reported run, per report."""
    metrics, completed, timing, util, _ = fx5(spark, sf_dir)
    return R.missing_generators(R.collect_runs(metrics, completed, timing, util), metrics, EXPECTED_GENERATORS)
