"""Shared building blocks of the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objective import score_trials, scored_sql
from ..operators.trials import study_summary
from ..sources.fixtures import fx4_trials, with_fixtures


def r9(df: DataFrame, *cols: str) -> DataFrame:
    """Round float outputs whose summation order may differ between engines."""
    return df.select(*[F.round(F.col(c), 9).alias(c) if c in cols else F.col(c) for c in df.columns])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_trials(fx4_trials(spark, sf_dir)).drop("prune_reason")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_summary(scored(spark, sf_dir))


KEYS_SQL = "dataset, generator, sampler, seed"

SCORED_CTE = ("scored", scored_sql("fx4_trials"))

SUMMARY_CTE = ("summary", f"""
select a.dataset, a.generator, a.sampler, a.seed,
       case when a.n_complete > 0 then 'completed' else 'empty' end as status,
       b.objective as best_objective, b.fidelity as best_fidelity, b.utility as best_utility,
       b.privacy_risk as best_privacy_risk, b.trial_number as best_trial_number,
       a.n_complete, a.n_fail, a.n_pruned, a.n_attempted, a.total_time_s, a.mean_trial_time_s, a.study_wall_clock_s
from (select {KEYS_SQL},
             cast(count_if(state = 'COMPLETE') as bigint) as n_complete,
             cast(count_if(state = 'FAIL') as bigint) as n_fail,
             cast(count_if(state = 'PRUNED') as bigint) as n_pruned,
             cast(count(*) as bigint) as n_attempted,
             coalesce(sum(duration_s), 0e0) as total_time_s,
             avg(duration_s) as mean_trial_time_s,
             max(epoch_us(started) / 1e6 + coalesce(duration_s, 0e0)) - epoch_us(min(started)) / 1e6 as study_wall_clock_s
      from scored group by {KEYS_SQL}) a
left join (select *, row_number() over (partition by {KEYS_SQL} order by objective desc, trial_number) as rn
           from scored where state = 'COMPLETE') b
  on a.dataset = b.dataset and a.generator = b.generator and a.sampler = b.sampler and a.seed = b.seed and b.rn = 1""")


def trial_sql(body: str, *extra: tuple[str, str], summary: bool = True) -> str:
    ctes = [SCORED_CTE] + ([SUMMARY_CTE] if summary else []) + list(extra)
    return with_fixtures(body, "fx4_trials", extra=ctes)
