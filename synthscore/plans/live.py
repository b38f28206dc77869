"""Live-monitoring queries (inventory S1, S3) run as batch over the FX-4 trial log.

The operators are the ones the streaming jobs use (``synthscore.streaming.live``);
running them over the whole log in batch gives the final state a stream converges
to, which is what the oracle checks.  ``tests/test_streaming.py`` drives the
streaming path itself and compares it with these batch answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live as LV
from .common import r9, scored, trial_sql
from .registry import register

# Trials a study needs before it counts as completed (the search budget).
LIVE_TARGET_TRIALS = 150


def _live_inputs(spark, sf_dir):
    """Counts come from the whole log; the grid also has, per dataset, a generator that was never
    launched: queued in d0 and d1 (pending), elsewhere missing."""
    s = scored(spark, sf_dir)
    never = s.select(F.lit("gp").alias("sampler"), "dataset", F.lit("g9").alias("generator"))
    queued = never.where(F.col("dataset").isin("d0", "d1"))
    return s, s.select("sampler", "dataset", "generator").unionByName(never).distinct(), queued


@register("s1_live_status", trial_sql(f"""
select g.sampler, g.dataset, g.generator,
       coalesce(c.n_complete, 0) as n_complete, coalesce(c.n_running, 0) as n_running,
       coalesce(c.n_fail, 0) as n_fail, coalesce(c.n_pruned, 0) as n_pruned,
       coalesce(c.n_attempted, 0) as n_attempted, round(c.best_objective, 9) as best_objective,
       case when coalesce(c.n_attempted, 0) = 0 then case when g.dataset in ('d0', 'd1') then 'pending' else 'missing' end
            when c.n_running > 0 then 'running'
            when c.n_complete >= {LIVE_TARGET_TRIALS} then 'completed'
            when c.n_fail = c.n_attempted then 'failed'
            else 'started' end as status
from (select distinct sampler, dataset, generator from scored
      union select distinct 'gp', dataset, 'g9' from scored) g
left join (select sampler, dataset, generator,
                  cast(count_if(state = 'COMPLETE') as bigint) as n_complete,
                  cast(count_if(state = 'RUNNING') as bigint) as n_running,
                  cast(count_if(state = 'FAIL') as bigint) as n_fail,
                  cast(count_if(state = 'PRUNED') as bigint) as n_pruned,
                  cast(count(*) as bigint) as n_attempted,
                  max(case when state = 'COMPLETE' then objective end) as best_objective
           from scored
           group by sampler, dataset, generator) c
  on g.sampler = c.sampler and g.dataset = c.dataset and g.generator = c.generator""", summary=False))
def s1_live_status(spark, sf_dir):
    """Live status per (sampler, dataset, generator) with a missing-cell scaffold."""
    log, grid, queued = _live_inputs(spark, sf_dir)
    return r9(LV.live_status(LV.live_counts(log), grid, LIVE_TARGET_TRIALS, queued=queued), "best_objective")


@register("s3_hourly_throughput", trial_sql("""
select cast(floor(f_us / 3600000000e0) as bigint) * 3600 as hour_start, sampler,
       cast(count(*) as bigint) as n_finished, round(avg(objective), 9) as mean_objective
from (select sampler, objective,
             epoch_us(started) + cast(round(coalesce(duration_s, 0e0) * 1e6) as bigint) as f_us
      from scored where state = 'COMPLETE') t
group by 1, 2""", summary=False))
def s3_hourly_throughput(spark, sf_dir):
    """S3: COMPLETE trials finished per hour per sampler and their mean objective."""
    return r9(LV.hourly_throughput(scored(spark, sf_dir), watermark=None), "mean_objective")
