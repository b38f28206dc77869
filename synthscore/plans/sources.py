"""Source / sink queries (inventory A4, A10, B1) over the FX-4 trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import runs as S
from ..sources.fixtures import fx4_trials, with_fixtures
from .common import r9, scored, trial_sql
from .registry import register

A4_LEFT = ["event_id", "dataset", "generator", "sampler", "seed", "trial_number", "state", "fidelity", "utility"]
A4_RIGHT = ["event_id", "dataset", "generator", "sampler", "seed", "trial_number", "state", "privacy_risk",
            "duration_s"]


@register("a4_union_widths", with_fixtures(f"""
select {', '.join(A4_LEFT)} from fx4_trials where sampler = 'standard_tpe'
union all by name
select {', '.join(A4_RIGHT)} from fx4_trials where sampler <> 'standard_tpe'""", "fx4_trials"))
def a4_union_widths(spark, sf_dir):
    """A4: trial files of two shapes unioned by column name (absent columns NULL)."""
    t = fx4_trials(spark, sf_dir)
    return S.union_by_name([t.where(F.col("sampler") == "standard_tpe").select(*A4_LEFT),
                            t.where(F.col("sampler") != "standard_tpe").select(*A4_RIGHT)])


def _wide(spark, sf_dir):
    """Tracker-shaped export of the scored log: text durations, prefixed attributes and params."""
    s = scored(spark, sf_dir)
    return s.select(
        "dataset", "generator", "sampler", "seed", F.col("trial_number").alias("number"),
        F.col("objective").alias("value"), "state",
        F.concat(F.lit("0 days 00:00:"), F.col("duration_s").cast("string")).alias("duration"),
        F.col("fidelity").alias("user_attrs_fidelity"), F.col("utility").alias("user_attrs_utility"),
        F.col("privacy_risk").alias("user_attrs_privacy_risk"),
        F.round(F.col("utility") * 0.1, 6).alias("params_noise_std"),
        (F.col("trial_number") % 3).alias("params_n_layers"))


A10_COLS = ["dataset", "generator", "sampler", "seed", "trial_number", "state", "objective", "fidelity", "utility",
            "privacy_risk", "duration_s", "trial_seed", "error", "param_noise_std", "param_n_layers"]


@register("a10_wide_to_trials", trial_sql("""
select dataset, generator, sampler, seed, trial_number, state, round(objective, 9) as objective, fidelity, utility,
       privacy_risk, duration_s, cast(null as bigint) as trial_seed, cast(null as varchar) as error,
       round(utility * 0.1e0, 6) as param_noise_std, trial_number % 3 as param_n_layers
from scored""", summary=False))
def a10_wide_to_trials(spark, sf_dir):
    """A10: wide tracker export (text durations, user_attrs_*, params_*) back to the trial schema."""
    w = _wide(spark, sf_dir)
    t = S.wide_to_trials(w, F.col("dataset"), F.col("generator"), F.col("sampler"), F.col("seed"))
    return r9(t.select(*A10_COLS), "objective")


@register("b1_master_rows", trial_sql("""
select dataset, generator, status, best_objective as best_value, study_wall_clock_s as elapsed_sec,
       n_attempted as n_trials, round(best_objective, 9) as objective, best_fidelity as fidelity,
       best_utility as utility, best_privacy_risk as privacy_risk,
       cast(null as double) as ks_similarity, cast(null as double) as corr_similarity, cast(null as double) as mia_auc,
       cast(null as double) as nndr, cast(null as double) as dcr, cast(null as double) as mean_f1_gap,
       cast(null as double) as mean_tstr_f1, cast(null as double) as mean_trtr_f1,
       concat(sampler, '/', dataset, '/', generator, '/', cast(seed as varchar)) as run_dir, cast(null as varchar) as error
from summary"""))
def b1_master_rows(spark, sf_dir):
    """B1: study summaries in the fixed 20-column master-log layout (absent metrics NULL)."""
    from .common import summaries
    s = summaries(spark, sf_dir).select(
        "dataset", "generator", "status", F.col("best_objective").alias("best_value"),
        F.col("study_wall_clock_s").alias("elapsed_sec"), F.col("n_attempted").alias("n_trials"),
        F.round("best_objective", 9).alias("objective"), F.col("best_fidelity").alias("fidelity"),
        F.col("best_utility").alias("utility"), F.col("best_privacy_risk").alias("privacy_risk"),
        F.concat_ws("/", "sampler", "dataset", "generator", F.col("seed").cast("string")).alias("run_dir"))
    return S.master_rows(s)


K31_KEYS = "dataset, generator, sampler, seed"


@register("k31_param_importance", trial_sql(f"""
with ptrials as (select {K31_KEYS}, state, objective, round(utility * 0.1e0, 6) as param_noise_std,
                        trial_number % 3 as param_n_layers from scored),
long as (select {K31_KEYS}, objective, 'noise_std' as param, 'float' as kind, param_noise_std as x,
                cast(null as varchar) as c
         from ptrials where state = 'COMPLETE' and objective is not null and param_noise_std is not null
         union all
         select {K31_KEYS}, objective, 'n_layers', 'cat', cast(null as double), cast(param_n_layers as varchar)
         from ptrials where state = 'COMPLETE' and objective is not null and param_n_layers is not null),
rng as (select {K31_KEYS}, param, min(x) as lo, max(x) as hi from long where kind = 'float'
        group by {K31_KEYS}, param),
binned as (select l.*, case when kind = 'float' then cast(cast(case when r.hi > r.lo
             then least(floor((x - r.lo) / (r.hi - r.lo) * 10), 9) else 0 end as bigint) as varchar) else c end as bin
           from long l left join rng r using ({K31_KEYS}, param)),
per_bin as (select {K31_KEYS}, param, bin, count(*) as n_b, avg(objective) as m_b from binned
            group by {K31_KEYS}, param, bin),
tot as (select {K31_KEYS}, param, count(*) as n, avg(objective) as m, var_pop(objective) as v from binned
        group by {K31_KEYS}, param),
btw as (select {K31_KEYS}, param, sum(n_b * (m_b - m) * (m_b - m)) as ss_between, count(*) as n_bins
        from per_bin join tot using ({K31_KEYS}, param) group by {K31_KEYS}, param),
e as (select {K31_KEYS}, param, ss_between / (v * n) as eta2 from tot join btw using ({K31_KEYS}, param)
      where n >= 3 and n_bins >= 2 and v > 0),
i as (select *, eta2 / sum(eta2) over (partition by {K31_KEYS}) as importance from e)
select {K31_KEYS}, param, round(eta2, 6) as eta2, round(importance, 6) as importance,
       cast(row_number() over (partition by {K31_KEYS} order by round(importance, 9) desc, param) as bigint) as rank
from i""", summary=False))
def k31_param_importance(spark, sf_dir):
    """Per-study parameter effect (eta^2, normalised to 1) on the tracker log converted by A10."""
    from ..operators.trials import param_importance
    t = S.wide_to_trials(_wide(spark, sf_dir), F.col("dataset"), F.col("generator"), F.col("sampler"), F.col("seed"))
    e = param_importance(t, {"param_noise_std": "float", "param_n_layers": "cat"}, top_k=5)
    e = e.withColumn("param", F.regexp_replace("param", "^param_", ""))
    return e.select("dataset", "generator", "sampler", "seed", "param", F.round("eta2", 6).alias("eta2"),
                    F.round("importance", 6).alias("importance"), F.col("rank").cast("bigint").alias("rank"))


@register("a9_listed_study_trials", trial_sql(f"""
select event_id, {K31_KEYS}, trial_number, state, round(objective, 9) as objective from scored
where ({K31_KEYS}) in (select {K31_KEYS} from summary where best_objective > 0.6e0
                       union all select {K31_KEYS} from summary where n_fail > 0)"""))
def a9_listed_study_trials(spark, sf_dir):
    """All trials of the studies listed in two (overlapping) summary exports."""
    from .common import summaries
    s = summaries(spark, sf_dir)
    listed = s.where(F.col("best_objective") > 0.6).select(*S.TRIAL_KEYS).unionByName(
        s.where(F.col("n_fail") > 0).select(*S.TRIAL_KEYS))
    t = S.trials_of_listed_studies(listed, scored(spark, sf_dir))
    return r9(t.select("event_id", *S.TRIAL_KEYS, "trial_number", "state", "objective"), "objective")


@register("a11_import_new_studies", trial_sql(f"""
select {K31_KEYS}, cast(count(*) as bigint) as n_trials, cast(count_if(state = 'COMPLETE') as bigint) as n_complete,
       round(max(case when state = 'COMPLETE' then objective end), 9) as best_objective
from scored s
where not exists (select 1 from summary e where e.seed <= 1
                  and e.dataset = s.dataset and e.generator = s.generator and e.sampler = s.sampler and e.seed = s.seed)
group by {K31_KEYS}"""))
def a11_import_new_studies(spark, sf_dir):
    """Import the tracker exports (A10), summarise, skip studies already present (here: seeds 0 and 1)."""
    from .common import summaries
    t = S.wide_to_trials(_wide(spark, sf_dir), F.col("dataset"), F.col("generator"), F.col("sampler"), F.col("seed"))
    existing = summaries(spark, sf_dir).where(F.col("seed") <= 1)
    return r9(S.import_new_studies(t, existing), "best_objective")


@register("c13_expand_weights", trial_sql("""
select event_id, fidelity as w_fidelity, utility as w_utility, privacy_risk as w_privacy_risk, cast(null as double) as w_missing
from scored""", summary=False))
def c13_expand_weights(spark, sf_dir):
    """A JSON text column expanded to one column per key (absent key -> NULL)."""
    from ..operators.clean import expand_json_map
    s = scored(spark, sf_dir).select("event_id", F.to_json(F.struct("fidelity", "utility", "privacy_risk")).alias("weights"))
    return expand_json_map(s, "weights", ["fidelity", "utility", "privacy_risk", "missing"], "w_")
