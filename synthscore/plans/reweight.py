"""Post-hoc re-weighting queries (inventory L) over the FX-4 trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankstats as M
from ..operators import reweight as L
from ..operators.objective import PRESET_ORDER, PRESETS, PRESETS_SQL, clip_sql, objective_expr, presets_frame
from ..operators.trials import STUDY_KEYS
from ..session import cut_lineage
from .common import KEYS_SQL, r9, scored, summaries, trial_sql
from .registry import register
from .stats import friedman_sql, wilcoxon_sql

K = STUDY_KEYS


def assembled(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("state") == "COMPLETE")
    rescore = s.where(F.col("generator") == "g0").withColumn("fidelity", F.col("fidelity") * F.lit(0.9))
    export = s.where(F.col("seed").isin(0, 1))
    return L.assemble_sources([(rescore, 0, "rescore"), (export, 1, "export"), (s, 2, "sensitivity")])


def best(spark, sf_dir):
    return L.best_under_presets(assembled(spark, sf_dir), presets_frame(spark))


def gen_by_preset(spark, sf_dir):
    return L.generator_by_preset(best(spark, sf_dir))


def ds_by_preset(spark, sf_dir):
    return L.dataset_by_preset(gen_by_preset(spark, sf_dir))


def comparison(spark, sf_dir):
    return L.dataset_comparison(ds_by_preset(spark, sf_dir))


def _valid(c):
    return f"{c} is not null and not isnan({c}) and not isinf({c})"


ASM_CTE = ("asm", f"""
select {KEYS_SQL}, trial_number, fidelity, utility, privacy_risk, source from (
  select *, row_number() over (partition by {KEYS_SQL}, trial_number order by prio) as rn from (
    select {KEYS_SQL}, trial_number, fidelity * 0.9e0 as fidelity, utility, privacy_risk, 0 as prio, 'rescore' as source
      from scored where state = 'COMPLETE' and generator = 'g0'
    union all
    select {KEYS_SQL}, trial_number, fidelity, utility, privacy_risk, 1, 'export' from scored
      where state = 'COMPLETE' and seed in (0, 1)
    union all
    select {KEYS_SQL}, trial_number, fidelity, utility, privacy_risk, 2, 'sensitivity' from scored where state = 'COMPLETE'
  ) u where {_valid('fidelity')} and {_valid('utility')} and {_valid('privacy_risk')}
) where rn = 1""")
BEST_CTE = ("best", f"""
select {KEYS_SQL}, n_complete, preset, trial_number as best_trial_number, J as best_J, fidelity as best_F,
       utility as best_U, privacy_risk as best_P from (
  select x.*, count(*) over (partition by {KEYS_SQL}, preset) as n_complete,
         row_number() over (partition by {KEYS_SQL}, preset order by J desc, trial_number) as rn
  from (select a.*, p.preset, p.w_fidelity * {clip_sql('a.fidelity')} + p.w_utility * {clip_sql('a.utility')}
               - p.w_privacy_risk * {clip_sql('a.privacy_risk')} as J
        from asm a, ({PRESETS_SQL}) p) x) where rn = 1""")
GEN_CTE = ("gen", """
select *, row_number() over (partition by preset, sampler, dataset order by mean_J desc, generator) = 1 as is_best from (
  select preset, sampler, dataset, generator, avg(best_J) as mean_J,
         case when count(best_J) > 1 then stddev_samp(best_J) else 0e0 end as std_J,
         avg(best_F) as mean_F, avg(best_U) as mean_U, avg(best_P) as mean_P, count(best_J) as n_seeds
  from best group by preset, sampler, dataset, generator)""")
DS_CTE = ("ds", """
select preset, sampler, dataset, avg(mean_J) as mean_J, avg(mean_F) as mean_F, avg(mean_U) as mean_U, avg(mean_P) as mean_P
from gen group by preset, sampler, dataset""")
CMP_CTE = ("cmp", """
select d.*, row_number() over (partition by preset, dataset order by mean_J desc,
         case sampler when 'standard_tpe' then 0 when 'multivariate_tpe' then 1 else 2 end) as sampler_rank
from ds d where sampler in ('standard_tpe', 'multivariate_tpe', 'gp')
  and (preset, dataset) in (select preset, dataset from ds where sampler in ('standard_tpe', 'multivariate_tpe', 'gp')
                            group by preset, dataset having count(distinct sampler) = 3)""")


def rw_sql(body, *extra):
    return trial_sql(body, ASM_CTE, BEST_CTE, GEN_CTE, DS_CTE, CMP_CTE, *extra, summary=False)


@register("l1_assembled_trials", rw_sql(
    f"select {KEYS_SQL}, trial_number, round(fidelity, 9) as fidelity, utility, privacy_risk, source from asm"))
def l1_assembled_trials(spark, sf_dir):
    """L1: scored trials from three sources with validity filters and source precedence."""
    return r9(assembled(spark, sf_dir), "fidelity")


@register("l2_best_per_preset", rw_sql(f"""
select {KEYS_SQL}, n_complete, preset, best_trial_number, round(best_J, 9) as best_J, round(best_F, 9) as best_F,
       best_U, best_P from best"""))
def l2_best_per_preset(spark, sf_dir):
    """L2: best trial per study under each weight preset."""
    return r9(best(spark, sf_dir), "best_J", "best_F")


GEN_FLOATS = ["mean_J", "std_J", "mean_F", "mean_U", "mean_P"]


@register("l3_generator_by_preset", rw_sql(
    "select preset, sampler, dataset, generator, n_seeds, is_best, "
    + ", ".join(f"round({c}, 9) as {c}" for c in GEN_FLOATS) + " from gen"))
def l3_generator_by_preset(spark, sf_dir):
    """L3: mean / std per preset x sampler x dataset x generator with the is_best flag."""
    return r9(gen_by_preset(spark, sf_dir), *GEN_FLOATS)


@register("l4_dataset_by_preset", rw_sql(
    "select preset, sampler, dataset, " + ", ".join(f"round(mean_{c}, 9) as mean_{c}" for c in "JFUP") + " from ds"))
def l4_dataset_by_preset(spark, sf_dir):
    """L4: dataset-level means (unweighted over generators) per preset x sampler."""
    return r9(ds_by_preset(spark, sf_dir), *[f"mean_{c}" for c in "JFUP"])


@register("l5_dataset_comparison", rw_sql("""
select preset, dataset, sampler, round(mean_J, 9) as mean_J, sampler_rank,
       max(case when sampler_rank = 1 then sampler end) over (partition by preset, dataset) as best_sampler
from cmp"""))
def l5_dataset_comparison(spark, sf_dir):
    """Sampler means side by side per preset and dataset, strict ranks, best sampler."""
    c = comparison(spark, sf_dir)
    b = c.where(F.col("sampler_rank") == 1).select("preset", "dataset", F.col("sampler").alias("best_sampler"))
    return r9(c.join(b, ["preset", "dataset"]).select("preset", "dataset", "sampler", "mean_J", "sampler_rank",
                                                       "best_sampler"), "mean_J")


@register("l6_sampler_summary", rw_sql("""
select s.preset, s.sampler, round(s.dataset_level_mean_J, 9) as dataset_level_mean_J, round(s.avg_rank, 9) as avg_rank,
       s.dataset_wins, h.cells_std_ge_0_10
from (select preset, sampler, avg(mean_J) as dataset_level_mean_J, avg(sampler_rank) as avg_rank,
             count_if(sampler_rank = 1) as dataset_wins
      from cmp where preset in (select preset from cmp group by preset having count(distinct dataset) >= 3)
      group by preset, sampler) s
left join (select preset, sampler, count_if(std_J >= 0.10) as cells_std_ge_0_10 from gen group by preset, sampler) h
  using (preset, sampler)"""))
def l6_sampler_summary(spark, sf_dir):
    """Per preset x sampler mean J, mean rank, wins and high-variance cells."""
    s = L.sampler_summary(comparison(spark, sf_dir), gen_by_preset(spark, sf_dir))
    return r9(s, "dataset_level_mean_J", "avg_rank")


def _preset_stats_input(spark, sf_dir):
    c = cut_lineage(comparison(spark, sf_dir))
    enough = c.groupBy("preset").agg(F.countDistinct("dataset").alias("_n")).where(F.col("_n") >= 3)
    out = c.join(enough, "preset", "left_semi").select("preset", "dataset", "sampler", F.col("mean_J").alias("mean_best_j"))
    return cut_lineage(out.coalesce(1))  # one row per preset, dataset and sampler; the tests read it many times


PSTAT_CTE = ("pstat", """select preset, dataset, sampler, mean_J as mean_best_j from cmp
  where preset in (select preset from cmp group by preset having count(distinct dataset) >= 3)""")
LPAIRS = [("standard_tpe", "multivariate_tpe", "ST vs MT"), ("standard_tpe", "gp", "ST vs GP"),
          ("multivariate_tpe", "gp", "MT vs GP")]


@register("l7_friedman_by_preset", rw_sql("""
select preset, n_blocks, n_treatments, round(chi2, 9) as chi2, df, round(p_value, 9) as p_value,
       round(kendalls_w, 9) as kendalls_w from (""" + friedman_sql("pstat", "preset") + ")", PSTAT_CTE))
def l7_friedman_by_preset(spark, sf_dir):
    """Friedman test per preset over datasets x samplers."""
    f = M.friedman(_preset_stats_input(spark, sf_dir), "dataset", "sampler", "mean_best_j", ["preset"])
    return r9(f, "chi2", "p_value", "kendalls_w")


SHORT_SQL = "case {c} when 'standard_tpe' then 'ST' when 'multivariate_tpe' then 'MT' else 'GP' end"


@register("l7_wilcoxon_by_preset", rw_sql(f"""
select preset, comparison, round(mean_delta_a_minus_b, 9) as mean_delta_a_minus_b, n_a_better, n_b_better,
       round(wilcoxon_stat, 9) as wilcoxon_stat, round(p_raw, 9) as p_raw, round(p_holm, 9) as p_holm,
       case when p_holm <= 0.05 and mean_delta_a_minus_b > 0 then {SHORT_SQL.format(c='a')} || ' > ' || {SHORT_SQL.format(c='b')}
            when p_holm <= 0.05 then {SHORT_SQL.format(c='b')} || ' > ' || {SHORT_SQL.format(c='a')}
            else {SHORT_SQL.format(c='a')} || ' ≈ ' || {SHORT_SQL.format(c='b')} end as conclusion
from (""" + wilcoxon_sql("pstat", LPAIRS, "preset", 1e-5, "null") + ")", PSTAT_CTE))
def l7_wilcoxon_by_preset(spark, sf_dir):
    """Pairwise Wilcoxon + Holm per preset with the conclusion text."""
    w = M.wilcoxon_pairs(_preset_stats_input(spark, sf_dir), "dataset", "sampler", "mean_best_j", LPAIRS, ["preset"],
                         allclose_rel=1e-5, degenerate_stat=None)
    h = M.holm(w, group_cols=["preset"])
    short = F.create_map(*[x for kv in L.SHORT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    h = h.withColumn("conclusion", L.conclusion(F.col("mean_delta_a_minus_b"), F.col("p_holm") <= 0.05,
                                                F.element_at(short, F.col("a")), F.element_at(short, F.col("b"))))
    return r9(h.select("preset", "comparison", "mean_delta_a_minus_b", "n_a_better", "n_b_better", "wilcoxon_stat",
                       "p_raw", "p_holm", "conclusion"), "mean_delta_a_minus_b", "wilcoxon_stat", "p_raw", "p_holm")


@register("l8_generator_by_preset_overall", rw_sql(
    "select preset, generator, " + ", ".join(f"round(avg(mean_{c}), 9) as mean_{c}" for c in "JFUP")
    + " from gen group by preset, generator"))
def l8_generator_by_preset_overall(spark, sf_dir):
    """Generator means per preset."""
    g = gen_by_preset(spark, sf_dir).groupBy("preset", "generator").agg(
        *[F.avg(f"mean_{c}").alias(f"mean_{c}") for c in "JFUP"])
    return r9(g, *[f"mean_{c}" for c in "JFUP"])


@register("l9_best_shift", rw_sql(f"""
select b.preset, count(*) as studies, count_if(b.best_trial_number <> o.best_trial_number) as best_trial_changed,
       round(100e0 * count_if(b.best_trial_number <> o.best_trial_number) / count(*), 1) as pct_changed
from best b join best o using ({KEYS_SQL}) where o.preset = 'O1' and b.preset <> 'O1' group by b.preset"""))
def l9_best_shift(spark, sf_dir):
    """Studies whose best trial changes against O1, per preset."""
    return L.best_shift(best(spark, sf_dir))


@register("l16_generator_preset_matrix", rw_sql(
    "select generator, " + ", ".join(f"round(avg(case when preset = '{p}' then mean_J end), 9) as {p}" for p in PRESET_ORDER)
    + " from gen group by generator"))
def l16_generator_preset_matrix(spark, sf_dir):
    """Generator x preset matrix of mean J, presets in fixed order O1..O5."""
    g = gen_by_preset(spark, sf_dir).groupBy("generator").pivot("preset", PRESET_ORDER).agg(F.avg("mean_J"))
    return r9(g, *PRESET_ORDER)


@register("l18_cardinality_check", rw_sql(f"""
select (select count(*) from best) as n_rows, (select count(*) from (select distinct {KEYS_SQL} from asm)) * 5 as n_expected,
       (select count(*) from best) = (select count(*) from (select distinct {KEYS_SQL} from asm)) * 5 as ok"""))
def l18_cardinality_check(spark, sf_dir):
    """The best-under-preset table has studies x 5 rows."""
    b = best(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))
    e = assembled(spark, sf_dir).select(*K).distinct().agg((F.count(F.lit(1)) * 5).alias("n_expected"))
    return b.crossJoin(e).withColumn("ok", F.col("n_rows") == F.col("n_expected"))


# ---------------------------------------------------------------- sensitivity-run views (L10 .. L19)
def sensitivity_trials(spark, sf_dir):
    """Sensitivity runs: each seed of FX-4 re-read as a search under preset O(seed+1); weights are
    recorded for configs O1 and O2 only (L17 falls back to the preset for the others)."""
    s = scored(spark, sf_dir).where(F.col("state") == "COMPLETE")
    cfg = F.concat(F.lit("O"), (F.col("seed") + 1).cast("string"))
    p = presets_frame(spark).select("preset", "w_fidelity", "w_utility", "w_privacy_risk")
    x = s.withColumn("config", cfg).join(F.broadcast(p), F.col("config") == F.col("preset"))
    rec = F.col("config").isin("O1", "O2")
    x = x.withColumn("weights_json", F.when(rec, F.to_json(F.struct(
        F.col("w_fidelity").alias("fidelity"), F.col("w_utility").alias("utility"),
        F.col("w_privacy_risk").alias("privacy_risk")))))
    return x.select("dataset", "generator", "config", "trial_number", "fidelity", "utility", "privacy_risk",
                    "duration_s", "weights_json", "w_fidelity", "w_utility", "w_privacy_risk")


def effective(spark, sf_dir):
    """Effective weights = recorded JSON weights, else the preset's."""
    x = sensitivity_trials(spark, sf_dir)
    j = F.from_json("weights_json", "fidelity double, utility double, privacy_risk double")
    x = x.withColumn("_w", j)
    x = (x.withColumn("ew_fidelity", F.coalesce(F.col("_w.fidelity"), F.col("w_fidelity")))
         .withColumn("ew_utility", F.coalesce(F.col("_w.utility"), F.col("w_utility")))
         .withColumn("ew_privacy_risk", F.coalesce(F.col("_w.privacy_risk"), F.col("w_privacy_risk"))).drop("_w"))
    return x.withColumn("J", objective_expr(F.col("fidelity"), F.col("utility"), F.col("privacy_risk"),
                                            F.col("ew_fidelity"), F.col("ew_utility"), F.col("ew_privacy_risk")))


SENS_CTE = ("sens", f"""
select s.dataset, s.generator, 'O' || cast(s.seed + 1 as varchar) as config, s.trial_number, s.fidelity, s.utility,
       s.privacy_risk, s.duration_s, p.w_fidelity as ew_fidelity, p.w_utility as ew_utility,
       p.w_privacy_risk as ew_privacy_risk,
       p.w_fidelity * {clip_sql('s.fidelity')} + p.w_utility * {clip_sql('s.utility')}
         - p.w_privacy_risk * {clip_sql('s.privacy_risk')} as J
from scored s join ({PRESETS_SQL}) p on p.preset = 'O' || cast(s.seed + 1 as varchar) where s.state = 'COMPLETE'""")
SBEST_CTE = ("sbest", """
select dataset, generator, config, trial_number as best_trial_number, J as best_J, fidelity as best_F, utility as best_U,
       privacy_risk as best_P, n_trials, hours from (
  select *, row_number() over (partition by dataset, generator, config order by J desc, trial_number) as rn,
         count(*) over (partition by dataset, generator, config) as n_trials,
         sum(duration_s) over (partition by dataset, generator, config) / 3600e0 as hours
  from sens) where rn = 1""")


def sens_best(spark, sf_dir):
    e = effective(spark, sf_dir)
    b = e.groupBy("dataset", "generator", "config").agg(
        F.max_by(F.struct("trial_number", "J", "fidelity", "utility", "privacy_risk"),
                 F.struct(F.col("J"), -F.col("trial_number"))).alias("_b"),
        F.count(F.lit(1)).alias("n_trials"), (F.sum("duration_s") / F.lit(3600.0)).alias("hours"))
    return b.select("dataset", "generator", "config", F.col("_b.trial_number").alias("best_trial_number"),
                    F.col("_b.J").alias("best_J"), F.col("_b.fidelity").alias("best_F"),
                    F.col("_b.utility").alias("best_U"), F.col("_b.privacy_risk").alias("best_P"), "n_trials", "hours")


def sens_sql(body, *extra):
    return trial_sql(body, SENS_CTE, SBEST_CTE, *extra, summary=False)


@register("l10_sensitivity_best", sens_sql("""
select dataset, generator, config, best_trial_number, round(best_J, 9) as best_J, best_F, best_U, best_P, n_trials,
       round(hours, 9) as hours from sbest"""))
def l10_sensitivity_best(spark, sf_dir):
    """Sensitivity best-trial table per dataset x generator x config."""
    return r9(sens_best(spark, sf_dir), "best_J", "hours")


@register("l11_config_means", sens_sql("""
select m.config, round(m.mean_F, 9) as mean_F, round(m.mean_U, 9) as mean_U, round(m.mean_P, 9) as mean_P,
       round(m.mean_J, 9) as mean_J, m.n_studies, g.generator as best_generator
from (select config, avg(best_F) as mean_F, avg(best_U) as mean_U, avg(best_P) as mean_P, avg(best_J) as mean_J,
             count(*) as n_studies from sbest group by config) m
join (select config, generator, row_number() over (partition by config order by avg(best_J) desc, generator) as rn
      from sbest group by config, generator) g on g.config = m.config and g.rn = 1"""))
def l11_config_means(spark, sf_dir):
    """Per config means of F / U / P / J, number of studies and the best generator."""
    b = sens_best(spark, sf_dir)
    m = b.groupBy("config").agg(*[F.avg(f"best_{c}").alias(f"mean_{c}") for c in "FUPJ"],
                                F.count(F.lit(1)).alias("n_studies"))
    g = b.groupBy("config", "generator").agg(F.avg("best_J").alias("_j")).groupBy("config").agg(
        F.min_by("generator", F.struct(-F.col("_j"), F.col("generator"))).alias("best_generator"))
    return r9(m.join(g, "config"), *[f"mean_{c}" for c in "FUPJ"])


@register("l12_generator_comparison", sens_sql("""
select config, generator, round(avg(best_J), 9) as mean_J, round(case when count(*) >= 2 then stddev_samp(best_J) end, 9) as std_J,
       count(*) as n_datasets, sum(case when best_on_dataset then 1 else 0 end) as n_best_on_dataset
from (select *, row_number() over (partition by config, dataset order by best_J desc, generator) = 1 as best_on_dataset from sbest)
group by config, generator"""))
def l12_generator_comparison(spark, sf_dir):
    """Generator comparison inside a config (std blank for n < 2, best-on-dataset counts)."""
    from pyspark.sql import Window
    b = sens_best(spark, sf_dir)
    w = Window.partitionBy("config", "dataset").orderBy(F.col("best_J").desc(), F.col("generator"))
    b = b.withColumn("_best", F.row_number().over(w) == 1)
    n = F.count(F.lit(1))
    g = b.groupBy("config", "generator").agg(
        F.avg("best_J").alias("mean_J"), F.when(n >= 2, F.stddev_samp("best_J")).alias("std_J"),
        n.alias("n_datasets"), F.sum(F.when(F.col("_best"), 1).otherwise(0)).cast("bigint").alias("n_best_on_dataset"))
    return r9(g, "mean_J", "std_J")


@register("l13_best_trial_lookup", sens_sql("""
select dataset, generator, config, best_trial_number from sbest"""))
def l13_best_trial_lookup(spark, sf_dir):
    """Best trial number per sensitivity study."""
    return sens_best(spark, sf_dir).select("dataset", "generator", "config", "best_trial_number")


@register("l14_wall_hours", trial_sql("""
select sampler, round(sum(total_time_s) / 3600e0, 9) as hours, round(sum(total_time_s) / 86400e0, 9) as days,
       round(sum(case when generator = 'g0' then total_time_s else 0e0 end) / sum(total_time_s), 9) as g0_share
from summary group by sampler"""))
def l14_wall_hours(spark, sf_dir):
    """Wall-hours and days per sampler and one generator's share of the total."""
    s = summaries(spark, sf_dir).groupBy("sampler").agg(
        (F.sum("total_time_s") / F.lit(3600.0)).alias("hours"), (F.sum("total_time_s") / F.lit(86400.0)).alias("days"),
        (F.sum(F.when(F.col("generator") == "g0", F.col("total_time_s")).otherwise(F.lit(0.0)))
         / F.sum("total_time_s")).alias("g0_share"))
    return r9(s, "hours", "days", "g0_share")


@register("l15_dataset_generator_matrix", sens_sql("""
select dataset, generator, round(mean_J, 9) as mean_J, round(std_J, 9) as std_J, round(hours, 9) as hours from (
  select dataset, generator, avg(best_J) as mean_J, case when count(*) > 1 then stddev_samp(best_J) end as std_J,
         sum(hours) as hours from sbest group by dataset, generator
  union all
  select 'MEAN / SUM' as dataset, generator, avg(mean_J), null, sum(hours) from (
    select dataset, generator, avg(best_J) as mean_J, sum(hours) as hours from sbest group by dataset, generator)
  group by generator)"""))
def l15_dataset_generator_matrix(spark, sf_dir):
    """Dataset x generator matrix (mean, std, hours) with a bottom MEAN / SUM row per generator."""
    b = sens_best(spark, sf_dir)
    n = F.count(F.lit(1))
    cells = b.groupBy("dataset", "generator").agg(
        F.avg("best_J").alias("mean_J"), F.when(n > 1, F.stddev_samp("best_J")).alias("std_J"),
        F.sum("hours").alias("hours"))
    total = cells.groupBy("generator").agg(F.avg("mean_J").alias("mean_J"), F.sum("hours").alias("hours")).select(
        F.lit("MEAN / SUM").alias("dataset"), "generator", "mean_J", F.lit(None).cast("double").alias("std_J"), "hours")
    return r9(cells.unionByName(total), "mean_J", "std_J", "hours")


@register("l17_effective_weights", sens_sql("""
select distinct config, ew_fidelity, ew_utility, ew_privacy_risk from sens"""))
def l17_effective_weights(spark, sf_dir):
    """Effective weights per config (recorded weights win over the preset's)."""
    return effective(spark, sf_dir).select("config", "ew_fidelity", "ew_utility", "ew_privacy_risk").distinct()


@register("l19_config_performance", sens_sql("""
select config, generator, dataset, best_trial_number, round(best_J, 9) as best_J, n_trials, round(hours, 9) as hours,
       best_J = max(best_J) over (partition by config) as is_config_best from sbest"""))
def l19_config_performance(spark, sf_dir):
    """Performance table of each config with the best row flagged."""
    from pyspark.sql import Window
    b = sens_best(spark, sf_dir)
    b = b.withColumn("is_config_best", F.col("best_J") == F.max("best_J").over(Window.partitionBy("config")))
    return r9(b.select("config", "generator", "dataset", "best_trial_number", "best_J", "n_trials", "hours",
                       "is_config_best"), "best_J", "hours")


_ = PRESETS
