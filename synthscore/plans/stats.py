"""Seed / dataset level statistics and tests (inventory M) over the FX-4 trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rankstats as M
from ..operators.quantiles import exact_quantiles
from ..operators.trials import PAIRS, SAMPLER_ORDER
from ..session import cut_lineage
from .common import r9, summaries, trial_sql
from .registry import register

SEEDS = [0, 1, 2, 3]  # the FX-4 seeds
# Display labels of the samplers.
SAMPLER_LABEL = {"standard_tpe": "Standard TPE", "multivariate_tpe": "Multivariate TPE", "gp": "Gaussian Process"}
STAT_PAIRS = [("standard_tpe", "multivariate_tpe", "Standard TPE vs Multivariate TPE"),
              ("standard_tpe", "gp", "Standard TPE vs Gaussian Process"),
              ("multivariate_tpe", "gp", "Multivariate TPE vs Gaussian Process")]


def seed_df(spark, sf_dir):
    return M.seed_level(summaries(spark, sf_dir))


def dataset_df(spark, sf_dir):
    return M.dataset_level(seed_df(spark, sf_dir), SEEDS)


def dataset_table(spark, sf_dir):
    """``dataset_df`` written once: the tests read it many times, and it has a row per dataset and sampler."""
    return cut_lineage(dataset_df(spark, sf_dir).coalesce(1))


SEED_CTE = ("seedlvl", """
select dataset, sampler, seed, avg(best_objective) as best_objective, count(best_objective) as n_generators,
       max(best_objective) as best_objective_max_over_gens, stddev_samp(best_objective) as best_objective_std_over_gens
from summary where best_objective is not null group by dataset, sampler, seed""")
DS_CTE = ("dslvl", """
select dataset, sampler, count(best_objective) as n_seeds, avg(best_objective) as mean_best_j,
       case when count(best_objective) > 1 then stddev_samp(best_objective) else 0e0 end as std_best_j,
       max(best_objective) as max_best_j, min(best_objective) as min_best_j,
       case when count(best_objective) > 1 and avg(best_objective) <> 0 then stddev_samp(best_objective) / avg(best_objective) end as cv_best_j,
""" + ",\n".join(f"       max(case when seed = {s} then best_objective end) as seed_{s}" for s in SEEDS) + """
from seedlvl group by dataset, sampler""")
RANK_CTE = ("ranked", """
select *, rank() over (partition by dataset order by mean_best_j desc)
          + (count(*) over (partition by dataset, mean_best_j) - 1) / 2e0 as rank
from dslvl""")


def stats_sql(body: str, *extra) -> str:
    return trial_sql(body, SEED_CTE, DS_CTE, RANK_CTE, *extra)


@register("m1_seed_level", stats_sql("""
select dataset, sampler, seed, round(best_objective, 9) as best_objective, n_generators,
       round(best_objective_max_over_gens, 9) as best_objective_max_over_gens,
       round(best_objective_std_over_gens, 9) as best_objective_std_over_gens from seedlvl"""))
def m1_seed_level(spark, sf_dir):
    """M1: per (dataset, sampler, seed) mean / max / std of study-best J over generators."""
    return r9(seed_df(spark, sf_dir), "best_objective", "best_objective_max_over_gens", "best_objective_std_over_gens")


M2_FLOATS = ["mean_best_j", "std_best_j", "max_best_j", "min_best_j", "cv_best_j"] + [f"seed_{s}" for s in SEEDS]


@register("m2_dataset_level", stats_sql(
    "select dataset, sampler, n_seeds, " + ", ".join(f"round({c}, 9) as {c}" for c in M2_FLOATS) + " from dslvl"))
def m2_dataset_level(spark, sf_dir):
    """M2: per (dataset, sampler) mean / std / min / max / CV over seeds, one column per seed."""
    return r9(dataset_df(spark, sf_dir), *M2_FLOATS)


@register("m3_descriptives", stats_sql("""
select a.sampler, a.n_datasets, round(a.mean, 9) as mean, round(a.std, 9) as std, round(a.min, 9) as min,
       round(a.max, 9) as max, round(a.average_rank, 9) as average_rank, a.n_wins_exclusive_rank1,
       a.n_wins_including_ties, round(a.q1, 9) as q1, round(a.median, 9) as median, round(a.q3, 9) as q3,
       round(a.q3 - a.q1, 9) as iqr
from (select r.sampler, count(r.mean_best_j) as n_datasets, avg(r.mean_best_j) as mean, stddev_samp(r.mean_best_j) as std,
             min(r.mean_best_j) as min, max(r.mean_best_j) as max, avg(r.rank) as average_rank,
             count_if(r.rank = 1.0) as n_wins_exclusive_rank1, count_if(r.mean_best_j = b.mx) as n_wins_including_ties,
             quantile_cont(r.mean_best_j, 0.25) as q1, quantile_cont(r.mean_best_j, 0.5) as median,
             quantile_cont(r.mean_best_j, 0.75) as q3
      from ranked r join (select dataset, max(mean_best_j) as mx from dslvl group by dataset) b using (dataset)
      group by r.sampler) a"""))
def m3_descriptives(spark, sf_dir):
    """M3: descriptive statistics, average rank and wins per sampler."""
    d = M.descriptives(dataset_table(spark, sf_dir), exact_quantiles)
    return r9(d, "mean", "std", "min", "max", "average_rank", "q1", "median", "q3", "iqr")


@register("m4_dataset_ranks", stats_sql(
    "select dataset, sampler, round(mean_best_j, 9) as mean_best_j, rank from ranked"))
def m4_dataset_ranks(spark, sf_dir):
    """M4: rank of each sampler inside each dataset (ties averaged, 1 = best)."""
    r = M.average_ranks(dataset_df(spark, sf_dir), "dataset", "mean_best_j")
    return r9(r.select("dataset", "sampler", "mean_best_j", "rank"), "mean_best_j")


@register("m4_average_ranks", stats_sql(
    "select sampler, round(avg(rank), 9) as average_rank, count(*) as n_datasets from ranked group by sampler"))
def m4_average_ranks(spark, sf_dir):
    """M4: average rank per sampler over datasets (the flagship 'which sampler wins' answer)."""
    r = M.average_ranks(dataset_df(spark, sf_dir), "dataset", "mean_best_j")
    a = r.groupBy("sampler").agg(F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n_datasets"))
    return r9(a, "average_rank")


# ---------------------------------------------------------------- SQL twins of the p-value helpers
def erfc_sql(x: str) -> str:
    c = M.ERFC_COEFFS
    poly = f"{c[-1]!r}"
    for v in reversed(c[1:-1]):
        poly = f"({v!r} + t * {poly})"
    return (f"(select case when xx >= 0 then ans else 2e0 - ans end from (select xx, t * exp(-abs(xx) * abs(xx) + {c[0]!r} "
            f"+ t * {poly}) as ans from (select xx, 1e0 / (1e0 + 0.5e0 * abs(xx)) as t from (select ({x}) as xx))))")


def chi2_sf_sql(x: str, df: str) -> str:
    y = f"(({x}) / 2e0)"
    m = f"cast(floor(({df}) / 2e0) as integer)"
    even = (f"exp(-{y}) * list_reduce(range(0, greatest({m}, 1)), lambda acc, i: {{'s': acc.s + acc.t, "
            f"'t': acc.t * {y} / (i + 1)}}, {{'s': 0e0, 't': 1e0}}).s")
    odd = (f"{erfc_sql(f'sqrt({y})')} + case when {m} > 0 then exp(-{y}) * list_reduce(range(0, greatest({m}, 1)), "
           f"lambda acc, i: {{'s': acc.s + acc.t, 't': acc.t * {y} / (i + 1.5e0)}}, "
           f"{{'s': 0e0, 't': sqrt({y}) / 0.886226925452758e0}}).s else 0e0 end")
    return f"(case when ({x}) is null then null when ({x}) <= 0 then 1e0 when ({df}) % 2 = 0 then {even} else {odd} end)"


FRIEDMAN_CTE = ("fried", f"""
select n as n_blocks, k as n_treatments, chi2, k - 1 as df, {chi2_sf_sql('chi2', 'k - 1')} as p_value,
       chi2 / (n * (k - 1)) as kendalls_w
from (select n, k, (12e0 / (n * k * (k + 1)) * sum_r2 - 3e0 * n * (k + 1)) / (1e0 - tie_sum / (n * k * (k * k - 1e0))) as chi2
      from (select count(*) as k, max(nb) as n, sum(r * r) as sum_r2 from
              (select sampler, sum(arank) as r, count(*) as nb from asc_ranked group by sampler)) a,
           (select sum(t * t * t - t) as tie_sum from (select count(*) as t from asc_ranked group by dataset, mean_best_j)) b)""")
ASC_CTE = ("asc_ranked", """
select *, rank() over (partition by dataset order by mean_best_j)
          + (count(*) over (partition by dataset, mean_best_j) - 1) / 2e0 as arank
from dslvl where dataset in (select dataset from dslvl where mean_best_j is not null group by dataset
                             having count(distinct sampler) = (select count(distinct sampler) from dslvl where mean_best_j is not null))
  and mean_best_j is not null""")


@register("m5_friedman", stats_sql("""
select n_blocks, n_treatments, round(chi2, 9) as chi2, df, round(p_value, 9) as p_value, round(kendalls_w, 9) as kendalls_w
from fried""", ASC_CTE, FRIEDMAN_CTE))
def m5_friedman(spark, sf_dir):
    """M5: Friedman chi-square (tie corrected), p-value and Kendall's W over complete datasets."""
    f = M.friedman(dataset_table(spark, sf_dir), "dataset", "sampler", "mean_best_j", treatments=SAMPLER_ORDER)
    return r9(f, "chi2", "p_value", "kendalls_w")


def _pairs_sql(pairs) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, '{lbl}' as comparison" for a, b, lbl in pairs)


def wilcoxon_sql(src: str, pairs, group: str = "", allclose_rel: float = 0.0, degenerate_stat: str = "0e0") -> str:
    """SQL twin of wilcoxon_pairs + holm over ``src`` (block = dataset, treatment = sampler, value = mean_best_j)."""
    g = f"{group}, " if group else ""
    gj = f" and x.{group} = y.{group}" if group else ""
    return f"""
with pr as ({_pairs_sql(pairs)}),
d as (select {'x.' + group + ', ' if group else ''}p.comparison, p.a, p.b, x.dataset, x.mean_best_j as xa, y.mean_best_j as xb,
             x.mean_best_j - y.mean_best_j as d
      from pr p join {src} x on x.sampler = p.a join {src} y on y.sampler = p.b and y.dataset = x.dataset{gj}),
nz as (select *, abs(d) as ad from d where d <> 0),
r as (select *, rank() over (partition by {g}comparison, a, b order by ad)
                + (count(*) over (partition by {g}comparison, a, b, ad) - 1) / 2e0 as r from nz),
rk as (select {g}comparison, a, b, sum(case when d > 0 then r else 0e0 end) as r_plus,
              sum(case when d < 0 then r else 0e0 end) as r_minus, count(*) as n_nz from r group by {g}comparison, a, b),
tie as (select {g}comparison, a, b, sum(t * (t * t - 1)) as tie_sum, max(t) as max_t
        from (select {g}comparison, a, b, ad, count(*) as t from nz group by {g}comparison, a, b, ad) group by {g}comparison, a, b),
base as (select {g}comparison, a, b, avg(xa) as mean_a, avg(xb) as mean_b, avg(d) as mean_delta_a_minus_b,
                count_if(d > 0) as n_a_better, count_if(d < 0) as n_b_better, count_if(d = 0) as n_ties,
                count_if(abs(d) > 1e-8 + cast({allclose_rel!r} as double) * abs(xb)) as n_far from d group by {g}comparison, a, b),
w as (select base.*, coalesce(rk.n_nz, 0) as n, least(rk.r_plus, rk.r_minus) as stat, tie.tie_sum, tie.max_t
      from base left join rk using ({g}comparison, a, b) left join tie using ({g}comparison, a, b)),
pv as (select w.*,
         (n_far = 0 or n = 0) as degenerate,
         case when n <= {M.EXACT_MAX_N} and n_ties = 0 and coalesce(max_t, 1) = 1 and n > 0 then
           least(1e0, 2e0 * list_sum(list_slice(list_reduce(range(1, n + 1),
             lambda c, i: list_transform(range(0, cast(n * (n + 1) / 2 as integer) + 1),
                                         lambda s: c[s + 1] + case when s >= i then c[s - i + 1] else 0 end),
             list_transform(range(0, cast(n * (n + 1) / 2 as integer) + 1), lambda s: case when s = 0 then 1 else 0 end)::bigint[]),
             1, cast(floor(stat) as integer) + 1)) / pow(2e0, n))
         else 2e0 * 0.5e0 * {erfc_sql('abs(stat - n * (n + 1) * 0.25e0) / sqrt((n * (n + 1) * (2 * n + 1) - 0.5e0 * coalesce(tie_sum, 0)) / 24e0) / sqrt(2e0)')}
         end as p_calc
       from w),
fin as (select *, case when degenerate then {degenerate_stat} else stat end as wilcoxon_stat,
               case when degenerate then 1e0 else p_calc end as p_raw from pv),
hl as (select *, row_number() over (partition by {g[:-2] if g else '1'} order by p_raw, comparison) as i,
              count(*) over (partition by {g[:-2] if g else '1'}) as m from fin)
select {g}comparison, a, b, mean_a, mean_b, mean_delta_a_minus_b, n_a_better, n_b_better, n_ties, wilcoxon_stat, p_raw,
       max(least(1e0, (m - i + 1) * p_raw)) over (partition by {g[:-2] if g else '1'} order by i
                                                   rows between unbounded preceding and current row) as p_holm
from hl"""


@register("m6_wilcoxon_holm", stats_sql(f"""
select comparison, a, b, round(mean_a, 9) as mean_a, round(mean_b, 9) as mean_b,
       round(mean_delta_a_minus_b, 9) as mean_delta_a_minus_b, n_a_better, n_b_better, n_ties,
       round(wilcoxon_stat, 9) as wilcoxon_stat, round(p_raw, 9) as p_raw, round(p_holm, 9) as p_holm,
       p_holm <= 0.05 as significant_holm_0_05,
       case when abs(mean_delta_a_minus_b) < 1e-15 then 'no difference'
            when mean_delta_a_minus_b > 0 then la.label || ' higher mean (numerically)'
            else lb.label || ' higher mean (numerically)' end as direction
from wx join labels_a la on la.sampler = wx.a join labels_a lb on lb.sampler = wx.b""",
    ("wx", "select * from (" + wilcoxon_sql("dslvl", STAT_PAIRS).replace("\n", "\n  ") + ")"),
    ("labels_a", " union all ".join(f"select '{k}' as sampler, '{v}' as label" for k, v in SAMPLER_LABEL.items()))))
def m6_wilcoxon_holm(spark, sf_dir):
    """M6 / M7 / M8: pairwise Wilcoxon signed-rank, Holm adjustment and direction labels."""
    w = M.wilcoxon_pairs(dataset_table(spark, sf_dir), "dataset", "sampler", "mean_best_j", STAT_PAIRS)
    h = M.holm(w)
    lab = F.create_map(*[x for kv in SAMPLER_LABEL.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    h = h.withColumn("direction", M.direction_label(F.col("mean_delta_a_minus_b"), F.element_at(lab, F.col("a")),
                                                    F.element_at(lab, F.col("b"))))
    return r9(h, "mean_a", "mean_b", "mean_delta_a_minus_b", "wilcoxon_stat", "p_raw", "p_holm")


@register("m9_nemenyi", stats_sql("""
select n_treatments, n_blocks,
       round(case n_treatments """ + " ".join(f"when {k} then {v!r}e0" for k, v in M.NEMENYI_Q05.items()) + """ end
             * sqrt(n_treatments * (n_treatments + 1) / (6e0 * n_blocks)), 9) as critical_difference
from fried""", ASC_CTE, FRIEDMAN_CTE))
def m9_nemenyi(spark, sf_dir):
    """M9: Nemenyi critical difference for the Friedman design."""
    f = M.friedman(dataset_table(spark, sf_dir), "dataset", "sampler", "mean_best_j", treatments=SAMPLER_ORDER)
    cd = M.nemenyi_cd(F.col("n_treatments").cast("double"), F.col("n_blocks").cast("double"))
    return r9(f.select("n_treatments", "n_blocks", cd.alias("critical_difference")), "critical_difference")


@register("m10_seed_consistency", stats_sql("""
select sampler, round(avg(mean_best_j), 9) as mean_of_dataset_seed_means, round(avg(std_best_j), 9) as mean_of_dataset_seed_stds,
       round(avg(cv_best_j), 9) as mean_cv, count(*) as n_datasets,
       round(median(std_best_j), 9) as median_of_dataset_seed_stds, round(median(cv_best_j), 9) as median_cv
from dslvl group by sampler"""))
def m10_seed_consistency(spark, sf_dir):
    """Per sampler mean / median of per-dataset seed std and CV."""
    s = M.seed_consistency(dataset_df(spark, sf_dir), exact_quantiles)
    return r9(s, "mean_of_dataset_seed_means", "mean_of_dataset_seed_stds", "mean_cv", "median_of_dataset_seed_stds",
              "median_cv")


@register("m11_winners", stats_sql("""
select dataset, sampler, round(mean_best_j, 9) as mean_best_j,
       (count(*) over (partition by dataset)) - (rank() over (partition by dataset order by mean_best_j desc) - 1)
         - (count(*) over (partition by dataset, mean_best_j)) = (count(*) over (partition by dataset)) - 1 as beats_all,
       (count(*) over (partition by dataset)) - (rank() over (partition by dataset order by mean_best_j desc) - 1)
         - (count(*) over (partition by dataset, mean_best_j)) as n_beaten
from dslvl"""))
def m11_winners(spark, sf_dir):
    """Per dataset and sampler: beats all others? how many beaten?"""
    return r9(M.winners(dataset_df(spark, sf_dir)), "mean_best_j")


@register("m12_dataset_winner", stats_sql("""
select dataset, sampler as winner, round(mean_best_j, 9) as winner_value from (
  select d.*, row_number() over (partition by dataset order by mean_best_j desc, o.s_order) as rn
  from dslvl d join (""" + " union all ".join(f"select '{s}' as sampler, {i} as s_order" for i, s in enumerate(SAMPLER_ORDER)) +
    """) o using (sampler)) where rn = 1"""))
def m12_dataset_winner(spark, sf_dir):
    """Winning sampler and its value per dataset (ties -> sampler order)."""
    d = dataset_df(spark, sf_dir)
    order = F.array_position(F.array(*[F.lit(s) for s in SAMPLER_ORDER]), F.col("sampler"))
    w = d.groupBy("dataset").agg(
        F.max_by("sampler", F.struct(F.col("mean_best_j"), -order)).alias("winner"),
        F.max("mean_best_j").alias("winner_value"))
    return r9(w, "winner_value")


@register("m13_dataset_sampler_mean", stats_sql("""
select dataset, sampler, count(best_objective) as n_runs, round(avg(best_objective), 9) as best_j_mean,
       round(case when count(best_objective) > 1 then stddev_samp(best_objective) else 0e0 end, 9) as best_j_std
from summary where best_objective is not null group by dataset, sampler"""))
def m13_dataset_sampler_mean(spark, sf_dir):
    """Mean / std of study-best J per dataset x sampler over all generators and seeds."""
    s = summaries(spark, sf_dir).where(F.col("best_objective").isNotNull())
    n = F.count("best_objective")
    a = s.groupBy("dataset", "sampler").agg(
        n.alias("n_runs"), F.avg("best_objective").alias("best_j_mean"),
        F.when(n > 1, F.stddev_samp("best_objective")).otherwise(F.lit(0.0)).alias("best_j_std"))
    return r9(a, "best_j_mean", "best_j_std")


@register("m14_dataset_matrix", stats_sql("""
select dataset, """ + ", ".join(f"round(max(case when sampler = '{s}' then mean_best_j end), 9) as {s}" for s in SAMPLER_ORDER) + """
from dslvl group by dataset"""))
def m14_dataset_matrix(spark, sf_dir):
    """Dataset x sampler matrix of dataset-level mean best J."""
    p = dataset_df(spark, sf_dir).groupBy("dataset").pivot("sampler", SAMPLER_ORDER).agg(F.first("mean_best_j"))
    return r9(p, *SAMPLER_ORDER)


_ = PAIRS  # the challenger/baseline pairs live with the trial operators


def friedman_sql(src: str, group: str) -> str:
    """Grouped SQL twin of rankstats.friedman over complete blocks of ``src``
    (columns: group, dataset, sampler, mean_best_j)."""
    return f"""
with rr as (select *, rank() over (partition by {group}, dataset order by mean_best_j)
                      + (count(*) over (partition by {group}, dataset, mean_best_j) - 1) / 2e0 as arank from {src}),
a as (select {group}, count(*) as k, max(nb) as n, sum(r * r) as sum_r2
      from (select {group}, sampler, sum(arank) as r, count(*) as nb from rr group by {group}, sampler) group by {group}),
b as (select {group}, sum(t * t * t - t) as tie_sum
      from (select {group}, count(*) as t from rr group by {group}, dataset, mean_best_j) group by {group}),
c as (select a.{group}, n, k, (12e0 / (n * k * (k + 1)) * sum_r2 - 3e0 * n * (k + 1)) / (1e0 - tie_sum / (n * k * (k * k - 1e0))) as chi2
      from a join b using ({group}))
select {group}, n as n_blocks, k as n_treatments, chi2, k - 1 as df, {chi2_sf_sql('chi2', 'k - 1')} as p_value,
       chi2 / (n * (k - 1)) as kendalls_w from c"""
