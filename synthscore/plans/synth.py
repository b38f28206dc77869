"""Generator queries (inventory G) on the FX-1 real table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import synth as G
from ..operators.sampling import hash_key
from ..sources.fixtures import FX1_NUMERIC, fx1_real, fx1_synth, with_fixtures
from .common import r9
from .metrics import ALL_CTES, msql
from .registry import register

KEYS = ["l_orderkey", "l_linenumber"]
N_CANDIDATES = 4


def candidates(spark):
    space = G.space_frame(spark, G.BOOTSTRAP_SPACE)
    return G.with_defaults(G.draw_candidates(spark, space, N_CANDIDATES, seed=42), {"noise_std": 0.01})


def bootstrapped(spark, sf_dir):
    return G.bootstrap(fx1_real(spark, sf_dir), candidates(spark), KEYS, FX1_NUMERIC, seed=42)


@register("g1_bootstrap_noise")
def g1_bootstrap_noise(spark, sf_dir):
    """Random-search candidates (noise_std, log scale) and their noisy bootstrap of the
    real table, summarised per candidate (rows, mean / std of each numeric column)."""
    b = bootstrapped(spark, sf_dir)
    c = candidates(spark).select("trial_id", F.col("params")["noise_std"].cast("double").alias("noise_std"))
    s = b.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                  *[x for col in FX1_NUMERIC for x in (F.avg(col).alias(f"mean_{col}"),
                                                                       F.stddev_pop(col).alias(f"std_{col}"))])
    return c.join(s, "trial_id")


def _bootstrap_sql(seed: int, noise: str) -> str:
    """Bootstrap without its noise: n draws by md5 per candidate joined with the places of the real rows."""
    return f"""
with placed as (select *, row_number() over (order by md5('{seed}|' || k), k) - 1 as position
                from (select *, concat_ws('|', l_orderkey, l_linenumber, {', '.join(f"cast(round({c} * 100) as bigint)" for c in FX1_NUMERIC)},
                                          l_returnflag, l_linestatus) as k from fx1_real)),
draws as (select t.trial_id, d.draw, cast('0x' || substr(md5('{seed}|' || cast(t.trial_id as varchar) || '|' || cast(d.draw as varchar)), 1, 15) as bigint)
                 % (select count(*) from fx1_real) as position
          from range(0, {N_CANDIDATES}) t(trial_id), range(0, (select count(*) from fx1_real)) d(draw))
{noise}"""


@register("g2_bootstrap_rows", with_fixtures(_bootstrap_sql(7, """
select d.trial_id, d.draw, p.k as source_key, p.l_orderkey, p.l_linenumber, cast(p.l_quantity as double) as l_quantity,
       cast(p.l_extendedprice as double) as l_extendedprice, cast(p.l_discount as double) as l_discount, cast(p.l_tax as double) as l_tax,
       p.l_returnflag, p.l_linestatus from draws d join placed p using (position)"""), "fx1_real"))
def g2_bootstrap_rows(spark, sf_dir):
    """Plain joint-row bootstrap (noise 0) of the real table for every candidate, exactly n rows each."""
    cand = candidates(spark).withColumn("params", F.create_map(F.lit("noise_std"), F.lit("0")))
    cents = [F.round(F.col(c) * 100).cast("bigint").alias(f"_{c}") for c in FX1_NUMERIC]  # order and line alone are not unique
    real = fx1_real(spark, sf_dir).select("*", *cents)
    out = G.bootstrap(real, cand, [*KEYS, *[f"_{c}" for c in FX1_NUMERIC], "l_returnflag", "l_linestatus"], FX1_NUMERIC, seed=7)
    return out.drop(*[f"_{c}" for c in FX1_NUMERIC])


LEVEL_ORDER_SQL = "md5('42|' || cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar))"


def _snap_input(spark, sf_dir):
    s = fx1_synth(spark, sf_dir)
    return s.select("trial_id", "l_orderkey", "l_linenumber",
                    (F.col("l_linenumber") + (F.col("l_orderkey") % 7) / F.lit(10.0) - F.lit(0.3)).alias("linenumber_soft"),
                    F.when(F.col("l_orderkey") % 9 == 0, F.lit("Z")).otherwise(F.col("l_returnflag")).alias("returnflag_raw"))


@register("g5_g7_snap_levels", with_fixtures(f"""
with lv_num as (select list(distinct cast(l_linenumber as double) order by cast(l_linenumber as double)) as lv from fx1_real),
lv_cat as (select list(l_returnflag order by k) as lv from (select l_returnflag, min({LEVEL_ORDER_SQL}) as k from fx1_real
           where l_returnflag is not null group by l_returnflag)),
s as (select trial_id, l_orderkey, l_linenumber, l_linenumber + (l_orderkey % 7) / 10e0 - 0.3e0 as v,
             case when l_orderkey % 9 = 0 then 'Z' else l_returnflag end as f from fx1_synth)
select s.trial_id, s.l_orderkey, s.l_linenumber,
       (select lv_num.lv[1 + (select i from (select i, abs(s.v - lv_num.lv[i + 1]) as d
                                              from range(0, len(lv_num.lv)) t(i)) order by d, i limit 1)]) as linenumber_snapped,
       case when list_contains(lv_cat.lv, s.f) then s.f else lv_cat.lv[1] end as returnflag_snapped
from s, lv_num, lv_cat""", "fx1_real", "fx1_synth"))
def g5_g7_snap_levels(spark, sf_dir):
    """Snap soft numeric values to the nearest real level and invalid labels to the
    first real level (first appearance in hash order)."""
    from ..operators.coding import dense_codes
    real = fx1_real(spark, sf_dir)
    num = real.select(F.col("l_linenumber").cast("double").alias("v")).distinct()
    num = dense_codes(num, [], ["v"], "pos").select(F.lit("linenumber_soft").alias("col_name"), "pos", F.col("v").cast("string").alias("level"))
    order = hash_key("42", "_rk")
    first = (real.withColumn("_rk", F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
             .where(F.col("l_returnflag").isNotNull()).groupBy("l_returnflag").agg(F.min(order).alias("_k")))
    flags = dense_codes(first, [], ["_k"], "pos").select(F.lit("returnflag_raw").alias("col_name"), "pos", F.col("l_returnflag").alias("level"))
    s = G.snap_discrete(_snap_input(spark, sf_dir), num.unionByName(flags), ["linenumber_soft"], ["returnflag_raw"])
    return s.select("trial_id", "l_orderkey", "l_linenumber", F.col("linenumber_soft").alias("linenumber_snapped"),
                    F.col("returnflag_raw").alias("returnflag_snapped"))


@register("g8_resize", with_fixtures("""
with n as (select count(*) as n from fx1_real),
c as (select trial_id, count(*) as cnt from fx1_synth group by trial_id),
r as (select s.*, unnest(range(0, greatest(cast(ceil(n.n / c.cnt) as bigint), 1))) as rep from fx1_synth s join c using (trial_id), n),
k as (select *, rep || '#' || l_orderkey || '|' || l_linenumber as rkey from r),
o as (select *, row_number() over (partition by trial_id order by md5('resize|' || rkey), rkey) as rn from k)
select trial_id, l_orderkey, l_linenumber, count(*) as n_copies from o, n where rn <= n group by trial_id, l_orderkey, l_linenumber""",
                                     "fx1_real", "fx1_synth"))
def g8_resize(spark, sf_dir):
    """Every candidate resized to exactly the real row count (repeat, then first rows in hash order):
    how often each of its rows stands in the result."""
    n = fx1_real(spark, sf_dir).count()
    s = fx1_synth(spark, sf_dir).withColumn("_key", F.concat_ws("|", F.col("l_orderkey").cast("string"),
                                                                F.col("l_linenumber").cast("string")))
    r = G.resize(s, n, "_key")
    return r.groupBy("trial_id", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n_copies"))


@register("g3_gaussian_copula")
def g3_gaussian_copula(spark, sf_dir):
    """Gaussian copula fitted on the real numerics (normal-score correlation, normal marginals,
    min/max enforced) and sampled to the real table's size."""
    from ..operators.copula import fit_copula, sample_copula
    real = fx1_real(spark, sf_dir).withColumn("rk", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    model = fit_copula(real, "rk", FX1_NUMERIC, family="norm")
    return sample_copula(spark, model, real.count(), seed=42)


G3_FAMILIES = ("norm", "uniform", "beta", "gamma", "truncnorm")


@register("g3_copula_families", with_fixtures(" union all ".join(
    f"select '{f}' as family, '{c}' as col_name, count(*) as n_rows, true as in_bounds, true as mean_near, true as std_near from fx1_real"
    for f in G3_FAMILIES for c in FX1_NUMERIC), "fx1_real"))
def g3_copula_families(spark, sf_dir):
    """The copula under every marginal family, sampled to the real row count: rows, bounds (min / max
    of the real column) and moments (mean within 5 % and std within 15 % of the real std; a uniform has its own)."""
    from ..operators.copula import fit_copula, sample_copula
    real = fx1_real(spark, sf_dir).withColumn("rk", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    n, out = real.count(), None
    for family in G3_FAMILIES:
        m = fit_copula(real, "rk", FX1_NUMERIC, family=family)
        x = sample_copula(spark, m, n, seed=42)
        one = x.agg(F.count(F.lit(1)).alias("n"), *[a for c in FX1_NUMERIC for a in (
            F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
        rows = F.array(*[F.struct(
            F.lit(family).alias("family"), F.lit(c).alias("col_name"), F.col("n").alias("n_rows"),
            ((F.col(f"lo_{c}") >= m["min"][i]) & (F.col(f"hi_{c}") <= m["max"][i])).alias("in_bounds"),
            (F.abs(F.col(f"m_{c}") - (m["mean"][i] if family != "uniform" else (m["min"][i] + m["max"][i]) / 2)) < 0.05 * m["std"][i]).alias("mean_near"),
            (F.abs(F.col(f"s_{c}") - (m["std"][i] if family != "uniform" else (m["max"][i] - m["min"][i]) / 12 ** 0.5)) < 0.15 * m["std"][i]).alias("std_near"))
            for i, c in enumerate(FX1_NUMERIC)])
        one = one.select(F.explode(rows).alias("_x")).select("_x.*")
        out = one if out is None else out.unionByName(one)
    return out


@register("k26_rescore_trials", msql("""
select s.event_id, s.dataset, s.generator, s.sampler, s.seed, s.trial_number, s.fidelity, round(s.objective, 9) as objective,
       round(q.column_shapes, 9) as column_shapes, round(q.column_pair_trends, 9) as column_pair_trends, round(q.sdv_quality, 9) as sdv_quality,
       round(q.sdv_quality, 9) as fidelity_new,
       case when s.trial_number % 6 = 5 then 'ValueError: noise_std=none is not a number' when q.trial_id is null then 'no rebuilt rows' end as error,
       q.trial_id is null as sdv_unavailable
from scored s left join qual q on q.trial_id = s.trial_number % 6 where s.state = 'COMPLETE'""", *ALL_CTES, trials=True))
def k26_rescore_trials(spark, sf_dir):
    """Every COMPLETE trial of the log re-scored from its rebuilt table (by trial number: four stored
    candidates, one that was never stored and one whose parameters cannot be rebuilt), logged columns beside the new ones."""
    from ..operators.fidelity import rescore_trials
    from .common import scored
    from .metrics import CAT, NUM
    log = scored(spark, sf_dir).where(F.col("state") == "COMPLETE").select(
        "event_id", "dataset", "generator", "sampler", "seed", "trial_number", "fidelity", "objective", (F.col("trial_number") % 6).alias("_candidate"))
    params = spark.createDataFrame([(i, {"noise_std": t}) for i, t in enumerate(["0", "0.01", "0.05", "0.1", "0.1", "none"])], "trial_id long, params map<string,string>")
    errors = G.candidate_errors(params, G.BOOTSTRAP_SPACE).where(F.col("error").isNotNull())
    out = rescore_trials(log, fx1_real(spark, sf_dir), fx1_synth(spark, sf_dir), NUM, CAT, "_candidate", errors)
    out = out.drop("_candidate").withColumnsRenamed({"fidelity": "fidelity_new", "fidelity_old": "fidelity"})
    return r9(out, "objective", "column_shapes", "column_pair_trends", "sdv_quality", "fidelity_new")
