"""Privacy queries (inventory J) on FX-3 (embeddings) and FX-9 (fixed predictions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip01
from ..operators import privacy as J
from ..sources.fixtures import FX1_CATEGORICAL, FX1_NUMERIC, fx1_real, fx1_synth, fx3_base, fx3_query, fx9_pred, with_fixtures
from .common import r9
from .registry import register

K = 2
VECTOR_DIM = 64


def _knn(spark, sf_dir):
    return J.knn(fx3_base(spark, sf_dir), fx3_query(spark, sf_dir), K, base_id="vec_id", query_id="vec_id",
                 vec="embedding")


def _groups(spark):
    return spark.range(1).select(F.lit(0).cast("bigint").alias("grp"))


def _n_base(spark, sf_dir):
    return fx3_base(spark, sf_dir).count()


def _dist_sql(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::double - {b}[i]::double) ** 2)))"


NN_CTE = ("nn", f"""
select cast(0 as bigint) as grp, qid, rank, bid, distance from (
  select q.vec_id as qid, b.vec_id as bid, {_dist_sql('q.embedding', 'b.embedding')} as distance,
         row_number() over (partition by q.vec_id order by {_dist_sql('q.embedding', 'b.embedding')}, b.vec_id) as rank
  from fx3_query q, fx3_base b) x where rank <= {K}""")
SAMPLE_CTE = ("smp", "select * from fx3_base")
NNS_CTE = ("nns", f"""
select qid, rank, distance from (
  select q.vec_id as qid, {_dist_sql('q.embedding', 'b.embedding')} as distance,
         row_number() over (partition by q.vec_id order by {_dist_sql('q.embedding', 'b.embedding')}, b.vec_id) as rank
  from smp q, fx3_base b) x where rank <= 2""")
PRIV_CTE = ("priv", f"""
select d.dcr, n.nndr, s.ref_intended, s.ref_parity from
  (select coalesce(median(distance), 0e0) as dcr from nn where rank = 1) d,
  (select case when (select count(*) from fx3_base) < 2 then 0e0 else coalesce(median(d1 / greatest(d2, 1e-12)), 0e0) end as nndr
   from (select qid, max(case when rank = 1 then distance end) as d1, max(case when rank = 2 then distance end) as d2
         from nn group by qid)) n,
  (select median(case when rank = 2 then distance end) as ref_intended,
          median(case when rank = 1 then distance end) as ref_parity from nns) s""")


def psql(body, *extra, fixtures=()):
    return with_fixtures(body, "fx3_base", "fx3_query", *fixtures, extra=[NN_CTE, *extra])


@register("j1_knn", psql("select grp, qid, cast(rank as bigint) as rank, bid, round(distance, 9) as distance from nn"))
def j1_knn(spark, sf_dir):
    """Exact 2 nearest base vectors of every query vector (pivot-pruned blocked join)."""
    nn = _knn(spark, sf_dir)
    return r9(nn.withColumn("rank", F.col("rank").cast("bigint")), "distance")


@register("j2_dcr", psql("select cast(0 as bigint) as grp, round(coalesce(median(distance), 0e0), 9) as dcr "
                         "from nn where rank = 1"))
def j2_dcr(spark, sf_dir):
    """DCR = median distance from each query row to its nearest base row."""
    return r9(J.dcr(_knn(spark, sf_dir), _groups(spark)), "dcr")


@register("j3_nndr", psql("select cast(0 as bigint) as grp, round(nndr, 9) as nndr from priv", SAMPLE_CTE, NNS_CTE, PRIV_CTE))
def j3_nndr(spark, sf_dir):
    """NNDR = median nearest / second-nearest distance ratio."""
    n_base = F.lit(_n_base(spark, sf_dir))
    return r9(J.nndr(_knn(spark, sf_dir), _groups(spark), n_base), "nndr")


def _scale(spark, sf_dir):
    """The whole real side against itself: its second neighbour is the distance scale."""
    base = fx3_base(spark, sf_dir)
    return J.knn(base, base, 2, base_id="vec_id", query_id="vec_id", vec="embedding")


@register("j6_distance_scale", psql(f"""
select round(ref_intended, 9) as ref_intended, round(ref_parity, 9) as ref_parity,
       round(case when ref_intended <= 1e-12 then 0e0 else least(greatest(dcr / (dcr + ref_intended), 0e0), 1e0) end, 9)
         as dcr_norm_intended,
       round(case when ref_parity <= 1e-12 then 0e0 else least(greatest(dcr / (dcr + ref_parity), 0e0), 1e0) end, 9)
         as dcr_norm_parity
from priv""", SAMPLE_CTE, NNS_CTE, PRIV_CTE))
def j6_distance_scale(spark, sf_dir):
    """J6 / P-21: distance scale from all real rows (second neighbour = intended; first = parity, 0)
    and the normalised DCR under both."""
    return r9(_privacy_table(spark, sf_dir).select("ref_intended", "ref_parity", "dcr_norm_intended", "dcr_norm_parity"),
              "ref_intended", "ref_parity", "dcr_norm_intended", "dcr_norm_parity")


def _privacy_table(spark, sf_dir):
    from ..operators.quantiles import exact_quantiles
    nn_s = _scale(spark, sf_dir).withColumn("_g", F.lit(0))
    ref = exact_quantiles(nn_s.where(F.col("rank") == 2), ["_g"], "distance", [0.5], out_names=["ref_intended"]).join(
        exact_quantiles(nn_s.where(F.col("rank") == 1), ["_g"], "distance", [0.5], out_names=["ref_parity"]), "_g")
    nn = _knn(spark, sf_dir)
    g = _groups(spark)
    t = J.dcr(nn, g).join(J.nndr(nn, g, F.lit(_n_base(spark, sf_dir))), "grp").crossJoin(ref.drop("_g"))
    return (t.withColumn("dcr_norm_intended", J.normalise_distance(F.col("dcr"), F.col("ref_intended")))
            .withColumn("dcr_norm_parity", J.normalise_distance(F.col("dcr"), F.col("ref_parity"))))


def _held_sql(prefix: str, key: str) -> str:
    return f"cast('0x' || substr(md5('42{prefix}|' || cast({key} as varchar)), 1, 8) as bigint) / 4294967296e0 < 0.3e0"


ATTACK_CTES = [
    ("av", f"""select vec_id, 1 as member, {_held_sql('r', 'vec_id')} as held, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from fx3_base
union all select vec_id, 0, {_held_sql('s', 'vec_id')}, unnest(embedding)::double, generate_subscripts(embedding, 1) from fx3_query"""),
    ("am", "select member, i, avg(x) as m, greatest(var_pop(x), 1e-9) as v from av where not held group by member, i"),
    ("ap", """select av.member, av.vec_id, round(sum(-0.5e0 * (ln(r.v) + (x - r.m) * (x - r.m) / r.v) + 0.5e0 * (ln(s.v) + (x - s.m) * (x - s.m) / s.v)), 6) as p
from av join am r on r.i = av.i and r.member = 1 join am s on s.i = av.i and s.member = 0 where held group by av.member, av.vec_id"""),
    ("aa", """select round((sum(case when member = 1 then rk end) - count_if(member = 1) * (count_if(member = 1) + 1) / 2e0)
              / (count_if(member = 1) * count_if(member = 0)), 5) as mia_auc
from (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as rk from ap)"""),
]


@register("j7_privacy_risk", psql(f"""
select cast(0 as bigint) as grp, round(dcr, 9) as dcr, round(nndr, 9) as nndr,
       round(least(greatest(nndr, 0e0), 1e0), 9) as nndr_norm, round(dn, 9) as dcr_norm, mia_auc,
       round(least(greatest((0.5e0 * least(greatest(mia_auc, 0e0), 1e0)
                      + 0.3e0 * least(greatest(1e0 - least(greatest(nndr, 0e0), 1e0), 0e0), 1e0)
                      + 0.2e0 * least(greatest(1e0 - dn, 0e0), 1e0)) / 1e0, 0e0), 1e0), 9) as privacy_risk
from (select *, case when ref_intended <= 1e-12 then 0e0 else least(greatest(dcr / (dcr + ref_intended), 0e0), 1e0) end as dn
      from priv), aa""", SAMPLE_CTE, NNS_CTE, PRIV_CTE, *ATTACK_CTES))
def j7_privacy_risk(spark, sf_dir):
    """Privacy risk of the query vectors against the base vectors: attack AUC over their components,
    NNDR and DCR (converted from safety to risk), weights .5 / .3 / .2."""
    names = [f"x{i}" for i in range(VECTOR_DIM)]

    def parts(df, *extra):
        return df.select("vec_id", *extra, *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])

    auc = J.batched_attack_auc(parts(fx3_base(spark, sf_dir)), parts(fx3_query(spark, sf_dir), F.lit(0).cast("bigint").alias("trial_id")),
                               names, "vec_id", "vec_id").select(F.round("auc", 5).alias("mia_auc"))
    t = _privacy_table(spark, sf_dir).crossJoin(auc)  # one row
    nn_norm = clip01(F.col("nndr"))
    risks = {"mia_auc": clip01(F.col("mia_auc")), "nndr": clip01(F.lit(1.0) - nn_norm),
             "dcr": clip01(F.lit(1.0) - F.col("dcr_norm_intended"))}
    out = t.select("grp", "dcr", "nndr", nn_norm.alias("nndr_norm"), F.col("dcr_norm_intended").alias("dcr_norm"), "mia_auc",
                   J.privacy_risk(risks).alias("privacy_risk"))
    return r9(out, "dcr", "nndr", "nndr_norm", "dcr_norm", "privacy_risk")


@register("j5_roc_auc", with_fixtures("""
select count_if(y_true = 1) as n_pos, count_if(y_true = 0) as n_neg,
       round((sum(case when y_true = 1 then rk end) - count_if(y_true = 1) * (count_if(y_true = 1) + 1) / 2e0)
             / (count_if(y_true = 1) * count_if(y_true = 0)), 9) as auc
from (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk from fx9_pred)""",
                                      "fx9_pred"))
def j5_roc_auc(spark, sf_dir):
    """ROC AUC of fixed scores, ties averaged."""
    return r9(J.roc_auc(fx9_pred(spark, sf_dir), "y_true", "score"), "auc")


_U_SQL = "cast('0x' || substr(md5('42{s}|' || cast(l_orderkey * 8 + l_linenumber as varchar)), 1, 8) as bigint) / 4294967296e0 < 0.3e0"
_SCORE_SQL = " + ".join(
    f"(-0.5e0 * (ln(greatest(r.v{i}, 1e-9)) + ({c} - r.m{i}) ** 2 / greatest(r.v{i}, 1e-9))"
    f" + 0.5e0 * (ln(greatest(s.v{i}, 1e-9)) + ({c} - s.m{i}) ** 2 / greatest(s.v{i}, 1e-9)))" for i, c in enumerate(FX1_NUMERIC))
_MOMENTS_SQL = ", ".join(f"avg({c}) as m{i}, var_pop({c}) as v{i}" for i, c in enumerate(FX1_NUMERIC))


@register("j4_batched_attack", with_fixtures(f"""
with r0 as (select *, {_U_SQL.format(s='r')} as held from fx1_real), s0 as (select *, {_U_SQL.format(s='s')} as held from fx1_synth),
r as (select {_MOMENTS_SQL} from r0 where not held),
s as (select trial_id, {_MOMENTS_SQL} from s0 where not held group by trial_id),
p as (select s.trial_id, 1 as member, round({_SCORE_SQL}, 6) as p from r0, r, s where held
      union all select s0.trial_id, 0, round({_SCORE_SQL}, 6) from s0, r, s where held and s0.trial_id = s.trial_id)
select trial_id, count_if(member = 1) as n_pos, count_if(member = 0) as n_neg,
       round((sum(case when member = 1 then rk end) - count_if(member = 1) * (count_if(member = 1) + 1) / 2e0)
             / (count_if(member = 1) * count_if(member = 0)), 5) as auc
from (select *, rank() over (partition by trial_id order by p) + (count(*) over (partition by trial_id, p) - 1) / 2e0 as rk from p)
group by trial_id""", "fx1_real", "fx1_synth"))
def j4_batched_attack(spark, sf_dir):
    """J4 for every candidate over all rows: Gaussian naive Bayes attack, AUC on the held-out 30 %."""
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rk")
    real = fx1_real(spark, sf_dir).select(key, *FX1_NUMERIC)
    synth = fx1_synth(spark, sf_dir).select("trial_id", key, *FX1_NUMERIC)
    out = J.batched_attack_auc(real, synth, FX1_NUMERIC, "rk", "rk")
    return out.withColumn("auc", F.round("auc", 5))


@register("j4_membership_attack")
def j4_membership_attack(spark, sf_dir):
    """Membership-attack AUC of every candidate against the real half (random forest, 30 % holdout)."""
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rk")
    real = fx1_real(spark, sf_dir).select(key, *FX1_NUMERIC, *FX1_CATEGORICAL)
    synth = fx1_synth(spark, sf_dir).select("trial_id", key, *FX1_NUMERIC, *FX1_CATEGORICAL)
    return J.membership_attack_auc(real, synth, FX1_NUMERIC, FX1_CATEGORICAL, "rk")
