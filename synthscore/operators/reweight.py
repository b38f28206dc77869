"""L1 .. L19: post-hoc re-weighting of scored trials under the weight presets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing
from .objective import objective_expr
from .trials import STUDY_KEYS

TRIAL_KEY = STUDY_KEYS + ["trial_number"]
# Short sampler names, their rank preference on ties (ST < MT < GP) and labels.
SHORT = {"standard_tpe": "ST", "multivariate_tpe": "MT", "gp": "GP"}
SAMPLER_PREF = {"standard_tpe": 0, "multivariate_tpe": 1, "gp": 2}
SAMPLER_LABEL = {"standard_tpe": "Standard TPE", "multivariate_tpe": "Multivariate TPE", "gp": "Gaussian Process"}


def assemble_sources(sources: Sequence[tuple[DataFrame, int, str]]) -> DataFrame:
    """L1 / P-31: union scored trials from several sources; keep valid rows; on a key
    collision the source with the lowest priority number wins (grouped min_by, map-side combine)."""
    parts = []
    for df, prio, name in sources:
        ok = ~(is_missing(F.col("fidelity")) | is_missing(F.col("utility")) | is_missing(F.col("privacy_risk")))
        parts.append(df.where(ok).select(*TRIAL_KEY, "fidelity", "utility", "privacy_risk",
                                         F.lit(prio).alias("_prio"), F.lit(name).alias("source")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.groupBy(*TRIAL_KEY)
            .agg(F.min_by(F.struct("fidelity", "utility", "privacy_risk", "source"), F.col("_prio")).alias("_r"))
            .select(*TRIAL_KEY, "_r.fidelity", "_r.utility", "_r.privacy_risk", "_r.source"))


def best_under_presets(trials: DataFrame, presets: DataFrame) -> DataFrame:
    """L2: best trial of every study under every preset (presets: 5-row broadcast)."""
    x = trials.crossJoin(F.broadcast(presets)).withColumn(
        "J", objective_expr(F.col("fidelity"), F.col("utility"), F.col("privacy_risk"),
                            F.col("w_fidelity"), F.col("w_utility"), F.col("w_privacy_risk")))
    b = x.groupBy(*STUDY_KEYS, "preset").agg(
        F.count(F.lit(1)).alias("n_complete"),
        F.max_by(F.struct("trial_number", "J", "fidelity", "utility", "privacy_risk"),
                 F.struct(F.col("J"), -F.col("trial_number"))).alias("_b"))
    return b.select(*STUDY_KEYS, "n_complete", "preset",
                    F.col("_b.trial_number").alias("best_trial_number"), F.col("_b.J").alias("best_J"),
                    F.col("_b.fidelity").alias("best_F"), F.col("_b.utility").alias("best_U"),
                    F.col("_b.privacy_risk").alias("best_P"))


def generator_by_preset(best: DataFrame) -> DataFrame:
    """L3: mean / std over seeds per preset x sampler x dataset x generator; is_best marks the
    generator with the highest mean J inside (preset, sampler, dataset), first by name on ties."""
    n = F.count("best_J")
    a = best.groupBy("preset", "sampler", "dataset", "generator").agg(
        F.avg("best_J").alias("mean_J"),
        F.when(n > 1, F.stddev_samp("best_J")).otherwise(F.lit(0.0)).alias("std_J"),
        F.avg("best_F").alias("mean_F"), F.avg("best_U").alias("mean_U"), F.avg("best_P").alias("mean_P"),
        n.alias("n_seeds"))
    w = Window.partitionBy("preset", "sampler", "dataset").orderBy(F.col("mean_J").desc(), F.col("generator"))
    return a.withColumn("is_best", F.row_number().over(w) == 1)


def dataset_by_preset(gen: DataFrame) -> DataFrame:
    """L4: unweighted means over generators per preset x sampler x dataset."""
    return gen.groupBy("preset", "sampler", "dataset").agg(
        *[F.avg(f"mean_{c}").alias(f"mean_{c}") for c in "JFUP"])


def dataset_comparison(ds: DataFrame, samplers: Sequence[str] = tuple(SHORT)) -> DataFrame:
    """Per preset x dataset with every sampler present: strict ranks (ties -> ST < MT < GP)
    and the best sampler."""
    pref = F.element_at(F.create_map(*[x for kv in SAMPLER_PREF.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                        F.col("sampler"))
    x = ds.where(F.col("sampler").isin(list(samplers)))
    full = (x.groupBy("preset", "dataset").agg(F.countDistinct("sampler").alias("_k"))
            .where(F.col("_k") == len(samplers)).drop("_k"))
    x = x.join(full, ["preset", "dataset"], "left_semi")
    w = Window.partitionBy("preset", "dataset").orderBy(F.col("mean_J").desc(), pref)
    return x.withColumn("sampler_rank", F.row_number().over(w).cast("bigint"))


def sampler_summary(comp: DataFrame, gen: DataFrame, min_datasets: int = 3, std_cut: float = 0.10) -> DataFrame:
    """Per preset x sampler: dataset-level mean J, mean rank, wins, cells with std >= 0.10;
    presets with fewer than ``min_datasets`` complete datasets give no rows."""
    enough = (comp.groupBy("preset").agg(F.countDistinct("dataset").alias("_nd"))
              .where(F.col("_nd") >= min_datasets).select("preset"))
    s = comp.join(enough, "preset", "left_semi").groupBy("preset", "sampler").agg(
        F.avg("mean_J").alias("dataset_level_mean_J"), F.avg("sampler_rank").alias("avg_rank"),
        F.count_if(F.col("sampler_rank") == 1).alias("dataset_wins"))
    hi = gen.groupBy("preset", "sampler").agg(F.count_if(F.col("std_J") >= std_cut).alias("cells_std_ge_0_10"))
    return s.join(hi, ["preset", "sampler"], "left")


def best_shift(best: DataFrame, base: str = "O1") -> DataFrame:
    """Per preset, how many studies change their best trial against the base preset."""
    o = best.where(F.col("preset") == base).select(*STUDY_KEYS, F.col("best_trial_number").alias("trial_base"))
    m = best.where(F.col("preset") != base).join(o, STUDY_KEYS)
    return m.groupBy("preset").agg(
        F.count(F.lit(1)).alias("studies"),
        F.count_if(F.col("best_trial_number") != F.col("trial_base")).alias("best_trial_changed"),
    ).withColumn("pct_changed", F.round(F.lit(100.0) * F.col("best_trial_changed") / F.col("studies"), 1))


def conclusion(delta, reject, a_short, b_short):
    """L7 label: 'A > B' / 'B > A' when rejected, else 'A ≈ B'."""
    return (F.when(reject & (delta > 0), F.concat(a_short, F.lit(" > "), b_short))
            .when(reject, F.concat(b_short, F.lit(" > "), a_short))
            .otherwise(F.concat(a_short, F.lit(" ≈ "), b_short)))
