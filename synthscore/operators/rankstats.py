"""M1 .. M14: seed / dataset level statistics, ranks and hypothesis tests.

All tests are grouped column expressions: an optional list of ``group_cols``
(for example the weight preset) runs one test per group in the same job.
Blocks (datasets) and treatments (samplers) are small by construction — the
number of datasets and samplers in a study grid — so per-block windows are
bounded; the trial rows themselves are reduced by aggregations before.

p-values without SciPy:
* chi-square survival for the Friedman statistic: closed finite sums for
  integer and half-integer shape (df even / odd), the odd case through erfc;
* Wilcoxon signed-rank: exact null distribution by a subset-sum fold
  (``aggregate(sequence(1, n), ...)``) for n <= 50 without ties or zeros,
  otherwise the normal approximation with tie correction;
* erfc: a Chebyshev fit with fractional error below 1.2e-7 everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of the Chebyshev erfc fit (fractional error < 1.2e-7), innermost last.
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
# Nemenyi critical values q_0.05 for k = 2 .. 10 treatments.
NEMENYI_Q05 = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}
# Largest number of non-zero pairs for which the "auto" method uses the exact null distribution.
EXACT_MAX_N = 50


def erfc_expr(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + F.lit(ERFC_COEFFS[0]) + t * poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def norm_sf_expr(z: Column) -> Column:
    """P(Z > z) for a standard normal."""
    return F.lit(0.5) * erfc_expr(z / F.lit(2.0 ** 0.5))


def chi2_sf_expr(x: Column, df: Column) -> Column:
    """Survival function of chi-square(df) at x for integer df >= 1."""
    y = x / F.lit(2.0)
    m = F.floor(df.cast("double") / F.lit(2.0)).cast("int")
    # even df: exp(-y) * sum_{i<m} y^i / i!
    even = F.exp(-y) * F.aggregate(
        F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
        F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * y / (i + F.lit(1))).alias("t")),
        lambda acc: acc["s"])
    # odd df: erfc(sqrt y) + exp(-y) * sum_{i<m} y^(i+1/2) / Gamma(i + 3/2)
    first = F.sqrt(y) / F.lit(0.886226925452758)  # Gamma(3/2) = sqrt(pi)/2
    odd = erfc_expr(F.sqrt(y)) + F.when(m > 0, F.exp(-y) * F.aggregate(
        F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
        F.struct(F.lit(0.0).alias("s"), first.alias("t")),
        lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"),
                                (acc["t"] * y / (i.cast("double") + F.lit(1.5))).alias("t")),
        lambda acc: acc["s"])).otherwise(F.lit(0.0))
    return F.when(x.isNull() | df.isNull(), F.lit(None).cast("double")) \
        .when(x <= 0, F.lit(1.0)) \
        .when(df % 2 == 0, even).otherwise(odd)


def wilcoxon_exact_p(n: Column, stat: Column) -> Column:
    """Two-sided exact p = min(1, 2 * P(T <= stat)) under the signed-rank null, n >= 1."""
    total = (n * (n + 1) / 2).cast("int")
    init = F.transform(F.array_repeat(F.lit(0).cast("bigint"), total + 1),
                       lambda v, s: F.when(s == 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), init,
        lambda c, i: F.transform(c, lambda v, s: v + F.when(s >= i, F.element_at(c, s - i + 1)).otherwise(F.lit(0).cast("bigint"))))
    k = F.floor(stat).cast("int")
    cdf = F.aggregate(F.slice(counts, 1, k + 1), F.lit(0).cast("bigint"), lambda a, v: a + v) / F.pow(F.lit(2.0), n)
    return F.least(F.lit(1.0), F.lit(2.0) * cdf)


# ------------------------------------------------------------------ M1 / M2
def seed_level(runs: DataFrame) -> DataFrame:
    """M1: one row per (dataset, sampler, seed): mean / max / std / count of best J over generators."""
    ok = runs.where(F.col("best_objective").isNotNull())
    return ok.groupBy("dataset", "sampler", "seed").agg(
        F.avg("best_objective").alias("best_objective"),
        F.count("best_objective").alias("n_generators"),
        F.max("best_objective").alias("best_objective_max_over_gens"),
        F.stddev_samp("best_objective").alias("best_objective_std_over_gens"),
    )


def dataset_level(seed_df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """M2: per (dataset, sampler) mean, std (n<2 -> 0), min, max, CV (NULL when mean = 0 or n < 2),
    n and one column per configured seed."""
    n = F.count("best_objective")
    std = F.when(n > 1, F.stddev_samp("best_objective")).otherwise(F.lit(0.0))
    mean = F.avg("best_objective")
    cv = F.when((n > 1) & (mean != 0), F.stddev_samp("best_objective") / mean)
    return seed_df.groupBy("dataset", "sampler").agg(
        n.alias("n_seeds"), mean.alias("mean_best_j"), std.alias("std_best_j"),
        F.max("best_objective").alias("max_best_j"), F.min("best_objective").alias("min_best_j"),
        cv.alias("cv_best_j"),
        *[F.max(F.when(F.col("seed") == s, F.col("best_objective"))).alias(f"seed_{s}") for s in seeds],
    )


# ------------------------------------------------------------------ M4
def average_ranks(df: DataFrame, block_col: str, value_col: str, group_cols: Sequence[str] = (),
                  descending: bool = True, out_col: str = "rank") -> DataFrame:
    """Rank treatments inside each block, ties get the average rank (1 = best)."""
    part = [*group_cols, block_col]
    order = F.col(value_col).desc() if descending else F.col(value_col).asc()
    w = Window.partitionBy(*part).orderBy(order)
    wt = Window.partitionBy(*part, value_col)
    return df.withColumn(out_col, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / F.lit(2.0))


def mean_ranks(ranked: DataFrame, treat_col: str, group_cols: Sequence[str] = (), rank_col: str = "rank"):
    return ranked.groupBy(*group_cols, treat_col).agg(F.avg(rank_col).alias("average_rank"))


def complete_only(df: DataFrame, block_col: str, treat_col: str, value_col: str, group_cols: Sequence[str] = (),
                  treatments: Sequence[str] | None = None):
    """Drop incomplete blocks: a block must have a value for every treatment.  With ``treatments``
    given, a treatment without any row makes all blocks incomplete; without, the treatments of a
    group are those that its rows name."""
    g = list(group_cols)
    ok = df.where(F.col(value_col).isNotNull())
    if treatments is not None:
        ok = ok.where(F.col(treat_col).isin(list(treatments)))
        full = ok.groupBy(*g, block_col).agg(F.countDistinct(treat_col).alias("_kb")).where(F.col("_kb") == len(set(treatments)))
        return ok.join(full.select(*g, block_col), [*g, block_col], "left_semi")
    k = ok.groupBy(*g).agg(F.countDistinct(treat_col).alias("_k")) if g else \
        ok.agg(F.countDistinct(treat_col).alias("_k"))
    per_block = ok.groupBy(*g, block_col).agg(F.countDistinct(treat_col).alias("_kb"))
    full = (per_block.join(k, g) if g else per_block.crossJoin(k)).where(F.col("_kb") == F.col("_k"))
    return ok.join(full.select(*g, block_col), [*g, block_col], "left_semi")


# ------------------------------------------------------------------ M5
def friedman(df: DataFrame, block_col: str, treat_col: str, value_col: str, group_cols: Sequence[str] = (),
             treatments: Sequence[str] | None = None):
    """M5: Friedman chi-square with tie correction, p-value, Kendall's W per group."""
    g = list(group_cols)
    c = complete_only(df, block_col, treat_col, value_col, g, treatments)
    r = average_ranks(c, block_col, value_col, g, descending=False)
    ties = (r.groupBy(*g, block_col, value_col).agg(F.count(F.lit(1)).alias("t"))
            .groupBy(*g).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_sum")))
    rs = r.groupBy(*g, treat_col).agg(F.sum("rank").alias("R"), F.count(F.lit(1)).alias("nb"))
    agg = rs.groupBy(*g).agg(F.count(F.lit(1)).alias("k"), F.max("nb").alias("n"),
                             F.sum(F.col("R") * F.col("R")).alias("sum_r2"))
    a = agg.join(ties, g) if g else agg.crossJoin(ties)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("sum_r2") - F.lit(3.0) * n * (k + 1)
    corr = F.lit(1.0) - F.col("tie_sum") / (n * k * (k * k - 1))
    chi2 = F.try_divide(raw, corr)
    out = a.select(*g, F.col("n").cast("bigint").alias("n_blocks"), F.col("k").cast("bigint").alias("n_treatments"),
                   chi2.alias("chi2"), (F.col("k") - 1).cast("bigint").alias("df"))
    return out.select(*g, "n_blocks", "n_treatments", "chi2", "df",
                      chi2_sf_expr(F.col("chi2"), F.col("df")).alias("p_value"),
                      F.try_divide(F.col("chi2"), F.col("n_blocks") * (F.col("n_treatments") - 1)).alias("kendalls_w"))


# ------------------------------------------------------------------ M6 / M7 / M8
def wilcoxon_pairs(df: DataFrame, block_col: str, treat_col: str, value_col: str,
                   pairs: Sequence[tuple[str, str, str]], group_cols: Sequence[str] = (),
                   allclose_rel: float = 0.0, degenerate_stat: float | None = 0.0, method: str = "auto") -> DataFrame:
    """M6: two-sided Wilcoxon signed-rank per pair (a, b, label): zero differences dropped.
    ``method``: "exact" (null distribution by enumeration), "approx" (normal with tie correction) or
    "auto", the usual definition: exact with at most ``EXACT_MAX_N`` pairs and no ties or zeros.
    When every |a - b| <= 1e-8 + allclose_rel * |b| the result is (degenerate_stat, 1.0):
    (0, 1.0) for the dataset-level tests, (NaN -> NULL, 1.0) with allclose_rel 1e-5 for
    the per-preset tests (P-29)."""
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    g = list(group_cols)
    spark = df.sparkSession
    c = complete_only(df, block_col, treat_col, value_col, g)
    pr = spark.createDataFrame(list(pairs), "a string, b string, comparison string")
    va = c.select(*g, block_col, F.col(treat_col).alias("a"), F.col(value_col).alias("xa"))
    vb = c.select(*g, block_col, F.col(treat_col).alias("b"), F.col(value_col).alias("xb"))
    d = (va.join(F.broadcast(pr), "a").join(vb, [*g, block_col, "b"])
         .withColumn("d", F.col("xa") - F.col("xb")))
    key = [*g, "comparison", "a", "b"]
    nz = d.where(F.col("d") != 0).withColumn("ad", F.abs("d"))
    nz = average_ranks(nz, "comparison", "ad", [*g, "a", "b"], descending=False, out_col="r")
    ties = (nz.groupBy(*key, "ad").agg(F.count(F.lit(1)).alias("t"))
            .groupBy(*key).agg(F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("tie_sum"),
                               F.max("t").alias("max_t")))
    rk = nz.groupBy(*key).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("r_plus"),
                              F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("r_minus"),
                              F.count(F.lit(1)).alias("n_nz"))
    base = d.groupBy(*key).agg(
        F.avg("xa").alias("mean_a"), F.avg("xb").alias("mean_b"), F.avg("d").alias("mean_delta_a_minus_b"),
        F.count_if(F.col("d") > 0).alias("n_a_better"), F.count_if(F.col("d") < 0).alias("n_b_better"),
        F.count_if(F.col("d") == 0).alias("n_ties"),
        F.count_if(F.abs("d") > F.lit(1e-8) + F.lit(allclose_rel) * F.abs("xb")).alias("_n_far"))
    x = base.join(rk, key, "left").join(ties, key, "left")
    n = F.coalesce(F.col("n_nz"), F.lit(0))
    stat = F.least(F.col("r_plus"), F.col("r_minus"))
    nn = n.cast("double")
    mn = nn * (nn + 1) * 0.25
    se = F.sqrt((nn * (nn + 1) * (2 * nn + 1) - F.lit(0.5) * F.coalesce(F.col("tie_sum"), F.lit(0.0))) / 24.0)
    approx = F.lit(2.0) * norm_sf_expr(F.abs(stat - mn) / se)
    exact_ok = {"auto": (n <= EXACT_MAX_N) & (F.col("n_ties") == 0) & (F.coalesce(F.col("max_t"), F.lit(1)) == 1),
                "exact": F.lit(True), "approx": F.lit(False)}[method]
    degenerate = (F.col("_n_far") == 0) | (n == 0)
    return x.select(
        *key, "mean_a", "mean_b", "mean_delta_a_minus_b", "n_a_better", "n_b_better", "n_ties",
        F.when(degenerate, F.lit(degenerate_stat).cast("double")).otherwise(stat).alias("wilcoxon_stat"),
        F.when(degenerate, F.lit(1.0)).when(exact_ok, wilcoxon_exact_p(n, stat)).otherwise(approx).alias("p_raw"),
    )


def holm(df: DataFrame, p_col: str = "p_raw", group_cols: Sequence[str] = (), out_col: str = "p_holm",
         alpha: float = 0.05) -> DataFrame:
    """M7: Holm step-down adjustment inside each group (running max of (m-i+1) * p, capped at 1)."""
    g = list(group_cols)
    w = Window.partitionBy(*g).orderBy(F.col(p_col), F.col("comparison")) if "comparison" in df.columns else \
        Window.partitionBy(*g).orderBy(F.col(p_col))
    wm = Window.partitionBy(*g)
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(wm))
    d = d.withColumn("_adj", F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p_col)))
    d = d.withColumn(out_col, F.max("_adj").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn(f"significant_holm_{alpha}".replace(".", "_"), F.col(out_col) <= alpha) \
            .drop("_i", "_m", "_adj")


def direction_label(delta: Column, label_a: Column, label_b: Column) -> Column:
    """M8: direction text of a mean difference."""
    return (F.when(F.abs(delta) < 1e-15, F.lit("no difference"))
            .when(delta > 0, F.concat(label_a, F.lit(" higher mean (numerically)")))
            .otherwise(F.concat(label_b, F.lit(" higher mean (numerically)"))))


def nemenyi_cd(k: Column, n: Column) -> Column:
    """M9: Nemenyi critical difference q_0.05 * sqrt(k (k+1) / (6 n)); NULL beyond the table's k = 10."""
    q = F.element_at(F.create_map(*[x for kv in NEMENYI_Q05.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                     k.cast("int"))
    return q * F.sqrt(k * (k + 1) / (F.lit(6.0) * n))


# ------------------------------------------------------------------ M3, M10 .. M14
def descriptives(dataset_df: DataFrame, quantiles_fn) -> DataFrame:
    """M3: per sampler mean, std, median, min, max, q1, q3, IQR, average rank, wins (P-28)."""
    ranked = average_ranks(dataset_df, "dataset", "mean_best_j")
    best = dataset_df.groupBy("dataset").agg(F.max("mean_best_j").alias("_mx"))
    r = ranked.join(best, "dataset")
    base = r.groupBy("sampler").agg(
        F.count("mean_best_j").alias("n_datasets"), F.avg("mean_best_j").alias("mean"),
        F.stddev_samp("mean_best_j").alias("std"), F.min("mean_best_j").alias("min"),
        F.max("mean_best_j").alias("max"), F.avg("rank").alias("average_rank"),
        F.count_if(F.col("rank") == 1.0).alias("n_wins_exclusive_rank1"),
        F.count_if(F.col("mean_best_j") == F.col("_mx")).alias("n_wins_including_ties"))
    q = quantiles_fn(dataset_df, ["sampler"], "mean_best_j", [0.25, 0.5, 0.75], out_names=["q1", "median", "q3"])
    return base.join(q, "sampler").withColumn("iqr", F.col("q3") - F.col("q1"))


def seed_consistency(dataset_df: DataFrame, quantiles_fn) -> DataFrame:
    """Per sampler mean of dataset means, mean / median of per-dataset seed std and CV."""
    base = dataset_df.groupBy("sampler").agg(
        F.avg("mean_best_j").alias("mean_of_dataset_seed_means"),
        F.avg("std_best_j").alias("mean_of_dataset_seed_stds"),
        F.avg("cv_best_j").alias("mean_cv"), F.count(F.lit(1)).alias("n_datasets"))
    q1 = quantiles_fn(dataset_df, ["sampler"], "std_best_j", [0.5], out_names=["median_of_dataset_seed_stds"])
    q2 = quantiles_fn(dataset_df, ["sampler"], "cv_best_j", [0.5], out_names=["median_cv"])
    return base.join(q1, "sampler", "left").join(q2, "sampler", "left")


def winners(dataset_df: DataFrame) -> DataFrame:
    """Per (dataset, sampler) whether the sampler beats all others and how many
    it beats strictly; window counts inside a dataset instead of pairing samplers."""
    w = Window.partitionBy("dataset").orderBy(F.col("mean_best_j").desc())
    n = F.count(F.lit(1)).over(Window.partitionBy("dataset"))
    t = F.count(F.lit(1)).over(Window.partitionBy("dataset", "mean_best_j"))
    x = dataset_df.select("dataset", "sampler", "mean_best_j", F.rank().over(w).alias("_r"), n.alias("_n"), t.alias("_t"))
    beaten = F.col("_n") - (F.col("_r") - 1) - F.col("_t")
    return x.select("dataset", "sampler", "mean_best_j", (beaten == F.col("_n") - 1).alias("beats_all"),
                    beaten.cast("bigint").alias("n_beaten"))
