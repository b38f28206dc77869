"""Exact quantiles (linear interpolation, like ``percentile`` / ``quantile_cont``)
without collecting a whole group into one task.

Plan, per group and probability p (n = non-null count, target positions
``floor((n-1)p)`` and ``ceil((n-1)p)``):

1. one aggregation pass: ``count`` and ``percentile_approx`` at p +- delta
   (a mergeable sketch, bounded memory, partial aggregation on the map side);
2. one counting pass: rows below the bracket and rows inside it;
3. only rows inside the bracket are grouped by distinct value and ranked with
   a running sum — the bracket holds about ``2 * n / accuracy`` values, so a
   hot group never lands on one task whole.

If a sketch bracket misses the target (cannot happen within the sketch's
error bound, but checked anyway) the bracket widens to the group's full
range, which is still exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                    accuracy: int = DEFAULT_ACCURACY, out_names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability (NULL for an empty group)."""
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    out_names = list(out_names or [f"q{i}" for i in range(len(probs))])
    delta = 4.0 / accuracy
    base = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))

    lo_p = [max(0.0, p - delta) for p in probs]
    hi_p = [min(1.0, p + delta) for p in probs]
    stats = base.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(x) for x in lo_p + hi_p]), accuracy).alias("_pa"),
    )
    k = len(probs)
    # one row per (group, probability)
    per_p = stats.select(
        *group_cols, "_n", "_min", "_max",
        F.explode(F.arrays_zip(
            F.array(*[F.lit(i) for i in range(k)]).alias("pi"),
            F.array(*[F.lit(p) for p in probs]).alias("p"),
            F.slice("_pa", 1, k).alias("a"),
            F.slice("_pa", k + 1, k).alias("b"),
        )).alias("_z"),
    ).select(*group_cols, "_n", "_min", "_max",
             F.col("_z.pi").alias("_pi"), F.col("_z.p").alias("_p"),
             F.col("_z.a").alias("_a"), F.col("_z.b").alias("_b"))
    pos = (F.col("_n") - 1).cast("double") * F.col("_p")
    per_p = (per_p.withColumn("_lo_idx", F.floor(pos).cast("bigint"))
             .withColumn("_hi_idx", F.ceil(pos).cast("bigint"))
             .withColumn("_frac", pos - F.floor(pos)))

    # pass 2: verify the bracket (count below / up to it)
    joined = base.join(per_p.select(*group_cols, "_pi", "_a", "_b"), group_cols)
    counts = joined.groupBy(*group_cols, "_pi").agg(
        F.count_if(F.col("_v") < F.col("_a")).alias("_c_lt"),
        F.count_if(F.col("_v") <= F.col("_b")).alias("_c_le"),
    )
    per_p = per_p.join(counts, group_cols + ["_pi"], "left")
    ok = (F.col("_c_lt") <= F.col("_lo_idx")) & (F.col("_hi_idx") < F.col("_c_le"))
    per_p = per_p.select(
        *group_cols, "_pi", "_n", "_lo_idx", "_hi_idx", "_frac",
        F.when(ok, F.col("_a")).otherwise(F.col("_min")).alias("_a"),
        F.when(ok, F.col("_b")).otherwise(F.col("_max")).alias("_b"),
        F.when(ok, F.col("_c_lt")).otherwise(F.lit(0)).alias("_c_lt"),
    )

    # pass 3: distinct values inside the bracket, ranked by a running count
    inside = (base.join(per_p.select(*group_cols, "_pi", "_a", "_b"), group_cols)
              .where((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
              .groupBy(*group_cols, "_pi", "_v").agg(F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*group_cols, "_pi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_cum", F.sum("_cnt").over(w)).withColumn("_start", F.col("_cum") - F.col("_cnt"))
    located = inside.join(per_p, group_cols + ["_pi"])
    # value at absolute position idx: the distinct value whose [c_lt + start, c_lt + cum) covers idx
    covers = lambda idx: (F.col("_c_lt") + F.col("_start") <= F.col(idx)) & (F.col(idx) < F.col("_c_lt") + F.col("_cum"))
    vals = located.groupBy(*group_cols, "_pi").agg(
        F.max(F.when(covers("_lo_idx"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(covers("_hi_idx"), F.col("_v"))).alias("_vhi"),
        F.first("_frac").alias("_frac"),
    )
    q = vals.select(*group_cols, "_pi",
                    (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("_q"))
    wide = q.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("_pi") == i, F.col("_q"))).alias(out_names[i]) for i in range(k)])
    # groups with no non-null value still get a row (all NULL)
    keys = df.select(*group_cols).distinct() if group_cols else None
    if keys is None:
        return wide
    return keys.join(wide, group_cols, "left")


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, out_name: str = "median",
                 accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    return exact_quantiles(df, group_cols, value_col, [0.5], accuracy, [out_name])
