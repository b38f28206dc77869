"""E1 .. E6: deterministic sampling and splits.

Random generators cannot be reproduced across engines, so every draw orders
rows by ``md5(seed || '|' || key)`` (P-34) — identical in Spark and in SQL.

Per-group "first n rows in hash order" is computed without ranking a whole
group on one task: counts per (group, hash prefix) — at most 16^4 prefixes —
give the cumulative count before each prefix; prefixes entirely below the quota
are taken whole, and an exact rank is computed only inside the one boundary
prefix of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_LEN = 4


def hash_key(seed, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], quotas: DataFrame | int, seed, key: str,
                    prefix_len: int = PREFIX_LEN) -> DataFrame:
    """Rows whose position in (md5 key, key) order inside their group is < quota.

    ``quotas``: an int (same for every group) or a DataFrame (group..., quota).
    """
    g = list(group_cols)
    d = df.withColumn("_h", hash_key(seed, key)).withColumn("_p", F.substring("_h", 1, prefix_len))
    cnt = d.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    if isinstance(quotas, int):
        cnt = cnt.withColumn("_q", F.lit(int(quotas)).cast("bigint"))
    else:
        q = quotas.select(*g, F.col("quota").cast("bigint").alias("_q"))
        cnt = cnt.join(q, g) if g else cnt.crossJoin(q)
    cnt = cnt.where(F.col("_before") < F.col("_q"))
    full = cnt.where(F.col("_before") + F.col("_c") <= F.col("_q")).select(*g, "_p")
    edge = cnt.where(F.col("_before") + F.col("_c") > F.col("_q")).select(*g, "_p", (F.col("_q") - F.col("_before")).alias("_need"))
    taken_full = d.join(full, [*g, "_p"], "left_semi")
    e = d.join(edge, [*g, "_p"])
    we = Window.partitionBy(*g, "_p").orderBy("_h", key)
    taken_edge = e.withColumn("_r", F.row_number().over(we)).where(F.col("_r") <= F.col("_need")).drop("_r", "_need")
    return taken_full.unionByName(taken_edge).drop("_h", "_p")


def shuffled_position(df: DataFrame, key: str, seed, prefix_len: int = PREFIX_LEN, out_col: str = "position") -> DataFrame:
    """Deterministic shuffle — every row with its place (from 0) in (md5 key, key) order.  Places
    come from counts per hash prefix, so no task sorts the whole table."""
    d = df.withColumn("_h", hash_key(seed, key)).withColumn("_p", F.substring("_h", 1, prefix_len))
    before = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(
        F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) - 1
    return d.withColumn("_in", within).join(before, "_p").withColumn(out_col, (F.col("_before") + F.col("_in")).cast("bigint")) \
            .drop("_h", "_p", "_in", "_before")


def uniform_cap(df: DataFrame, key: str, max_samples: int, seed=42) -> DataFrame:
    """At most ``max_samples`` rows (first in hash order); no-op when the cap is <= 0."""
    if max_samples is None or int(max_samples) <= 0:
        return df
    return top_n_per_group(df, [], int(max_samples), seed, key)


def balanced_subsample(df: DataFrame, key: str, target: str, max_samples: int, seed=42,
                       task: str = "classification", balance: bool = True) -> DataFrame:
    """E2 / P-6: quota max(1, max_samples // n_classes) per class (capped by class size), deficit
    topped up from the leftovers in hash order; also balances tables smaller than the cap."""
    if max_samples is None or int(max_samples) <= 0:
        return df
    m = int(max_samples)
    classes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    n_classes = classes.count()  # number of classes: a label cardinality, small
    if not (balance and task == "classification" and n_classes >= 2):
        return uniform_cap(df, key, m, seed)
    per_class = max(1, m // n_classes)
    quotas = classes.select(target, F.least(F.col("n_c"), F.lit(per_class)).alias("quota"))
    picked = top_n_per_group(df.where(F.col(target).isNotNull()), [target], quotas, seed, key)
    deficit = quotas.agg(F.greatest(F.lit(0), F.lit(m) - F.sum("quota")).alias("quota"))
    left = df.join(picked.select(key), key, "left_anti")
    extra = top_n_per_group(left, [], deficit, seed, key)
    return picked.unionByName(extra)


def class_test_quotas(df: DataFrame, target: str, test_size: float) -> DataFrame:
    """Largest-remainder allocation of ceil(test_size * n) test rows over classes (ties: class order).
    NULL targets are no class: they get no quota, so the test side is not short of rows."""
    c = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("n"))
    c = c.crossJoin(tot).withColumn("n_test", F.ceil(F.lit(float(test_size)) * F.col("n")))
    c = c.withColumn("_exact", F.col("n_test") * F.col("n_c") / F.col("n")) \
         .withColumn("_base", F.floor("_exact")).withColumn("_rem", F.col("_exact") - F.col("_base"))
    w = Window.orderBy(F.col("_rem").desc(), F.col(target))  # one row per class
    wall = Window.partitionBy()
    c = c.withColumn("_left", F.col("n_test") - F.sum("_base").over(wall)).withColumn("_i", F.row_number().over(w))
    return c.select(target, (F.col("_base") + F.when(F.col("_i") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def can_stratify(df: DataFrame, target: str) -> bool:
    """P-7: at least two classes and every class with at least two rows (NULL is no class)."""
    s = df.where(F.col(target).isNotNull()).groupBy(target).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("m")).collect()[0]
    return bool(s["k"] > 1 and s["m"] >= 2)


def train_test_split(df: DataFrame, key: str, target: str | None, test_size: float, seed=42,
                     task: str = "classification") -> DataFrame:
    """Adds ``split`` = 'train' / 'test'; stratified by class when allowed (P-7).  Rows that repeat
    a key follow it to one side."""
    strat = bool(target) and task == "classification" and can_stratify(df, target)
    if strat:
        quotas = class_test_quotas(df, target, test_size)
        test = top_n_per_group(df.where(F.col(target).isNotNull()), [target], quotas, seed, key)
    else:
        n_test = df.agg(F.ceil(F.lit(float(test_size)) * F.count(F.lit(1))).alias("quota"))
        test = top_n_per_group(df, [], n_test, seed, key)
    t = test.select(key).distinct().withColumn("_t", F.lit(True))  # rows of one key go to one side
    return df.join(t, key, "left").withColumn("split", F.when(F.col("_t"), F.lit("test")).otherwise(F.lit("train"))).drop("_t")


def train_val_test_split(df: DataFrame, key: str, target: str | None, seed=42, task: str = "classification",
                         min_rows: int = 10) -> DataFrame:
    """E5: 80 / 10 / 10, stratified in both steps when allowed; fewer than ``min_rows`` rows -> all train."""
    if df.limit(min_rows).count() < min_rows:
        return df.withColumn("split", F.lit("train"))
    from ..session import cut_lineage
    a = cut_lineage(train_test_split(df, key, target, 0.2, seed, task))
    hold = a.where(F.col("split") == "test").drop("split")
    b = train_test_split(hold, key, target, 0.5, f"{seed}v", task)
    b = b.withColumn("split", F.when(F.col("split") == "test", F.lit("test")).otherwise(F.lit("val")))
    return a.where(F.col("split") == "train").unionByName(b)


def attack_pair_sample(real: DataFrame, synth: DataFrame, key_real: str, key_synth: str, cap: int = 2000,
                       min_n: int = 20, seed=42):
    """Equal-size samples of both sides (n = min(real, synth, cap)); n < min_n -> nothing.
    Returns (real sample with ``member`` = 1, synthetic sample with ``member`` = 0, n)."""
    n = min(real.limit(cap).count(), synth.limit(cap).count())
    if n < min_n:
        return None, None, n
    r = top_n_per_group(real, [], n, seed, key_real).withColumn("member", F.lit(1))
    s = top_n_per_group(synth, [], n, seed, key_synth).withColumn("member", F.lit(0))
    return r, s, n
