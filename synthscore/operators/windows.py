"""Running aggregates that stay distributed when one partition key is hot.

A plain ``max(x) over (partition by study order by t rows unbounded preceding)``
sorts a whole study inside one task.  ``running_max`` instead cuts the order
column into blocks: block maxima are aggregated (map-side combine), a prefix
over the small block table gives each block the best value before it, and the
per-row running value is computed inside a block only.  Same answer, and the
largest window holds ``block_size`` order values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage

DEFAULT_BLOCK = 4096


def running_extreme(df: DataFrame, part_cols: Sequence[str], order_col: str, value_col: str, out_col: str,
                    block_size: int = DEFAULT_BLOCK, minimise: bool = False) -> DataFrame:
    part_cols = list(part_cols)
    agg = F.min if minimise else F.max
    pick = F.least if minimise else F.greatest
    blk = F.floor(F.col(order_col) / F.lit(block_size)).cast("bigint")
    d = df.withColumn("_blk", blk)
    blocks = d.groupBy(*part_cols, "_blk").agg(agg(value_col).alias("_bval"))
    wb = Window.partitionBy(*part_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_prev", agg("_bval").over(wb)).drop("_bval")
    wi = (Window.partitionBy(*part_cols, "_blk").orderBy(order_col)
          .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_inblk", agg(value_col).over(wi))
    out = d.join(blocks, part_cols + ["_blk"], "left")
    # greatest/least skip NULLs, so a block with no earlier value keeps its own running value
    return out.withColumn(out_col, pick(F.col("_inblk"), F.col("_prev"))).drop("_blk", "_inblk", "_prev")


def running_max(df, part_cols, order_col, value_col, out_col, block_size: int = DEFAULT_BLOCK):
    return running_extreme(df, part_cols, order_col, value_col, out_col, block_size, minimise=False)


def running_min(df, part_cols, order_col, value_col, out_col, block_size: int = DEFAULT_BLOCK):
    return running_extreme(df, part_cols, order_col, value_col, out_col, block_size, minimise=True)


# ---------------------------------------------------------------- bucketed prefix counts
DEFAULT_BUCKETS = 4096
ROWS_PER_BUCKET = 50_000
MOST_TASKS = 10_000


def bucket_of(v, cuts, steps: int = 13):
    """Number of cut points <= v: binary search over a sorted array (at most 2^steps - 1
    cut points), JVM-side; an empty cut array short-cuts to bucket 0."""
    init = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(cuts), F.lit(0)).alias("hi"))

    def step(acc, _i):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go_right = F.element_at(cuts, mid + 1) <= v
        return F.when(acc["lo"] < acc["hi"],
                      F.when(go_right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                      .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))).otherwise(acc)

    search = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])
    return F.when(F.coalesce(F.size(cuts), F.lit(0)) <= 0, F.lit(0)).otherwise(search)


def value_cuts(values: DataFrame, key_cols: Sequence[str], value_col: str, buckets: int = DEFAULT_BUCKETS,
               accuracy: int = 20_000, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Cut points of the value axis per key: one row per key with at most ``buckets - 1`` doubles.
    The number of buckets follows the key's row count at run time (about ``rows_per_bucket`` rows each),
    so a small key gets no cut at all; beyond ``buckets`` * ``rows_per_bucket`` rows (2 * 10^8) buckets grow."""
    probs = "array(" + ", ".join(f"{i / buckets!r}D" for i in range(1, buckets)) + ")"
    g = values.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.array_distinct(F.expr(f"percentile_approx(`{value_col}`, {probs}, {accuracy})"))).alias("_all"))
    need = F.least(F.lit(buckets), F.ceil(F.col("_n") / F.lit(float(rows_per_bucket)))).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(float(buckets)) / need).cast("int"))
    cuts = F.when(need <= 1, F.array().cast("array<double>")).otherwise(
        F.filter(F.col("_all"), lambda x, i: (i + 1) % step == 0))
    # written: the sketch may fall out differently when it is computed anew for another branch
    return cut_lineage(g.select(*key_cols, cuts.alias("_cuts")))


def with_bucket(df: DataFrame, cuts: DataFrame, key_cols: Sequence[str], value_col: str) -> DataFrame:
    j = df.join(cuts, list(key_cols)) if key_cols else df.crossJoin(cuts)  # one row without keys
    return j.withColumn("_b", bucket_of(F.col(value_col), F.col("_cuts"))).drop("_cuts")


def column_buckets(df: DataFrame, cuts: DataFrame, key: str, value_col: str) -> DataFrame:
    """``with_bucket`` where the key names columns of a table: at most 4095 cuts a column go to all tasks, so no
    column is joined (and sorted) in one task, and no search is interpreted row by row.  Values are not null."""
    table = {r[key]: np.array(r["_cuts"], float) for r in cuts.collect()}

    def place(batches):
        for batch in batches:
            names, values = batch.column(key).dictionary_encode(), batch.column(value_col).to_numpy(zero_copy_only=False)
            code, at = names.indices.to_numpy(zero_copy_only=False), np.zeros(len(values), np.int32)
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = code == i
                at[own] = np.searchsorted(table[name], values[own], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "_b"])
    return df.mapInArrow(place, StructType([*df.schema.fields, StructField("_b", IntegerType())]))


def deal_buckets(df: DataFrame, cuts: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Rows dealt by (key, bucket) to about as many tasks as there are buckets.  The number is named, as a
    count table is so small on disk that adaptive coalescing would put all of it into one task's windows."""
    n = cuts.agg(F.sum(F.size("_cuts") + 1)).first()[0] or 1
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(n), MOST_TASKS))
    return df.repartition(n, *key_cols, "_b")


def prefix_le(counts: DataFrame, part_cols: Sequence[str], value_col: str, count_col: str) -> DataFrame:
    """Add ``_le`` = sum of ``count_col`` over rows of the same part with value <= this value.

    Needs a bucket column ``_b`` (monotone in the value).  Running sums are taken
    inside (part, bucket) windows only; a small per-bucket prefix table adds the
    counts of all earlier buckets.
    """
    part = list(part_cols)
    w = Window.partitionBy(*part, "_b").orderBy(value_col).rangeBetween(Window.unboundedPreceding, 0)
    d = counts.withColumn("_in", F.sum(count_col).over(w))
    tot = counts.groupBy(*part, "_b").agg(F.sum(count_col).alias("_bt"))
    wb = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wb), F.lit(0))).drop("_bt")
    return d.join(tot, [*part, "_b"]).withColumn("_le", F.col("_in") + F.col("_off")).drop("_in", "_off")
