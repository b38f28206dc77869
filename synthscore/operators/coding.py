"""Dense codes by value order, without a window over a whole column.

Rows are range-partitioned by (keys, order) and sorted inside their partition; a row's code is its
place in the partition plus the number of rows of its key in earlier partitions.  Only one count per
(key, partition) meets a window.  The partitioned rows are written once, as range borders come from
a sample and must not move between the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition number above, row number in the lower 33 bits


def dense_codes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out_col: str = "code") -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` among the rows of ``keys``, nulls first.  Rows that
    are equal in both get different places, in no fixed order."""
    keys, by = list(keys), [*keys, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(_LOW)).alias("_at")).drop("_id"))
    per = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_off")
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(per, on).withColumn(out_col, (F.col("_at") + F.col("_off")).cast("bigint")) \
                 .select(*rows.columns, out_col)
