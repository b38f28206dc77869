"""Grouped totals brought back to rows without one task per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_totals(rows: DataFrame, keys: Sequence[str], tag: str, totals: dict[str, tuple[Column, Callable]], salts: int = 64) -> DataFrame:
    """``rows`` with aggregates of their group, for groups of any size.

    ``totals``: name -> (aggregate of rows, aggregate function of the partial results).  Rows are
    dealt out by their key and a salt from ``tag``, a column that differs among the rows of a group
    and is the same whenever it is computed; a group's total goes back to the salts that it uses, so
    there are at most as many copies of totals as rows, and no task takes a whole group.  Null keys
    are a group of their own.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(tag), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[first.alias(n) for n, (first, _) in totals.items()])
    whole = (parts.groupBy(*keys).agg(*[then(n).alias(n) for n, (_, then) in totals.items()], F.collect_set("_salt").alias("_salts"))
             .withColumn("_salt", F.explode("_salts")).drop("_salts"))
    whole = whole.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumnRenamed("_salt", "_its")
    on = F.col("_salt") == F.col("_its")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return salted.join(whole, on).drop("_salt", "_its", *[f"_key_{k}" for k in keys])
