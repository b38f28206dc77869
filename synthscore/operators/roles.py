"""D1 .. D5: column roles (categorical / numeric) and discrete levels, inferred in aggregation passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import INTEGER_TYPES, is_numeric_type


def integer_like_expr(c: Column) -> Column:
    """D1 (aggregate): every non-NULL value whole (allclose to its rounding); no value -> false."""
    v = c.cast("double")
    whole = F.abs(v - F.round(v)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.round(v))
    return F.coalesce(F.bool_and(F.when(v.isNotNull(), whole)), F.lit(False))


@dataclass(frozen=True)
class DatasetSpec:
    """Driver-side dataset specification (filled by inference)."""
    key: str
    target: str | None
    task: str
    feature_columns: tuple[str, ...]
    categorical_columns: tuple[str, ...]
    numeric_columns: tuple[str, ...]
    n_rows: int = 0
    n_train: int = 0
    n_test: int = 0
    extras: dict = field(default_factory=dict)

    def require_target(self) -> str:
        if not self.target:
            raise ValueError(f"dataset {self.key!r} has no target")
        return self.target


def column_profile(df: DataFrame, cols: Sequence[str], cap: int = 20) -> DataFrame:
    """One row per column: numeric?, integer-like, exact number of distinct non-NULL values.

    The integer-like test is one aggregation; distinct values are counted exactly by a
    distributed distinct over (column, value) pairs (map-side de-duplication, then one
    count per column) — no per-column set is held in memory.  The result is
    schema-sized (one row per column).
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric_type(types[c])]
    il = df.agg(*[integer_like_expr(F.col(c)).alias(f"_i_{c}") for c in num]).collect()[0] if num else {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("_x")).select("_x.*").where(F.col("v").isNotNull())
    counts = long.distinct().groupBy("col_name").agg(F.count(F.lit(1)).alias("n_unique"))
    rows = []
    for c in cols:
        is_num = c in num
        flag = True if isinstance(types[c], INTEGER_TYPES) else (bool(il[f"_i_{c}"]) if is_num else False)
        rows.append((c, is_num, flag))
    meta = spark.createDataFrame(rows, "col_name string, is_numeric boolean, integer_like boolean")
    return meta.join(counts, "col_name", "left").select(
        "col_name", "is_numeric", "integer_like", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


def infer_roles(profile: DataFrame, cfg: Mapping, target: str | None) -> DataFrame:
    """D2 / P-2: categorical = non-numeric, or integer-like with 1 < n_unique <= cap; forced lists win;
    a constant integer stays numeric; cap 0 switches the integer rule off."""
    cap = int(cfg.get("max_int_categories", 20) or 0)
    forced_cat = list(cfg.get("categorical_columns") or [])
    forced_num = list(cfg.get("numeric_columns") or [])
    c = F.col("col_name")
    role = (F.when(c.isin(forced_cat) if forced_cat else F.lit(False), F.lit("categorical"))
            .when(c.isin(forced_num) if forced_num else F.lit(False), F.lit("numeric"))
            .when(~F.col("is_numeric"), F.lit("categorical"))
            .when(F.lit(cap > 0) & F.col("integer_like") & (F.col("n_unique") > 1) & (F.col("n_unique") <= cap),
                  F.lit("categorical"))
            .otherwise(F.lit("numeric")))
    p = profile.where(c != F.lit(target)) if target else profile
    return p.select("col_name", role.alias("role"), "n_unique", "integer_like")


def override_roles(roles: DataFrame, categorical: Sequence[str] = (), target: str | None = None,
                   task: str = "classification") -> DataFrame:
    """Role metadata for a generator — listed columns and a class target are categorical, whatever
    was inferred; a target without a row gets one."""
    forced = list(categorical) + ([target] if target and task == "classification" else [])
    out = roles.select("col_name", F.when(F.col("col_name").isin(forced), F.lit("categorical")).otherwise(F.col("role")).alias("role"))
    if target:
        own = roles.sparkSession.range(1).select(F.lit(target).alias("col_name"), F.lit(
            "categorical" if task == "classification" else "numeric").alias("role"))
        out = out.unionByName(own.join(roles, "col_name", "left_anti"))
    return out


def spec_from_roles(key: str, roles_rows, target: str | None, task: str, n_train: int = 0, n_test: int = 0) -> DatasetSpec:
    """The spec held by the driver (one row per column — schema-sized) with the counts of both sides."""
    rows = list(roles_rows)
    cats = tuple(r["col_name"] for r in rows if r["role"] == "categorical")
    nums = tuple(r["col_name"] for r in rows if r["role"] == "numeric")
    return DatasetSpec(key, target, task, tuple(r["col_name"] for r in rows), cats, nums, n_train + n_test, n_train, n_test)


def discrete_levels(train: DataFrame, roles: DataFrame, target: str | None, task: str, order_key: Column,
                    int_cap: int = 20) -> DataFrame:
    """Allowed levels per discrete column: categorical roles and a class target keep their
    levels in first-appearance order (appearance = ``order_key``); remaining integer columns with
    at most ``int_cap`` values keep their sorted levels.  (col_name, pos, level) long form,
    bounded by the cardinality of discrete columns."""
    types = {f.name: f.dataType for f in train.schema.fields}
    cats = [r["col_name"] for r in roles.where(F.col("role") == "categorical").select("col_name").collect()]
    if target and task == "classification" and target not in cats:
        cats.append(target)
    ints = [c for c, t in types.items() if isinstance(t, INTEGER_TYPES) and c not in cats]
    long = train.select(order_key.alias("_k"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level"),
                 F.lit(c in cats).alias("_first"), F.col(c).try_cast("double").alias("_num"))
        for c in cats + ints])).alias("_x")).select("_k", "_x.*").where(F.col("level").isNotNull())
    first = long.groupBy("col_name", "level").agg(F.min("_k").alias("_k"), F.first("_first").alias("_first"),
                                                  F.first("_num").alias("_num"))
    n_lv = first.groupBy("col_name").agg(F.count(F.lit(1)).alias("_n"))
    first = first.join(n_lv, "col_name").where(F.col("_first") | (F.col("_n") <= int_cap))
    from .coding import dense_codes
    first = first.withColumn("_o", F.when(F.col("_first"), F.col("_k")))
    return dense_codes(first, ["col_name"], ["_o", "_num", "level"], "pos").select("col_name", F.col("pos").cast("int").alias("pos"), "level")
