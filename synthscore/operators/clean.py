"""C1 .. C15: cleaning, projection and scalar normalisation of raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def drop_columns(df: DataFrame, drop: Sequence[str] = (), drop_unnamed: bool = True) -> DataFrame:
    """C1 / P-3: listed columns and ``Unnamed*`` columns; names are matched before stripping."""
    names = list(drop) + ([c for c in df.columns if c.startswith("Unnamed")] if drop_unnamed else [])
    return df.drop(*[c for c in names if c in df.columns])


def na_to_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Sentinel tokens become NULL in every string column (numeric columns cannot hold them)."""
    if not tokens:
        return df
    toks = [F.lit(t) for t in tokens]
    return df.select(*[F.when(F.col(f.name).isin(*toks), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def map_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """C3 / P-4: literal value map; values without a key keep the original."""
    if column not in df.columns or not mapping:
        return df
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(str(v)))])
    src = F.col(column).cast("string")
    return df.withColumn(column, F.coalesce(F.try_element_at(m, src), src))


def drop_missing(df: DataFrame, target: str | None, impute: bool = True, dropna: bool = True) -> DataFrame:
    """C4 / P-5: with imputation on only rows with a NULL target go; otherwise any-NULL rows."""
    if impute:
        return df.dropna(subset=[target]) if target and target in df.columns else df
    return df.dropna() if dropna else df


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip whitespace around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def row_guard(df: DataFrame, min_rows: int = 5, target: str | None = None) -> None:
    """At least ``min_rows`` rows (reads at most that many) and the target present."""
    if target is not None and target not in df.columns:
        raise ValueError(f"target column {target!r} missing")
    n = df.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"table has only {n} rows (< {min_rows})")


def align_to(synth: DataFrame, real: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Synthetic columns forced to the real column order; absent columns become NULL."""
    have = set(synth.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in real.schema.fields]
    return synth.select(*keep, *cols)


def numeric_frame(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns only (exclusions dropped), as double."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) for f in df.schema.fields
                       if f.name not in set(exclude) and is_numeric_type(f.dataType)])


def coerce_like(synth: DataFrame, real: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Cast each synthetic column to the real column's type; failures -> NULL."""
    rt = {f.name: f.dataType for f in real.schema.fields}
    return synth.select(*keep, *[F.col(c).try_cast(rt[c]).alias(c) if c in rt else F.col(c)
                                 for c in synth.columns if c not in set(keep)])


def clean(df: DataFrame, cfg: Mapping) -> DataFrame:
    """C1 .. C5 in the reference order: drop, NA tokens, target map, column maps, missing rows, headers."""
    out = drop_columns(df, cfg.get("drop_columns") or [], cfg.get("drop_unnamed", True))
    out = na_to_null(out, cfg.get("na_values") or [])
    target = cfg.get("target")
    if target and cfg.get("target_map"):
        out = map_values(out, target, cfg["target_map"])
    for col, mp in (cfg.get("column_maps") or {}).items():
        out = map_values(out, col, mp)
    out = drop_missing(out, target, bool(cfg.get("impute", True)), bool(cfg.get("dropna", True)))
    return strip_headers(out)


# ------------------------------------------------------------------ C15: parameter encoding
def encode_params(df: DataFrame, group_cols: Sequence[str], num_cols: Sequence[str], cat_cols: Sequence[str]) -> DataFrame:
    """Categoricals -> sorted codes inside each group, then min-max to [0, 1] per group; a
    constant column maps to 0.5.  Levels and ranges are small per-group tables joined back
    (partial aggregation; no window spans a whole group)."""
    from pyspark.sql import Window
    g = list(group_cols)
    out = df
    for c in cat_cols:
        out = out.withColumn(f"_s_{c}", F.col(c).cast("string"))
        lv = out.select(*g, f"_s_{c}").where(F.col(f"_s_{c}").isNotNull()).distinct()
        lv = lv.withColumn(f"_e_{c}", (F.dense_rank().over(Window.partitionBy(*g).orderBy(f"_s_{c}")) - 1).cast("double"))
        out = out.join(lv, [*g, f"_s_{c}"], "left").drop(f"_s_{c}")
    vals = {c: F.col(c).cast("double") for c in num_cols}
    vals.update({c: F.col(f"_e_{c}") for c in cat_cols})
    rng = out.groupBy(*g).agg(*[x for c, v in vals.items() for x in (F.min(v).alias(f"_mn_{c}"), F.max(v).alias(f"_mx_{c}"))])
    out = out.join(rng, g) if g else out.crossJoin(F.broadcast(rng))
    res = [F.when(F.col(f"_mx_{c}") == F.col(f"_mn_{c}"), F.lit(0.5))
           .otherwise((v - F.col(f"_mn_{c}")) / (F.col(f"_mx_{c}") - F.col(f"_mn_{c}"))).alias(f"{c}_scaled")
           for c, v in vals.items()]
    return out.select(*df.columns, *res)


def expand_json_map(df: DataFrame, column: str, keys: Sequence[str], prefix: str, value_type: str = "double") -> DataFrame:
    """A JSON object column (e.g. recorded weights) to one column per listed key, ``<prefix><key>``;
    absent keys and unparsable text give NULL."""
    m = F.from_json(F.col(column).cast("string"), f"map<string,{value_type}>")
    return df.select(*[c for c in df.columns if c != column],
                     *[F.element_at(m, F.lit(k)).alias(f"{prefix}{k}") for k in keys])
