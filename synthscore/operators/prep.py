"""F1 .. F10: preprocessing fitted on the train (real) side and applied to both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coding import dense_codes


def fit_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F3 / P-9: level table (col_name, level, code); codes follow the lexicographic order of
    the string form.  One row per distinct level, coded by range partition (``coding.dense_codes``), so a
    column of very many levels is no single task."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level"))
                                         for c in cols])).alias("_x")).select("_x.*")
    lv = long.where(F.col("level").isNotNull()).distinct()
    return dense_codes(lv, ["col_name"], ["level"])


def apply_codes(df: DataFrame, levels: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace each categorical column by its code; unseen or NULL -> -1.

    One equi-join per column against its (small) level table; Spark decides
    broadcast vs shuffle from the measured table size (autoBroadcastJoinThreshold).
    """
    out = df
    for c in cols:
        lv = levels.where(F.col("col_name") == c).select(F.col("level").alias(f"_lv_{c}"), F.col("code").alias(f"_cd_{c}"))
        out = (out.join(lv, out[c].cast("string") == lv[f"_lv_{c}"], "left")
               .withColumn(c + suffix, F.coalesce(F.col(f"_cd_{c}"), F.lit(-1).cast("bigint")))
               .drop(f"_lv_{c}", f"_cd_{c}"))
    return out


def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], dtype: str = "double") -> DataFrame:
    """Wide -> long (id..., col_name, value) with NULL values dropped."""
    casted = df.select(*id_cols, *[F.col(c).cast(dtype).alias(c) for c in value_cols])
    long = casted.unpivot(list(id_cols), list(value_cols), "col_name", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")) if dtype == "double" else \
        long.where(F.col("value").isNotNull())


def scale_expr(c: Column, mean: Column, std: Column) -> Column:
    """F4 / P-10: (x - mean) / population std; zero std divides by 1."""
    return (c - mean) / F.when((std.isNull()) | (std == 0), F.lit(1.0)).otherwise(std)


# ------------------------------------------------------------------ F1 / F2: imputation
def fit_fill_values(train: DataFrame, discrete: Sequence[str], continuous: Sequence[str]) -> DataFrame:
    """F1 / P-8: mode (smallest of tied modes) for discrete / non-numeric columns, exact median
    for continuous ones, fitted on train only; an empty column fills with 0.

    Returns (col_name, fill_str, fill_num): one row per column.  Modes come from counts per distinct
    value, summed before the shuffle; medians use the bounded exact-quantile plan.
    """
    from .quantiles import exact_quantiles
    spark = train.sparkSession
    parts = []
    if discrete:
        types = {f.name: f.dataType for f in train.schema.fields}
        number = lambda c: F.col(c).try_cast("double") if types[c].typeName() != "string" else F.lit(None).cast("double")
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level"), number(c).alias("num"))
                                                for c in discrete])).alias("_x")).select("_x.*").where(F.col("level").isNotNull())
        n = long.groupBy("col_name", "level", "num").agg(F.count(F.lit(1)).alias("_n"))
        modes = n.groupBy("col_name").agg(F.min_by("level", F.struct(-F.col("_n"), F.col("num"), F.col("level"))).alias("m"))
        modes = spark.createDataFrame([(c,) for c in discrete], "col_name string").join(modes, "col_name", "left")
        parts.append(modes.select("col_name", F.coalesce("m", F.lit("0")).alias("fill_str"),
                                  F.coalesce(F.col("m").try_cast("double"), F.lit(0.0)).alias("fill_num")))
    if continuous:
        long = melt(train, [], continuous)
        names = spark.createDataFrame([(c,) for c in continuous], "col_name string")
        med = exact_quantiles(long, ["col_name"], "value", [0.5], out_names=["m"])
        med = names.join(med, "col_name", "left")
        parts.append(med.select("col_name", F.coalesce(F.col("m"), F.lit(0.0)).cast("string").alias("fill_str"),
                                F.coalesce(F.col("m"), F.lit(0.0)).alias("fill_num")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_fills(df: DataFrame, fills: DataFrame) -> DataFrame:
    """fill NULLs with the fitted values (one small row per column, read on the driver)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = {}
    for r in fills.collect():
        c = r["col_name"]
        if c not in types:
            continue
        t = types[c].typeName()
        if t == "string":
            vals[c] = r["fill_str"]
        elif t in ("integer", "long", "short", "byte"):
            vals[c] = int(round(r["fill_num"]))
        else:
            vals[c] = float(r["fill_num"])
    return df.fillna(vals) if vals else df


# ------------------------------------------------------------------ F4: scaling
def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F4 / P-10: mean and population std per column (one row)."""
    return train.agg(*[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"_mu_{c}"),
                                                  F.stddev_pop(F.col(c).cast("double")).alias(f"_sd_{c}"))])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    j = df.crossJoin(F.broadcast(stats))  # one row
    for c in cols:
        j = j.withColumn(c + suffix, scale_expr(F.col(c).cast("double"), F.col(f"_mu_{c}"), F.col(f"_sd_{c}")))
    return j.drop(*[x for c in cols for x in (f"_mu_{c}", f"_sd_{c}")])


# ------------------------------------------------------------------ F8 / F9
def label_space(*frames_and_cols) -> DataFrame:
    """F8: sorted union of the label strings of several (frame, column) pairs -> (label, idx)."""
    u = None
    for df, c in frames_and_cols:
        x = df.select(F.col(c).cast("string").alias("label")).where(F.col("label").isNotNull())
        u = x if u is None else u.unionByName(x)
    return dense_codes(u.distinct(), [], ["label"], "idx")


def decode_codes(df: DataFrame, code_col: str, levels: DataFrame, out_col: str) -> DataFrame:
    """integer codes back to labels, clipped to the valid range [0, n-1].
    ``levels``: (level, code) of one column; they are joined by code, never packed into one row."""
    top = levels.agg(F.max("code").alias("_top"))
    idx = F.least(F.greatest(F.round(F.col(code_col).cast("double")).cast("bigint"), F.lit(0)), F.col("_top"))
    lv = levels.select(F.col("code").alias("_code"), F.col("level").alias(out_col))
    j = df.crossJoin(top).withColumn("_at", idx)  # one row
    return j.join(lv, F.col("_at") == F.col("_code"), "left").drop("_top", "_at", "_code")


def assemble_decoded(df: DataFrame, id_cols: Sequence[str], template: Sequence[tuple[str, str]], numeric: Sequence[str],
                     categorical: Sequence[str], levels: DataFrame, numeric_col: str = "numeric",
                     codes_col: str = "codes") -> DataFrame:
    """an array of numeric values and an array of category codes (class target included) back to
    named columns in the order and types of ``template`` (name, type).  Codes are clipped to the
    valid range and decoded by a join with the level table, one join per categorical column."""
    out = df.select(*id_cols, *[F.get(numeric_col, F.lit(i)).alias(f"_n_{c}") for i, c in enumerate(numeric)],
                    *[F.get(codes_col, F.lit(i)).cast("bigint").alias(f"_c_{c}") for i, c in enumerate(categorical)])
    for c in categorical:
        lv = levels.where(F.col("col_name") == c).select(F.col("code").alias(f"_k_{c}"), F.col("level").alias(f"_l_{c}"))
        top = lv.agg(F.max(f"_k_{c}").alias(f"_m_{c}"))
        out = out.crossJoin(F.broadcast(top)).withColumn(f"_c_{c}", F.least(F.greatest(F.col(f"_c_{c}"), F.lit(0)), F.col(f"_m_{c}")))
        out = out.join(lv, F.col(f"_c_{c}") == F.col(f"_k_{c}"), "left")
    pick = {c: F.col(f"_n_{c}") for c in numeric} | {c: F.col(f"_l_{c}") for c in categorical}
    return out.select(*id_cols, *[pick[c].try_cast(t).alias(c) for c, t in template])


# ------------------------------------------------------------------ F6 / F7: model feature matrix
def feature_matrix(df: DataFrame, train: DataFrame, id_cols: Sequence[str], numeric: Sequence[str],
                   categorical: Sequence[str]) -> DataFrame:
    """the model input as a sparse long matrix (id..., feature, value): numerics scaled with
    the train mean / population std, categoricals one-hot over the train levels (``col=level``,
    1.0; zeros are not stored, so an unseen level is an all-zero row).  Fitted on the train side
    only (F7); the level table is one row per train level."""
    ids = list(id_cols)
    st = fit_scaler(train, numeric)
    z = apply_scaler(df.select(*ids, *numeric), st, numeric)
    num = melt(z, ids, numeric).select(*ids, F.col("col_name").alias("feature"), "value")
    lv = fit_levels(train, categorical).select("col_name", "level")
    long = df.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("_x")
    ).select(*ids, "_x.col_name", "_x.level")
    cat = long.join(lv, ["col_name", "level"]).select(
        *ids, F.concat_ws("=", "col_name", "level").alias("feature"), F.lit(1.0).alias("value"))
    return num.unionByName(cat)


def feature_vectors(df: DataFrame, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``df`` with a sparse vector per row: ``n_features``, ``indices`` (ascending) and ``values``.

    The feature space is fitted on ``train``: the numerics (scaled by its mean and population std) in
    the given order, then one place per train level of every categorical, columns in the given order,
    levels in string order.  Zeros, nulls and unseen levels have no entry; no columns at all give one
    zero column.  One join per categorical with its level table, no shuffle of a long matrix.
    """
    numeric, categorical = list(numeric), list(categorical)
    out = apply_scaler(df, fit_scaler(train, numeric), numeric, "_z") if numeric else df
    entries = [F.struct(F.lit(i).alias("i"), F.col(f"{c}_z").alias("v")) for i, c in enumerate(numeric)]
    size, drop = len(numeric), [f"{c}_z" for c in numeric]
    if categorical:
        levels = fit_levels(train, categorical)
        counts = {r["col_name"]: r["n"] for r in levels.groupBy("col_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
        out = apply_codes(out, levels, categorical, "_code")
        for c in categorical:
            at = F.col(f"{c}_code")
            entries.append(F.struct((F.lit(size) + at).cast("int").alias("i"), F.when(at >= 0, F.lit(1.0)).alias("v")))
            size += counts.get(c, 0)
        drop += [f"{c}_code" for c in categorical]
    cells = F.filter(F.array(*entries), lambda e: e["v"].isNotNull() & ~F.isnan(e["v"]) & (e["v"] != 0)) if entries else F.array().cast("array<struct<i:int,v:double>>")
    return (out.withColumn("_cells", cells).drop(*drop)
            .select(*df.columns, F.lit(max(size, 1)).alias("n_features"), F.transform("_cells", lambda e: e["i"]).alias("indices"),
                    F.transform("_cells", lambda e: e["v"]).alias("values")))
