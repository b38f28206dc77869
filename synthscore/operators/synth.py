"""G1 .. G11: candidate settings and distributed synthetic-table generators.

Every candidate is a row of a candidate table (``trial_id`` + parameter map);
generators cross the real table with the candidate table (bounded by the number
of candidates, broadcast) so all candidates are produced in one job, keyed by
``trial_id``.  Randomness is derived from hashes of (seed, trial, row key), so a
recomputed partition (lost executor) yields the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bootstrap-with-noise search space (relative noise, log scale) and its default.
BOOTSTRAP_SPACE = {"noise_std": {"type": "float", "low": 0.001, "high": 0.1, "log": True, "default": 0.01}}

_MASK53 = (1 << 53) - 1


def hash_uniform(*cols: Column) -> Column:
    """A deterministic uniform in [0, 1) from the hash of the given columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(_MASK53)).cast("double") / F.lit(float(1 << 53))


def hash_normal(*cols: Column) -> Column:
    """A deterministic standard normal (Box-Muller over two hash uniforms)."""
    u1 = F.greatest(hash_uniform(*cols, F.lit("a")), F.lit(1e-300))
    u2 = hash_uniform(*cols, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


# ------------------------------------------------------------------ A13 / G9 / G10 / G11
def space_frame(spark: SparkSession, space: Mapping[str, Mapping]) -> DataFrame:
    """The search space as a table (parameter, kind, low, high, step, log, choices, default)."""
    rows = []
    for name, s in space.items():
        kind = str(s.get("type") or s.get("suggest") or "categorical").lower()
        rows.append((name, kind, None if s.get("low") is None else float(s["low"]),
                     None if s.get("high") is None else float(s["high"]),
                     None if s.get("step") is None else float(s["step"]), bool(s.get("log", False)),
                     [str(c) for c in s.get("choices", [])] or None, None if s.get("default") is None else str(s["default"])))
    return spark.createDataFrame(rows, "parameter string, kind string, low double, high double, step double, "
                                       "log boolean, choices array<string>, default string")


def draw_candidates(spark: SparkSession, space: DataFrame, n_trials: int, seed: int = 42) -> DataFrame:
    """Random search — every trial draws every parameter (uniform int with step, float,
    log-float, categorical) from a hash uniform; (trial_id, params map<string,string>)."""
    trials = spark.range(n_trials).withColumnRenamed("id", "trial_id")
    x = trials.crossJoin(F.broadcast(space))  # parameters: a schema-sized table
    u = hash_uniform(F.lit(seed), F.col("trial_id"), F.col("parameter"))
    lo, hi = F.col("low"), F.col("high")
    step = F.coalesce(F.col("step"), F.lit(1.0))
    ival = lo + F.floor(u * (F.floor((hi - lo) / step) + 1)) * step
    fval = F.when(F.col("log"), F.exp(F.log(lo) + u * (F.log(hi) - F.log(lo)))).otherwise(lo + u * (hi - lo))
    cval = F.element_at(F.col("choices"), (F.floor(u * F.size("choices")) + 1).cast("int"))
    val = (F.when(F.col("kind").isin("int", "integer"), ival.cast("bigint").cast("string"))
           .when(F.col("kind").isin("float", "uniform", "loguniform"), fval.cast("string"))
           .otherwise(cval))
    return x.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("parameter", val))).alias("params"))


def with_defaults(candidates: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Defaults under the drawn parameters (drawn values win)."""
    if not defaults:
        return candidates
    d = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(str(v)))])
    keep = F.map_filter(d, lambda k, v: ~F.array_contains(F.map_keys("params"), k))
    return candidates.withColumn("params", F.map_concat(keep, F.col("params")))


def grid_candidates(spark: SparkSession, space: DataFrame) -> DataFrame:
    """Grid expansion of the categorical choices (one row per combination)."""
    names = [r["parameter"] for r in space.where(F.col("choices").isNotNull()).select("parameter").collect()]
    g = None
    for n in names:
        part = space.where(F.col("parameter") == n).select(F.explode("choices").alias(n))
        g = part if g is None else g.crossJoin(part)
    if g is None:
        return spark.createDataFrame([(0, {})], "trial_id long, params map<string,string>")
    ordered = g.orderBy(*names)
    from pyspark.sql import Window
    return ordered.select((F.row_number().over(Window.orderBy(*names)) - 1).cast("bigint").alias("trial_id"),
                          F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("params"))


def candidate_errors(candidates: DataFrame, space: Mapping[str, Mapping]) -> DataFrame:
    """(trial_id, error): what is wrong with a candidate's parameters, NULL where nothing is: a numeric
    parameter that is no number, or one below 0 where the space's range is positive."""
    texts = []
    for name, s in space.items():
        if str(s.get("type") or "").lower() not in ("float", "int"):
            continue
        raw = F.col("params")[name]
        x = raw.try_cast("double")
        texts += [F.when(raw.isNotNull() & (x.isNull() | F.isnan(x)), F.concat(F.lit(f"ValueError: {name}="), raw, F.lit(" is not a number"))),
                  F.when(F.lit((s.get("low") or 0) >= 0) & (x < 0), F.concat(F.lit(f"ValueError: {name}="), raw, F.lit(" is below 0")))]
    return candidates.select("trial_id", F.coalesce(*texts, F.lit(None).cast("string")).alias("error"))


# ------------------------------------------------------------------ G1 / G2: bootstrap
def draw_positions(n: int, candidates: DataFrame, seed: int) -> DataFrame:
    """(trial_id, draw, position): ``n`` draws with replacement from positions 0 .. n-1 per candidate.
    A position is 60 bits of md5(seed|trial|draw) modulo n, the same in every engine."""
    spark = candidates.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw"))
    x = draws.crossJoin(candidates.select("trial_id"))  # the output itself: n rows per candidate
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial_id").cast("string"), F.col("draw").cast("string")))
    return x.withColumn("position", F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % F.lit(n))


def bootstrap(real: DataFrame, candidates: DataFrame, key_cols: Sequence[str], numeric_cols: Sequence[str],
              seed: int = 42, noise_param: str = "noise_std") -> DataFrame:
    """Exactly as many rows as the real table has, drawn with replacement for every
    candidate, plus relative Gaussian noise ``noise_std * population std`` (std 0 -> 1) on numeric
    columns; noise 0 = plain bootstrap.

    Draws meet the real rows in a shuffled equi-join on the row's place in hash order, which is found
    from prefix counts; a place is drawn about once, so no join key is hot.
    """
    from .sampling import shuffled_position
    stats = real.agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(F.col(c).cast("double")).alias(f"_sd_{c}") for c in numeric_cols]).first()
    noise = F.coalesce(F.col("params")[noise_param].try_cast("double"), F.lit(0.0))
    rk = F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols])
    placed = shuffled_position(real.withColumn("source_key", rk), "source_key", seed)
    out = (draw_positions(int(stats["_n"]), candidates, seed).join(placed, "position")
           .join(candidates.select("trial_id", noise.alias("_noise")), "trial_id"))
    for c in numeric_cols:
        sd = stats[f"_sd_{c}"] or 1.0
        z = hash_normal(F.lit(seed), F.col("trial_id"), F.col("draw").cast("string"), F.lit(0), F.lit(c))
        out = out.withColumn(c, F.col(c).cast("double") + F.col("_noise") * F.lit(float(sd)) * z)
    return out.drop("_noise", "position")


# ------------------------------------------------------------------ G5 / G6 / G7: snapping
def snap_numeric(v: Column, levels: Column) -> Column:
    """Nearest level (levels: array<double> in level order); NULL / NaN -> first level; a tie
    -> the earlier level."""
    vv = F.when(v.isNull() | F.isnan(v), F.element_at(levels, 1)).otherwise(v)
    best = F.array_min(F.transform(levels, lambda l, i: F.struct(F.abs(vv - l).alias("d"), i.alias("i"))))
    return F.element_at(levels, best["i"] + 1)


def snap_label(v: Column, levels: Column) -> Column:
    """Keep a valid label, else (or NULL) the first level."""
    s = v.cast("string")
    return F.when(s.isNotNull() & F.array_contains(levels, s), s).otherwise(F.element_at(levels, 1))


def snap_discrete(synth: DataFrame, levels: DataFrame, numeric_level_cols: Sequence[str], label_cols: Sequence[str]):
    """Snap all discrete columns; ``levels`` is the D5 long table (col_name, pos, level).

    Labels are looked up in the level table by a join, so a column may have any number of them; a
    numeric column carries its levels as an array to find the nearest (D5 keeps at most ``int_cap`` of
    them for a column that is not categorical).  A column without levels stays as it is.
    """
    x = synth
    for c in numeric_level_cols:
        own = levels.where(F.col("col_name") == c)
        one = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "level"))), lambda r: r["level"].try_cast("double")).alias("_lv"))
        x = x.crossJoin(one).withColumn(c, F.when(F.size("_lv") == 0, F.col(c)).otherwise(snap_numeric(F.col(c).cast("double"), F.col("_lv")))).drop("_lv")  # one row
    for c in label_cols:
        own = levels.where(F.col("col_name") == c)
        first = own.agg(F.min_by("level", "pos").alias("_first"))
        valid = own.select(F.col("level").alias("_valid")).distinct()
        x = x.join(valid, F.col(c).cast("string") == F.col("_valid"), "left").crossJoin(first)  # one row
        x = x.withColumn(c, F.coalesce("_valid", "_first", F.col(c).cast("string"))).drop("_valid", "_first")
    return x


# ------------------------------------------------------------------ G8: resize
def resize(synth: DataFrame, n: int, key: str, group_col: str = "trial_id", seed: str = "resize") -> DataFrame:
    """Exactly n rows per candidate: the first n in hash order, after repeating every row
    ceil(n / count) times when a candidate is short; an empty candidate raises."""
    from .sampling import top_n_per_group
    counts = synth.groupBy(group_col).agg(F.count(F.lit(1)).alias("_cnt"))
    if counts.where(F.col("_cnt") == 0).limit(1).count():
        raise RuntimeError("generator returned an empty frame")
    x = synth.join(counts, group_col)
    x = x.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(float(n)) / F.col("_cnt")).cast("int") - 1,
                                                                      F.lit(0)))))
    x = x.withColumn("_rkey", F.concat_ws("#", F.col("_rep").cast("string"), F.col(key).cast("string")))
    out = top_n_per_group(x, [group_col], int(n), seed, "_rkey")
    return out.drop("_cnt", "_rep", "_rkey")
