"""Column-expression helpers.  All of them stay JVM-side (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "clip01", "is_missing", "safe_round", "md5_order_key", "trial_seed", "rescore_seed",
    "duration_to_seconds", "normalise_generator", "restore_bool", "restore_int_list",
    "std_or_zero", "round9", "col_or_null",
]

INF = float("inf")


def is_missing(c: Column) -> Column:
    """True for NULL, NaN and +-inf."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(INF))


def clip01(c: Column) -> Column:
    """P-1: NULL / NaN / +-inf -> 0.0, else clamp to [0, 1]."""
    c = c.cast("double")
    return F.when(is_missing(c), F.lit(0.0)).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def safe_round(c: Column, digits: int = 4) -> Column:
    """C14: NaN / inf / NULL -> NULL, else round."""
    c = c.cast("double")
    return F.when(is_missing(c), F.lit(None).cast("double")).otherwise(F.round(c, digits))


def round9(c: Column) -> Column:
    """Round floats whose summation order may differ between engines."""
    return F.round(c.cast("double"), 9)


def md5_order_key(seed: int | Column, key: Column) -> Column:
    """P-34: deterministic pseudo-random order, identical in Spark and DuckDB."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_c.cast("string"), F.lit("|"), key.cast("string")))


def trial_seed(seed: Column, trial: Column) -> Column:
    """Per-trial seed (seed * 1000003 + trial * 97) mod (2^31 - 1)."""
    return F.pmod(seed.cast("bigint") * F.lit(1000003) + trial.cast("bigint") * F.lit(97), F.lit(2147483647))


def rescore_seed(seed: Column, trial: Column) -> Column:
    """Re-score fallback seed ``seed * 100000 + trial``."""
    return seed.cast("bigint") * F.lit(100000) + trial.cast("bigint")


# The duration text format "D days HH:MM:SS.ffffff" written by the trial tracker.
# The day part is optional, and text may follow the seconds.
_DURATION_RE = r"^\s*(?:(-?\d+) days?,?\s+)?(\d+):(\d+):(\d+(?:\.\d+)?)"


def duration_to_seconds(c: Column) -> Column:
    """C11: interval text -> seconds; plain numbers pass through; anything else -> NULL."""
    s = F.trim(c.cast("string"))
    matched = F.regexp_extract(s, _DURATION_RE, 4) != F.lit("")
    from_text = (
        F.coalesce(F.regexp_extract(s, _DURATION_RE, 1).try_cast("double"), F.lit(0.0)) * 86400.0
        + F.regexp_extract(s, _DURATION_RE, 2).try_cast("double") * 3600.0
        + F.regexp_extract(s, _DURATION_RE, 3).try_cast("double") * 60.0
        + F.regexp_extract(s, _DURATION_RE, 4).try_cast("double")
    )
    return F.when(c.isNull(), F.lit(None).cast("double")).when(matched, from_text).otherwise(s.try_cast("double"))


def normalise_generator(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-case, compact separators, then apply an alias map (unmatched kept)."""
    compact = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    if not aliases:
        return compact
    m = F.create_map(*[x for kv in aliases.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    squashed = F.regexp_replace(compact, "_", "")
    return F.coalesce(F.element_at(m, compact), F.element_at(m, squashed), compact)


def restore_bool(c: Column) -> Column:
    """Text booleans back to BooleanType; other text -> NULL."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes"), F.lit(True)).when(s.isin("false", "0", "no"), F.lit(False))


def restore_int_list(c: Column) -> Column:
    """``"[256, 256]"`` -> array<int>."""
    return F.from_json(c.cast("string"), "array<int>")


def std_or_zero(c: Column, n: Column) -> Column:
    """P-26: sample std, 0.0 for one value, NULL for none."""
    return F.when(n == 0, F.lit(None).cast("double")).when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def col_or_null(name: str, present: set[str], dtype: str = "string") -> Column:
    return F.col(name) if name in present else F.lit(None).cast(dtype).alias(name)
