"""Trial-log sources and result sinks (inventory A1, A4, A8, A10, B1-B6).

Readers return DataFrames whose plans start at the file scan (projections and
filters above them still reach the scan); writers are plain ``DataFrame.write``
calls, partitioned by the study keys where readers filter on them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import duration_to_seconds

# The 20 columns of the master experiment log, in file order.
MASTER_COLUMNS = [
    "dataset", "generator", "status", "best_value", "elapsed_sec", "n_trials", "objective", "fidelity",
    "utility", "privacy_risk", "ks_similarity", "corr_similarity", "mia_auc", "nndr", "dcr", "mean_f1_gap",
    "mean_tstr_f1", "mean_trtr_f1", "run_dir", "error",
]
MASTER_TYPES = {
    "dataset": "string", "generator": "string", "status": "string", "n_trials": "bigint", "run_dir": "string",
    "error": "string",
}

# Column prefixes of the wide trial-tracker export.
PARAM_PREFIX = "params_"
ATTR_PREFIX = "user_attrs_"

TRIAL_KEYS = ["dataset", "generator", "sampler", "seed"]


# ------------------------------------------------------------------ A1
def dataset_config(registry: Mapping, name: str) -> dict:
    """A1: a registry entry with the registry-wide ``defaults`` merged under it."""
    entries = registry.get("datasets", registry)
    if name not in entries:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(k for k in entries if k != 'defaults')}")
    merged = dict(registry.get("defaults", {}))
    merged.update(entries[name] or {})
    return merged


def layered(global_cfg: Mapping, local_cfg: Mapping) -> dict:
    """A1: local settings over global ones, nested maps merged key by key."""
    out = dict(global_cfg)
    for k, v in local_cfg.items():
        out[k] = layered(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


# ------------------------------------------------------------------ A4
def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """A4: rows of differently shaped trial files in one frame; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_trial_files(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", sep: str = ",", **options) -> DataFrame:
    """A4 reader.  Self-describing formats merge their schemas in one scan.  CSV headers differ per
    file: every line is read with the header of its own file, joined by path, into a map from column to
    text, so no list of files and no plan per width is made.  The driver learns the column names and
    their types (long, double, else text; empty fields are NULL) from one aggregation.  Fields may be
    quoted, with "" for a quote, but hold no line breaks.
    """
    if fmt == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(*paths)
    if fmt == "json":
        return spark.read.json(list(paths))
    if options:
        raise ValueError(f"unknown options {sorted(options)}")
    place = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("_f"), place.alias("_at"), "value").where(F.trim("value") != "")
    # a header is its file's first line: in the file's first block, with the least row number there
    heads = lines.where(F.col("_at.b") == 0).groupBy("_f").agg(F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_head"))
    rows = lines.join(heads, "_f").where((F.col("_at.b") != 0) | (F.col("_at.i") != F.col("_first.i")))
    cells = rows.select(F.map_from_arrays(F.array_distinct(_fields(F.col("_head"), sep)),
                                          F.slice(F.concat(_fields(F.col("value"), sep), F.array_repeat(F.lit(None).cast("string"), F.size(_fields(F.col("_head"), sep)))),
                                                  F.lit(1), F.size(F.array_distinct(_fields(F.col("_head"), sep))))).alias("_m"))
    names = heads.select(F.posexplode(_fields(F.col("_head"), sep)).alias("p", "name")).groupBy("name").agg(F.min("p").alias("p"))
    names = [r["name"] for r in names.orderBy("p", "name").collect()]  # one row per distinct column
    if not names:
        return spark.createDataFrame([], "value string")
    wide = cells.select(*[F.when(F.element_at("_m", F.lit(n)) != "", F.element_at("_m", F.lit(n))).alias(n) for n in names])
    kinds = wide.agg(*[x for n in names for x in (
        F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("bigint").isNull()).alias(f"l_{n}"),
        F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("double").isNull()).alias(f"d_{n}"),
        F.count(F.col(f"`{n}`")).alias(f"n_{n}"))]).first()
    kind = {n: "string" if not kinds[f"n_{n}"] or kinds[f"d_{n}"] else "double" if kinds[f"l_{n}"] else "bigint" for n in names}
    return wide.select(*[F.col(f"`{n}`").try_cast(kind[n]).alias(n) for n in names])


def _fields(line: Column, sep: str) -> Column:
    """The fields of one CSV line."""
    cell = rf'{re.escape(sep)}("(?:[^"]|"")*"|[^{re.escape(sep)}]*)'
    return F.transform(F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(cell), F.lit(1)), lambda x: F.when(
        x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


# ------------------------------------------------------------------ A8
def with_keys_from_path(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Study keys parsed from each row's source file path (``_metadata.file_path``)."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def export_complete_trials(df: DataFrame, pattern: str, names: Sequence[str], params: str = "params",
                           param_names: Sequence[str] = ()) -> DataFrame:
    """The COMPLETE trials of a folder of study files, study keys from the file paths, and the
    ``params`` map (or JSON object text) widened to one ``param_<name>`` column per listed name."""
    t = with_keys_from_path(df, pattern, names).where(F.upper("state") == "COMPLETE")
    m = F.col(params) if dict(df.dtypes)[params].startswith("map") else F.from_json(params, "map<string,string>")
    return t.select(*names, *[c for c in df.columns if c != params],
                    *[F.element_at(m, F.lit(p)).alias(f"param_{p}") for p in param_names])


# ------------------------------------------------------------------ A10
def wide_to_trials(wide: DataFrame, dataset: Column, generator: Column, sampler: Column,
                   seed: Column) -> DataFrame:
    """A10: tracker export (``number``, ``value``, ``state``, ``duration``, ``user_attrs_*``,
    ``params_*``) to the trial schema; parameters become ``param_<name>`` columns."""
    cols = set(wide.columns)

    def attr(name: str, dtype: str = "double") -> Column:
        c = f"{ATTR_PREFIX}{name}"
        return (F.col(c) if c in cols else F.lit(None)).cast(dtype)

    base = [
        dataset.alias("dataset"), generator.alias("generator"), sampler.alias("sampler"), seed.alias("seed"),
        (F.col("number").cast("bigint") if "number" in cols else F.lit(None).cast("bigint")).alias("trial_number"),
        (F.col("state").cast("string") if "state" in cols else F.lit("")).alias("state"),
        (F.col("value").cast("double") if "value" in cols else F.lit(None).cast("double")).alias("objective"),
        attr("fidelity").alias("fidelity"), attr("utility").alias("utility"),
        attr("privacy_risk").alias("privacy_risk"),
        (duration_to_seconds(F.col("duration")) if "duration" in cols else F.lit(None).cast("double")
         ).alias("duration_s"),
        F.lit(None).cast("bigint").alias("trial_seed"), F.lit(None).cast("string").alias("error"),
    ]
    params = [F.col(c).alias("param_" + c[len(PARAM_PREFIX):]) for c in wide.columns if c.startswith(PARAM_PREFIX)]
    return wide.select(*base, *params)


# ------------------------------------------------------------------ B1 .. B6
def master_rows(runs: DataFrame) -> DataFrame:
    """B1: the fixed 20-column master-log layout, missing columns as NULL."""
    present = set(runs.columns)
    return runs.select(*[(F.col(c) if c in present else F.lit(None)).cast(MASTER_TYPES.get(c, "double")).alias(c)
                         for c in MASTER_COLUMNS])


def append_master(runs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """B1 sink: append normalised rows (older ragged CSV logs read with an explicit schema)."""
    master_rows(runs).write.mode("append").format(fmt).save(path)


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """B1 reader; CSV is read PERMISSIVE against the fixed schema so short rows pad with NULL."""
    if fmt == "csv":
        schema = ", ".join(f"{c} {MASTER_TYPES.get(c, 'double')}" for c in MASTER_COLUMNS)
        return spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """B2 / B3 / B6 sink for result tables."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_trials(trials: DataFrame, path: str) -> None:
    """Raw per-study trial files, one folder per study key (readers prune on the keys).
    No repartition by the keys first: a study holding a third of the rows would land on one task."""
    write_table(trials, path, "parquet", "append", TRIAL_KEYS)


def status_markers(summaries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Completed / failed markers as a status column of the runs table."""
    s = summaries.select(*TRIAL_KEYS, F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    if failed is not None:
        f = failed.select(*TRIAL_KEYS, F.lit("failed").alias("status"), F.col("error").cast("string"))
        s = s.join(f.select(*TRIAL_KEYS), TRIAL_KEYS, "left_anti").unionByName(f)
    return s


def write_metadata(spark: SparkSession, meta: Mapping[str, object], path: str) -> None:
    """One-row JSON metadata next to a result table."""
    import json
    spark.createDataFrame([(json.dumps(dict(meta), sort_keys=True, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "_metadata_json"))


# ------------------------------------------------------------------ A9 / A11
def trials_of_listed_studies(listed: DataFrame, trials: DataFrame, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """Every trial of each study named in the summaries (duplicates in the list are harmless:
    a left-semi join emits each trial at most once)."""
    return trials.join(listed.select(*keys), list(keys), "left_semi")


def import_new_studies(imported: DataFrame, existing: DataFrame, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """Summarise an imported trial set per study and keep studies not already present."""
    st = F.col("state")
    s = imported.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_trials"),
        F.count_if(st == "COMPLETE").cast("bigint").alias("n_complete"),
        F.max(F.when(st == "COMPLETE", F.col("objective"))).alias("best_objective"))
    return s.join(existing.select(*keys), list(keys), "left_anti")


# ------------------------------------------------------------------ A5 / A6 / A12
def read_study_summaries(spark: SparkSession, root: str, pattern: str, names: Sequence[str],
                         glob: str = "*/*/*/*/summary.json") -> DataFrame:
    """A5: every summary JSON under ``root`` (one object per file), with the study keys parsed
    from the file path; files that do not parse are skipped (A6)."""
    return with_keys_from_path(read_json_permissive(spark, os.path.join(root, glob)), pattern, names)


def missing_cells(found: DataFrame, grid: DataFrame, keys: Sequence[str] = TRIAL_KEYS) -> DataFrame:
    """A5: grid cells without a summary."""
    return grid.select(*keys).join(found.select(*keys), list(keys), "left_anti")


def read_json_permissive(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """Read summaries, skipping unreadable files (DROPMALFORMED: a file that does not parse
    yields no row; the others are read as usual), with the source file recorded."""
    r = spark.read.option("mode", "DROPMALFORMED").option("multiLine", str(multiline).lower())
    if schema:
        r = r.schema(schema)
    return r.json(path).withColumn("source_summary", F.col("_metadata.file_path"))


# Classifier names in model-score files and their short aliases.
CLASSIFIER_ALIASES = {"logistic_regression": "lr", "linear_regression": "lr", "random_forest": "rf",
                      "decision_tree": "dt"}

SCORE_BLOCK = ("map<string, struct<mean_tstr_accuracy: double, mean_trtr_accuracy: double, accuracy_gap: double, "
               "per_clf_tstr_accuracy: map<string, double>, per_clf_trtr_accuracy: map<string, double>>>")


def read_model_scores(spark: SparkSession, path: str, normalise=None) -> DataFrame:
    """Model-score JSON files ({generator: {mean_*, accuracy_gap, per_clf_*: {classifier: v}}})
    flattened to one row per generator with tstr / trtr / gap and tstr_<alias> / trtr_<alias>."""
    raw = spark.read.option("wholetext", "true").text(path)
    blocks = raw.select(F.explode(F.from_json("value", SCORE_BLOCK)).alias("name", "b"))
    name = normalise(F.col("name")) if normalise else F.col("name")
    cols = [name.alias("generator"), F.col("b.mean_tstr_accuracy").alias("tstr"),
            F.col("b.mean_trtr_accuracy").alias("trtr"), F.col("b.accuracy_gap").alias("gap")]
    for src, prefix in (("per_clf_tstr_accuracy", "tstr"), ("per_clf_trtr_accuracy", "trtr")):
        for clf, alias in CLASSIFIER_ALIASES.items():
            if clf == "linear_regression":
                continue
            v = F.element_at(F.col(f"b.{src}"), F.lit(clf))
            if alias == "lr":
                v = F.coalesce(v, F.element_at(F.col(f"b.{src}"), F.lit("linear_regression")))
            cols.append(v.alias(f"{prefix}_{alias}"))
    return blocks.where(F.col("b").isNotNull()).select(*cols)
