"""Live run monitoring over a stream of trial events (inventory S1-S3).

The reference polls result folders from shell scripts.  Here the trial log is a
stream: every finished (or started) trial is one row with the study keys,
``trial_number``, ``state``, the scores and ``started`` / ``duration_s``.  The
same column functions serve a batch DataFrame and a streaming one, so the live
answer can be checked against the batch answer over the same rows.

* S1 ``live_status``: per-study counts by state and best objective so far
  (streaming aggregation; Spark keeps one small state row per study).  The
  grid scaffold that labels studies ``missing`` is joined in ``foreachBatch``.
* S2 ``refresh_comparison``: each micro-batch appends the new trials to the
  log table (one folder per batch id, so a retried batch overwrites itself)
  and rebuilds the comparison table from the whole log.
* S1 + S2 ``start_live_report``: the same, incrementally; each micro-batch's counts are added to the
  state of the batch before, and state and report are versioned, so readers never miss a table.
* S3 ``hourly_throughput``: trials finished per hour and their mean objective,
  tumbling event-time window with a watermark for late rows (append mode).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LIVE_KEYS = ("sampler", "dataset", "generator")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-less (TIMESTAMP_NTZ) wall-clock time."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def finished_at(started: str = "started", duration: str = "duration_s") -> Column:
    """End instant of a trial as TIMESTAMP (what watermarks need), computed with exact
    microsecond integers from the log's zone-less start time, so no session time zone applies."""
    us = F.round(F.coalesce(F.col(duration), F.lit(0.0)) * 1e6).cast("bigint")
    return F.timestamp_micros(epoch_micros(F.col(started)) + us)


def trial_event_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                       fmt: str = "parquet") -> DataFrame:
    """Source: files of trial rows landing in ``path`` (one file per flushed batch of trials)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


# ------------------------------------------------------------------ S1
def live_counts(trials: DataFrame, keys: Sequence[str] = LIVE_KEYS) -> DataFrame:
    """Per-study state counts and best objective; only count / max aggregates, so the
    streaming state is one fixed-size row per study and updates are associative."""
    st = F.col("state")
    return trials.groupBy(*keys).agg(
        F.count_if(st == "COMPLETE").cast("bigint").alias("n_complete"),
        F.count_if(st == "RUNNING").cast("bigint").alias("n_running"),
        F.count_if(st == "FAIL").cast("bigint").alias("n_fail"),
        F.count_if(st == "PRUNED").cast("bigint").alias("n_pruned"),
        F.count(F.lit(1)).cast("bigint").alias("n_attempted"),
        F.max(F.when(st == "COMPLETE", F.col("objective"))).alias("best_objective"),
    )


def status_label(target_trials: int | Column) -> Column:
    """S1 status of a study from its counts; ``missing`` when the grid cell has no rows."""
    tgt = target_trials if isinstance(target_trials, Column) else F.lit(int(target_trials))
    n = F.coalesce(F.col("n_attempted"), F.lit(0))
    return (F.when(n == 0, F.lit("missing"))
            .when(F.col("n_running") > 0, F.lit("running"))
            .when(F.col("n_complete") >= tgt, F.lit("completed"))
            .when(F.col("n_fail") == n, F.lit("failed"))
            .otherwise(F.lit("started")))


def live_status(counts: DataFrame, grid: DataFrame, target_trials: int | Column,
                keys: Sequence[str] = LIVE_KEYS, queued: DataFrame | None = None) -> DataFrame:
    """Every grid cell with its status, counts (0 for absent cells) and best so far.  A cell
    without rows is ``pending`` where ``queued`` lists it, else ``missing``."""
    j = grid.select(*keys).join(counts, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    j = j.select(*keys, *[zero(c) for c in ("n_complete", "n_running", "n_fail", "n_pruned", "n_attempted")],
                 "best_objective")
    j = j.withColumn("status", status_label(target_trials))
    if queued is None:
        return j
    q = queued.select(*keys).distinct().withColumn("_q", F.lit(True))
    waiting = (F.col("status") == "missing") & F.col("_q")
    return j.join(q, list(keys), "left").withColumn("status", F.when(waiting, F.lit("pending")).otherwise(F.col("status"))).drop("_q")


def start_live_status(stream: DataFrame, grid: DataFrame, target_trials: int, out_path: str,
                      checkpoint: str, keys: Sequence[str] = LIVE_KEYS, trigger: dict | None = None,
                      queued: DataFrame | None = None) -> StreamingQuery:
    """S1 + S2 sink: the running counts (complete mode: one row per study, bounded by the grid)
    are labelled against the grid scaffold and the status table is rewritten each trigger.  Cells that
    ``queued`` lists are ``pending`` until their first trial."""
    counts = live_counts(stream, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        live_status(batch, grid, target_trials, keys, queued).write.mode("overwrite").parquet(out_path)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------------ S2
def refresh_comparison(stream: DataFrame, log_path: str, report_path: str, checkpoint: str,
                       build: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch to the trial log, then rebuild the report from the whole log.

    The batch lands in ``log_path/batch_id=<id>`` with overwrite, so a batch replayed after a
    failure replaces its own output instead of duplicating rows; the report is a full rewrite."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(log_path, f"batch_id={batch_id}"))
        log = spark.read.parquet(log_path).drop("batch_id")
        build(log).write.mode("overwrite").parquet(report_path)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------------ versioned tables, incremental state
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are complete: a folder ``v=<n>`` counts once its writer has committed it."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def read_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than ``before``), None without one.  A reader never sees a
    version that is being written, and an older one stays while newer ones appear."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={known[-1]}") if known else None


def write_version(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write version ``version`` (again, after a failure) and delete all but the ``keep`` newest."""
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    spark = df.sparkSession
    for old in versions(spark, path)[:-max(keep, 2)]:
        fs, p = _fs(spark, f"{path}/v={old}")
        fs.delete(p, True)


def merge_counts(parts: DataFrame, keys: Sequence[str] = LIVE_KEYS) -> DataFrame:
    """The counts of ``live_counts`` over several deliveries from those of each."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_complete", "n_running", "n_fail", "n_pruned", "n_attempted")],
                                    F.max("best_objective").alias("best_objective"))


def start_live_report(stream: DataFrame, grid: DataFrame, target_trials: int, path: str, checkpoint: str,
                      keys: Sequence[str] = LIVE_KEYS, queued: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """S1 + S2 incrementally: ``path/state`` holds the counts per study, ``path/report`` the labelled grid.

    Every micro-batch is reduced to counts and added to the newest state of an earlier batch, so the log
    is never read again and a batch that is replayed after a failure builds the same version anew.
    Both tables are versioned by batch: a reader (``read_version``) sees the old report or the new one.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        new, old = live_counts(batch, keys), read_version(spark, f"{path}/state", batch_id)
        write_version(new if old is None else merge_counts(old.unionByName(new), keys), f"{path}/state", batch_id)
        counts = spark.read.parquet(f"{path}/state/v={batch_id}")
        write_version(live_status(counts, grid, target_trials, keys, queued), f"{path}/report", batch_id)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------------ S3
def hourly_throughput(trials: DataFrame, watermark: str | None = "2 hours",
                      group_cols: Sequence[str] = ("sampler",)) -> DataFrame:
    """S3: COMPLETE trials finished per hour and their mean objective.  On a stream the
    watermark bounds the state and lets late rows within it still count."""
    t = trials.where(F.col("state") == "COMPLETE").withColumn("finished", finished_at())
    if watermark:
        t = t.withWatermark("finished", watermark)
    g = t.groupBy(F.window("finished", "1 hour").alias("w"), *group_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_finished"),
        F.avg("objective").alias("mean_objective"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("hour_start"), *group_cols, "n_finished",
                    "mean_objective")


def start_hourly_throughput(stream: DataFrame, out_path: str, checkpoint: str, watermark: str = "2 hours",
                            trigger: dict | None = None) -> StreamingQuery:
    """S3 sink: closed hours are appended to a parquet table (file sink, exactly once)."""
    q = hourly_throughput(stream, watermark)
    w = (q.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint))
    return w.trigger(**(trigger or {"availableNow": True})).start()
