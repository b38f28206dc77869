"""Session helpers.

The library never creates a global session on import.  ``get_spark`` is a
convenience for tests, the bench and the examples; on a cluster the caller
passes its own session to every operator.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "synthscore") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("SYNTHSCORE_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SYNTHSCORE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the deployment (a shared file
    system every executor can reach); where it is missing there, this raises,
    as a machine-local folder would lose data.  With a local master (tests) a
    private scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="synthscore-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *parts: Callable) -> list:
    """What ``parts`` return, functions without arguments that run jobs of their own and need nothing of each
    other: their jobs share the session's cores, so short jobs of one fill what another leaves idle.  The
    first error is raised once all have ended."""
    ensure_checkpoint_dir(spark)  # named once, before any part writes to it
    with ThreadPoolExecutor(max(1, len(parts))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(p)) for p in parts]]
