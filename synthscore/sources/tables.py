"""Readers for the driver's parquet tables (inventory A2, A3)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one table; the optional projection reaches the parquet scan (ReadSchema)."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_source(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A3: reader dispatch by source kind; unsupported kinds raise."""
    kind = (kind or "").lower()
    if kind == "csv":
        opts = {"header": "true", "inferSchema": "true"}
        sep = options.pop("separator", options.pop("sep", None))
        if sep:
            opts["sep"] = sep
        enc = options.pop("encoding", None)
        if enc:
            opts["encoding"] = enc
        opts.update({k: str(v) for k, v in options.items()})
        return spark.read.options(**opts).csv(path)
    if kind in ("parquet", "json", "orc"):
        return getattr(spark.read.options(**{k: str(v) for k, v in options.items()}), kind)(path)
    raise ValueError(f"unsupported dataset source: {kind!r}")
