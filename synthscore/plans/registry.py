"""Query registry.

A query is ``build(spark, sf_dir) -> DataFrame`` plus (where the result is
SQL-expressible) the equivalent DuckDB SQL over the driver's table views.
Names follow ``<inventory id>_<slug>``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}

_MODULES = ["trial_log", "stats", "reweight", "metrics", "prep", "privacy", "synth", "utility", "reports", "live", "sources"]


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else "")
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def all_queries() -> dict[str, Builder]:
    _load()
    return {k: v.build for k, v in REGISTRY.items()}


def all_oracle_sql() -> dict[str, str]:
    _load()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}
