"""The end-to-end loader — clean, cap, split, infer the specification, fit and apply the preprocessing."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import clean as C
from . import prep as P
from . import roles as D
from . import sampling as E


@dataclass(frozen=True)
class LoadedDataset:
    """Train and test in one frame (column ``split``), with what was fitted on the train side."""
    spec: D.DatasetSpec
    frame: DataFrame
    levels: DataFrame
    fills: DataFrame
    scaler: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.frame.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.frame.where(F.col("split") == "test")


def columns_to_encode(roles_rows, target: str | None, task: str, cap: int) -> list[str]:
    """D3: categorical roles, integer-like columns with 1 < n_unique <= cap, and a class target."""
    enc = [r["col_name"] for r in roles_rows if r["role"] == "categorical"
           or (cap > 0 and r["integer_like"] and 1 < r["n_unique"] <= cap)]
    return enc + ([target] if target and task == "classification" and target not in enc else [])


def load_train_test(raw: DataFrame, cfg: Mapping, seed_sample="42", seed_split="42s") -> LoadedDataset:
    """C1-C6, E2 (only with a ``max_samples`` above 0), E4, D2-D4, F1-F4.

    ``cfg``: key, target, task, features (default: all other columns), cleaning entries as for
    ``clean``, max_int_categories, max_samples, test_size.  Codes are train levels (unseen or NULL:
    -1); continuous features get a ``<name>_z`` column beside them.  The spec holds the row counts.
    """
    key, target, task = cfg["key"], cfg.get("target"), cfg.get("task", "classification")
    cap = int(cfg.get("max_int_categories", 20) or 0)
    df = C.clean(raw, cfg)
    C.row_guard(df, int(cfg.get("min_rows", 5)), target)
    df = E.balanced_subsample(df, key, target, int(cfg.get("max_samples") or 0), seed_sample, task)
    sp = cut_lineage(E.train_test_split(df, key, target, float(cfg.get("test_size", 0.25)), seed_split, task))
    features = list(cfg.get("features") or [c for c in df.columns if c not in (key, target)])
    rows = D.infer_roles(D.column_profile(sp, features + ([target] if target else []), cap), cfg, target).collect()
    enc = columns_to_encode(rows, target, task, cap)
    cont = [c for c in features if c not in enc]
    train = sp.where(F.col("split") == "train")
    fills = P.fit_fill_values(train, enc, cont)
    filled = P.apply_fills(sp, fills)
    levels = P.fit_levels(filled.where(F.col("split") == "train"), enc)
    coded = P.apply_codes(filled, levels, enc)
    scaler = P.fit_scaler(coded.where(F.col("split") == "train"), cont)
    frame = P.apply_scaler(coded, scaler, cont, "_z") if cont else coded
    n = {r["split"]: r["n"] for r in sp.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    spec = D.spec_from_roles(str(cfg.get("name", key)), rows, target, task, n.get("train", 0), n.get("test", 0))
    return LoadedDataset(spec, frame, levels, fills, scaler)
