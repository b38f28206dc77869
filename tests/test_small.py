"""Operators and sinks that no registered query calls: A2, A3, A13, B2, B3, B5, B6, C1, C5, C6, C7, C12, C15, D4, G7, G9-G11."""

import json

import pytest
from pyspark.sql import functions as F

from synthscore.functions import scalars
from synthscore.operators import clean, loader, synth
from synthscore.plans.prep import CFG, FEATURES, SEED_SAMPLE, SEED_SPLIT
from synthscore.sources import runs, tables
from synthscore.sources.fixtures import fx2_raw

from .conftest import SF_SMALL


def test_source_dispatch(spark, tmp_path):
    """A2, A3: separator and encoding of a CSV, kinds by name, an unknown kind raises."""
    (tmp_path / "x.csv").write_bytes("id;name\n1;Zoë\n2;b\n".encode("latin-1"))
    df = tables.read_source(spark, "CSV", str(tmp_path / "x.csv"), separator=";", encoding="ISO-8859-1")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Zoë"), (2, "b")] and dict(df.dtypes)["id"] == "int"
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(str(tmp_path / kind))
        assert tables.read_source(spark, kind, str(tmp_path / kind)).count() == 2
    with pytest.raises(ValueError):
        tables.read_source(spark, "xlsx", "x")


SPACE = {"depth": {"type": "int", "low": 2, "high": 10, "step": 2, "default": 4}, "lr": {"type": "float", "low": 1e-4, "high": 1e-1, "log": True},
         "act": {"type": "categorical", "choices": ["relu", "tanh"]}, "opt": {"suggest": "categorical", "choices": ["a", "b", "c"]}}


def test_space_draws_defaults_grid(spark):
    """A13, G9, G10, G11."""
    space = synth.space_frame(spark, SPACE)
    by = {r["parameter"]: r for r in space.collect()}
    assert by["depth"]["kind"] == "int" and by["depth"]["step"] == 2.0 and by["depth"]["default"] == "4" and by["lr"]["log"] and by["opt"]["choices"] == ["a", "b", "c"]
    drawn = [r["params"] for r in synth.draw_candidates(spark, space, 300, seed=1).collect()]
    assert {p["depth"] for p in drawn} == {"2", "4", "6", "8", "10"} and {p["act"] for p in drawn} == {"relu", "tanh"}
    rates = sorted(float(p["lr"]) for p in drawn)
    assert 1e-4 <= rates[0] and rates[-1] <= 1e-1 and 1e-3 < rates[150] < 1e-2  # the middle of a log range
    again = [r["params"] for r in synth.draw_candidates(spark, space, 300, seed=1).collect()]
    assert sorted(map(str, drawn)) == sorted(map(str, again))
    d = synth.with_defaults(spark.createDataFrame([(0, {"a": "1"}), (1, {})], "trial_id long, params map<string,string>"), {"a": 9, "b": 2})
    assert {r["trial_id"]: r["params"] for r in d.collect()} == {0: {"a": "1", "b": "2"}, 1: {"a": "9", "b": "2"}}
    grid = synth.grid_candidates(spark, space).collect()
    assert len({tuple(sorted(r["params"].items())) for r in grid}) == 6 and sorted(r["trial_id"] for r in grid) == list(range(6))


def test_result_sinks(spark, tmp_path):
    """B2, B3, B5, B6."""
    t = spark.createDataFrame([("d", "g", "s", 1, 0.5), ("d", "g", "s", 2, 0.7)], "dataset string, generator string, sampler string, seed long, j double")
    for fmt in ("csv", "parquet"):
        runs.write_table(t, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", "true").option("inferSchema", "true").format(fmt).load(str(tmp_path / fmt))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    runs.write_table(t, str(tmp_path / "by"), partition_by=["seed"])
    assert spark.read.parquet(str(tmp_path / "by")).where("seed = 2").count() == 1
    marks = runs.status_markers(t, t.where("seed = 2").withColumn("error", F.lit("boom")))
    assert {r["seed"]: (r["status"], r["error"]) for r in marks.collect()} == {1: ("completed", None), 2: ("failed", "boom")}
    runs.write_metadata(spark, {"seed": 3, "name": "x"}, str(tmp_path / "parquet"))
    assert json.loads(spark.read.text(str(tmp_path / "parquet" / "_metadata_json")).first()[0]) == {"seed": 3, "name": "x"}


def test_cleaning(spark):
    """C1, C5, C6, C7, C12, C15."""
    df = spark.createDataFrame([(1, " a", 2, 3), (2, "b", 3, 4)], "id int, ` name ` string, `Unnamed: 0` int, gone int")
    out = clean.strip_headers(clean.drop_columns(df, ["gone", "not there"]))
    assert out.columns == ["id", "name"]
    clean.row_guard(out, 2, "name")
    with pytest.raises(ValueError):
        clean.row_guard(out, 3)
    with pytest.raises(ValueError):
        clean.row_guard(out, 1, "target")
    same = clean.align_to(spark.createDataFrame([("x", 7, 1)], "extra string, name int, trial_id int"), out, ["trial_id"])
    assert same.columns == ["trial_id", "id", "name"] and tuple(same.first()) == (1, None, 7)
    t = spark.createDataFrame([("true", "[256, 128]"), ("No", "x"), ("?", None)], "b string, l string")
    got = [tuple(r) for r in t.select(scalars.restore_bool(F.col("b")), scalars.restore_int_list(F.col("l"))).collect()]
    assert got == [(True, [256, 128]), (False, None), (None, None)]
    p = spark.createDataFrame([("g", 1.0, "x", 5.0), ("g", 3.0, "y", 5.0), ("g", 2.0, "z", 5.0), ("h", 9.0, "x", 1.0)], "g string, a double, c string, k double")
    enc = {(r["g"], r["a"]): (r["a_scaled"], r["c_scaled"], r["k_scaled"]) for r in clean.encode_params(p, ["g"], ["a", "k"], ["c"]).collect()}
    assert enc == {("g", 1.0): (0.0, 0.0, 0.5), ("g", 3.0): (1.0, 0.5, 0.5), ("g", 2.0): (0.5, 1.0, 0.5), ("h", 9.0): (0.5, 0.5, 0.5)}


def test_spec_counts(spark):
    """The spec of a loaded dataset holds its row counts."""
    d = loader.load_train_test(fx2_raw(spark, SF_SMALL), CFG | {"max_samples": 0, "features": FEATURES}, SEED_SAMPLE, SEED_SPLIT)
    assert (d.spec.n_train, d.spec.n_test) == (d.train.count(), d.test.count()) and d.spec.n_rows == d.frame.count() > 0


def test_snap_all_discrete_columns(spark):
    """Numeric levels to the nearest (ties and nulls: the earlier, the first), labels that are none to the first, others untouched."""
    levels = spark.createDataFrame([("n", 0, "1"), ("n", 1, "3"), ("n", 2, "10"), ("l", 0, "b"), ("l", 1, "a")], "col_name string, pos int, level string")
    rows = spark.createDataFrame([(1, 2.0, "a", 5.5, "q"), (2, 2.1, "zz", 5.5, "q"), (3, None, None, 5.5, None)], "id int, n double, l string, m double, o string")
    got = {r["id"]: (r["n"], r["l"], r["m"], r["o"]) for r in synth.snap_discrete(rows, levels, ["n", "m"], ["l", "o"]).collect()}
    assert got == {1: (1.0, "a", 5.5, "q"), 2: (3.0, "b", 5.5, "q"), 3: (1.0, "b", 5.5, None)}
