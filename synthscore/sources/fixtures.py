"""Test inputs (FIXTURES.md part B) as DataFrames and as SQL text.

Each fixture exists twice: a DataFrame builder (what the Spark queries read)
and the same definition as dialect-neutral SQL, used to build the DuckDB
oracle queries as common table expressions.  The fixtures *partition* whole
tables (e.g. odd / even order keys become the real and the synthetic side);
no rows are dropped to make checks cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _div_floor(c: Column, d: int) -> Column:
    return F.floor(c / F.lit(d)).cast("bigint")


# ---------------------------------------------------------------- FX-1 real / synthetic
FX1_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus"]
FX1_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FX1_CATEGORICAL = ["l_returnflag", "l_linestatus"]


def fx1_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", FX1_COLS)
    return li.where(F.col("l_orderkey") % 2 == 0)


def fx1_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", FX1_COLS).where(F.col("l_orderkey") % 2 == 1)
    t = _div_floor(F.col("l_orderkey"), 2) % 4
    return li.select(
        t.alias("trial_id"), "l_orderkey", "l_linenumber",
        (F.col("l_quantity") + t).alias("l_quantity"),
        (F.col("l_extendedprice") * (F.lit(1.0) + F.lit(0.05) * t)).alias("l_extendedprice"),
        "l_discount", "l_tax",
        F.when(F.col("l_orderkey") % 10 == 1, F.lit("N")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


FX1_REAL_SQL = """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
from lineitem where l_orderkey % 2 = 0"""

FX1_SYNTH_SQL = """
select cast(floor(l_orderkey / 2) as bigint) % 4 as trial_id, l_orderkey, l_linenumber,
       l_quantity + (cast(floor(l_orderkey / 2) as bigint) % 4) as l_quantity,
       l_extendedprice * (1 + 0.05e0 * (cast(floor(l_orderkey / 2) as bigint) % 4)) as l_extendedprice,
       l_discount, l_tax,
       case when l_orderkey % 10 = 1 then 'N' else l_returnflag end as l_returnflag, l_linestatus
from lineitem where l_orderkey % 2 = 1"""


# ---------------------------------------------------------------- FX-2 messy table
def fx2_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit("?")).otherwise(F.col("c_mktsegment")).alias("segment"),
        (F.col("c_custkey") % 7).alias("visits"),
        F.lit(1).alias("constant_col"),
        F.when(F.col("c_custkey") % 101 == 0, F.lit(None).cast("string"))
        .when(F.col("c_acctbal") > 5000, F.lit("rich"))
        .when(F.col("c_acctbal") > 0, F.lit("mid"))
        .otherwise(F.lit("debt")).alias("target"),
    )


FX2_RAW_SQL = """
select c_custkey as id, c_nationkey as nation,
       case when c_custkey % 13 = 0 then null else c_acctbal end as acctbal,
       case when c_custkey % 17 = 0 then '?' else c_mktsegment end as segment,
       c_custkey % 7 as visits, 1 as constant_col,
       case when c_custkey % 101 = 0 then null when c_acctbal > 5000 then 'rich' when c_acctbal > 0 then 'mid' else 'debt' end as target
from customer"""


# ---------------------------------------------------------------- FX-3 vectors
def fx3_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).where(F.col("vec_id") % 2 == 0)


def fx3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).where(F.col("vec_id") % 2 == 1)


FX3_BASE_SQL = "select vec_id, embedding from embeddings where vec_id % 2 = 0"
FX3_QUERY_SQL = "select vec_id, embedding from embeddings where vec_id % 2 = 1"


# ---------------------------------------------------------------- FX-4 trial log
STUDY_KEYS = ["dataset", "generator", "sampler", "seed"]


def fx4_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    eid = F.col("event_id")
    sampler_code = _div_floor(eid, 15) % 3
    return ev.select(
        eid.alias("event_id"),
        F.concat(F.lit("d"), (eid % 5).cast("string")).alias("dataset"),
        F.concat(F.lit("g"), (_div_floor(eid, 5) % 3).cast("string")).alias("generator"),
        F.when(sampler_code == 0, F.lit("standard_tpe")).when(sampler_code == 1, F.lit("multivariate_tpe"))
        .otherwise(F.lit("gp")).alias("sampler"),
        (_div_floor(eid, 45) % 4).alias("seed"),
        _div_floor(eid, 180).alias("trial_number"),
        F.when(F.col("event_type") == "error", F.lit("PRUNED"))
        .when((F.col("event_type") == "signup") & (eid % 4 == 0), F.lit("FAIL"))
        .otherwise(F.lit("COMPLETE")).alias("state"),
        F.when(eid % 97 == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("value") / (F.col("value") + F.lit(50)), 6)).alias("fidelity"),
        ((eid * 104729 % 1000) / F.lit(999.0)).alias("utility"),
        ((eid * 7919 % 1000) / F.lit(999.0)).alias("privacy_risk"),
        F.col("value").alias("duration_s"),
        F.col("ts").alias("started"),
    )


FX4_TRIALS_SQL = """
select event_id, concat('d', cast(event_id % 5 as string)) as dataset,
       concat('g', cast(cast(floor(event_id / 5) as bigint) % 3 as string)) as generator,
       case cast(floor(event_id / 15) as bigint) % 3 when 0 then 'standard_tpe' when 1 then 'multivariate_tpe' else 'gp' end as sampler,
       cast(floor(event_id / 45) as bigint) % 4 as seed,
       cast(floor(event_id / 180) as bigint) as trial_number,
       case when event_type = 'error' then 'PRUNED' when event_type = 'signup' and event_id % 4 = 0 then 'FAIL' else 'COMPLETE' end as state,
       case when event_id % 97 = 0 then null else round(value / (value + 50), 6) end as fidelity,
       (event_id * 104729 % 1000) / 999e0 as utility,
       (event_id * 7919 % 1000) / 999e0 as privacy_risk,
       value as duration_s, ts as started
from events"""


# ---------------------------------------------------------------- FX-9 predictions
def fx9_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    return lb.select(
        "doc_id",
        F.col("quality").alias("y_true"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(1) - F.col("quality")).otherwise(F.col("quality")).alias("y_pred"),
        ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("score"),
    )


FX9_PRED_SQL = """
select doc_id, quality as y_true, case when doc_id % 5 = 0 then 1 - quality else quality end as y_pred,
       (doc_id * 37 % 101) / 100e0 as score from labels"""


FIXTURE_SQL = {
    "fx1_real": FX1_REAL_SQL,
    "fx1_synth": FX1_SYNTH_SQL,
    "fx2_raw": FX2_RAW_SQL,
    "fx3_base": FX3_BASE_SQL,
    "fx3_query": FX3_QUERY_SQL,
    "fx4_trials": FX4_TRIALS_SQL,
    "fx9_pred": FX9_PRED_SQL,
}


def with_fixtures(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the named fixture views (and extra CTEs) as a WITH clause."""
    ctes = [f"{n} as ({FIXTURE_SQL[n]}\n)" for n in names]
    ctes += [f"{n} as ({body}\n)" for n, body in (extra or [])]
    body = sql.lstrip()
    if ctes and body[:5].lower() == "with ":
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + sql if ctes else sql
