"""URL rules by a sort-merge range join over reversed-host keys (DataFrame functions only).

A rule (host, path) becomes the key ``reversed host / path`` and covers the interval of all keys
that start with it; such intervals nest or are disjoint.  A url has one probe key per suffix of its
host (a rule also fits subdomains).  Rules and probes are range-partitioned and sorted together; a
sweep over the sorted rows keeps the stack of open rules, one slot per nesting depth, and the
topmost slot whose interval still holds the probe is its longest rule.  What is open where a
partition begins comes from the last openings of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts after every other character: end of a prefix interval.
LAST = chr(0x10FFFF)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a DataFrame."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r)]) for r in rules]
    none = F.lit(None).cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else none))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    # a host holds no "/", so the first one ends the host part
    return F.concat(F.concat_ws(".", labels), F.lit("/"), path)


def _range_parts(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Range partitions numbered in key order; equal keys may fall on both sides of a border.
    Written once: the borders come from a sample, and every reader must see the same ones."""
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "url-sweep")


def _before(per_part: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per partition number: aggregates over the partitions before it (one row per partition)."""
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return per_part.select("part", *[v.over(w).alias(k) for k, v in values.items()])


def nested_depths(rules: DataFrame, n: int) -> DataFrame:
    """Rules (key, rule, verdict) with ``depth``: how many rules' intervals hold its key, itself included.
    A running sum over the sorted interval starts (+1) and ends (-1)."""
    events = rules.select("key", F.lit(1).alias("step"), "rule", "verdict").unionByName(
        rules.select(F.concat("key", F.lit(LAST)).alias("key"), F.lit(-1).alias("step"),
                     F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
    parts = _range_parts(events, n, "key", "step")
    sums = _before(parts.groupBy("part").agg(F.sum("step").alias("s")), {"open_before": F.sum("s")})
    w = W.partitionBy("part").orderBy("key", "step").rowsBetween(W.unboundedPreceding, 0)
    return (parts.join(sums, "part")
            .withColumn("depth", F.coalesce("open_before", F.lit(0)) + F.sum("step").over(w))
            .where("step = 1").select("key", "rule", "verdict", "depth"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Longest fitting rule of every row's url.

    ``pages`` needs page_id and url (more columns are ignored); ``rules`` has verdict, host, path.
    Returns page_id, url, host, path, rule, verdict, one row per input row.  A rule fits its host
    and all subdomains where the url's path starts with the rule's path; the rule with the longest
    ``host + path`` wins, then the longer host.  Of equal rules with different verdicts ``block``
    wins.  Without a fitting rule: rule null, verdict ``default``.  Null urls and urls without
    ``://`` have empty host and path and fit no rule.  Null page_ids and repeated rows stay.
    """
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.translate(F.trim("host"), UPPER, LOWER)
    opens = (rules.where(F.col("host").isNotNull() & (F.length(F.trim("host")) > 0))
             .select(_key(_labels(host), F.coalesce("path", F.lit(""))).alias("key"),
                     F.concat(host, F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
             .groupBy("key", "rule").agg(F.max("verdict").alias("verdict")))
    opens = nested_depths(opens, n)
    depth = opens.agg(F.max("depth")).first()[0] or 0  # one number: how deep rules nest

    urls = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    probes = urls.withColumn("labels", _labels(F.col("host"))).select(
        "page_id", "url", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n_labels"))
    probes = probes.select(_key(F.slice("labels", 1, F.col("n_labels")), F.col("path")).alias("key"), F.lit(1).alias("kind"),
                           "page_id", "url", (F.col("n_labels") == F.size("labels")).cast("int").alias("whole"))
    none = {"page_id": "page_id", "url": "string", "whole": "int"}
    kinds = dict(probes.dtypes)
    rows = opens.select("key", F.lit(0).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in none],
                        F.struct("key", "rule", "verdict").alias("opened"), "depth").unionByName(
        probes, allowMissingColumns=True)
    parts = _range_parts(rows, n, "key", "kind", "page_id", "url")

    slots = [f"slot{d}" for d in range(1, depth + 1)]
    opened = [F.when(F.col("depth") == d, F.col("opened")) for d in range(1, depth + 1)]
    last = [F.max_by(F.col("opened"), F.when(F.col("depth") == d, F.col("opened.key"))).alias(s)
            for d, s in enumerate(slots, 1)]
    if slots:
        carried = _before(parts.groupBy("part").agg(*last), {s: F.last(s, ignorenulls=True) for s in slots})
        w = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
        swept = parts.join(carried, "part").select(
            "page_id", "url", "whole", "kind", "key",
            *[F.coalesce(F.last(o, ignorenulls=True).over(w), F.col(s)).alias(s) for o, s in zip(opened, slots)])
        # topmost open rule: slots from the deepest up, valid while the probe lies in the interval
        top = F.coalesce(*[F.when(F.startswith(F.col("key"), F.col(f"{s}.key")), F.col(s)) for s in reversed(slots)])
    else:
        swept, top = parts, F.lit(None).cast("struct<key:string,rule:string,verdict:string>")
    found = swept.where("kind = 1").withColumn("top", top).select("page_id", "url", "whole", F.when(
        F.col("top").isNotNull(), F.struct(F.length("top.rule").alias("n"), F.instr("top.key", "/").alias("host_n"),
                                           F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    best = found.groupBy("page_id", "url").agg(F.max("best").alias("best"), F.sum("whole").alias("copies"))
    return best.select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
