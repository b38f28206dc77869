"""Exact duplicates: against brute force, edge cases, what the levels let through, large groups."""

import hashlib
import re

from pyspark.sql import functions as F

from synthscore.llm import exact_dedup
from synthscore.operators.spread import with_totals

from .test_edges import TEXTS, docs, frame, none  # noqa: F401


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for k, t in enumerate(norm):
        groups.setdefault(t, []).append(k)
    out = []
    for t, own in groups.items():
        best = min(own, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        out += [(rows[k][0], rows[best][0], len(own), hashlib.sha256(t.encode()).hexdigest()) for k in own]
    return sorted(out, key=repr), len(groups)


MORE = [(20, "a b"), (21, "ab"), (22, " a  b "), (23, "ab　"), (24, "x" * 200 + "y"), (25, "x" * 200 + "z"), (26, "x" * 200 + " z"), (27, "ab\x00"),
        (28, "é"), (29, "é"), (30, "\x1c"), (None, "ab"), (31, " a b  ")]


def test_groups(spark, docs, none):  # noqa: F811
    rows = TEXTS + MORE
    for hash_all in (True, False):
        got = exact_dedup.duplicates(frame(spark, rows).repartition(3), hash_all=hash_all).collect()
        want, groups = brute(rows)
        assert sum(r["kept"] for r in got) == groups
        assert all(r["kept"] <= ((r["doc_id"], r["group_size"]) == (r["keep_id"], r["group_size"])) for r in got)
        if hash_all:
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
        else:
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    assert exact_dedup.duplicates(none).collect() == []


def test_levels(spark):
    """A text is hashed in full only where length and prefix hash come twice."""
    rows = [(1, "alone in length"), (2, "same length, other start"), (3, "same length, else start."), (4, "p" * 70 + "1"), (5, "p" * 70 + "2"),
            (6, "twice"), (7, "tw ice")]
    got = {r["doc_id"]: r for r in exact_dedup.duplicates(frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if r["text_sha256"] is not None} == {4, 5, 6, 7}
    assert {tuple(r) for r in exact_dedup.shared_prefixes(frame(spark, rows)).select("size").collect()} == {(71,), (5,)}
    assert [got[i]["group_size"] for i in range(1, 8)] == [1, 1, 1, 1, 1, 2, 2] and got[7]["kept"] and not got[6]["kept"]


def test_totals_of_a_large_group(spark):
    """A third of the rows in one group: no joined partition holds it whole, totals are right."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5000).alias("k"))
    out = with_totals(rows, ["k"], "id", {"n": (F.count("*"), F.sum), "low": (F.min("id"), F.min)})
    got = out.groupBy("k").agg(F.min("n"), F.max("n"), F.min("low"), F.count("*")).collect()
    assert len(got) == 5001 or len(got) == 1 + len({i % 5000 for i in range(30_000) if i % 3})
    assert all(r[1] == r[2] == r[4] for r in got) and {r["k"]: r[3] for r in got}[None] == 0
