"""The methods at work: runs and levels of the line dedup, rates against a plain solver, bounds of samples and scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscore.llm import common, components, jaccard, line_dedup, mixing, topk

from .test_edges import brute_components


def lines_table(spark, n=400):
    rows = [(i, "\n".join(f"a line of its own or shared {(i * 7 + k * 13) % 300}" for k in range(5))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_later_batches_read_compacted_runs(spark):
    docs = lines_table(spark)
    want = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs, batches=1).collect())
    for how in ({}, {"batches": 9, "fanout": 3}, {"batch_rows": 150}):
        runs = line_dedup.Runs(spark, 3, how.get("fanout", 2))
        got = line_dedup.dropped_lines(docs, runs=runs, **how)
        assert max(runs.read) >= 1  # a run of a level above 0 was joined with
        lost = {r["id"]: set(r["hashes"]) for r in got.collect()}
        kept = [(r["doc_id"], "\n".join(x for x, h in zip(r["text"].split("\n"), line_dedup.line_hashes(r["text"], 10)) if h not in lost.get(r["doc_id"], ())))
                for r in docs.collect()]
        assert sorted(kept) == want
    assert len([b for b in runs.read if b == 0]) >= 1 and runs.read.count(1) >= 2


def test_runs_are_read_in_their_order(spark):
    """The anti-join with a run neither sorts nor shuffles it."""
    runs = line_dedup.Runs(spark, 3)
    hashes = lines_table(spark).select(F.sha2("text", 256).cast("binary").alias("hash"), F.col("doc_id").alias("owner"))
    runs.add(hashes)
    plan = runs.unseen(hashes.limit(50))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin"):].split("\n")
    scan = next(k for k, x in enumerate(side) if "Scan parquet" in x and "line_run" in x or "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    parents, at = [], depth(side[scan])
    for x in reversed(side[:scan]):
        if depth(x) < at:
            parents.append(x)
            at = depth(x)
            if "SortMergeJoin" in x:
                break
    assert parents and not any("Sort [" in x or "Exchange" in x for x in parents)


def test_more_documents_meet_earlier_runs(spark):
    """Runs are kept between calls: a second delivery loses the lines of the first."""
    docs, runs = lines_table(spark), line_dedup.Runs(spark, 2)
    first = {r["id"] for r in line_dedup.dropped_lines(docs.where("doc_id < 200"), runs=runs).collect()}
    again = docs.where("doc_id < 200").withColumn("doc_id", F.col("doc_id") + 1000)
    lost = {r["id"]: len(r["hashes"]) for r in line_dedup.dropped_lines(again, runs=runs).collect()}
    assert lost == {i + 1000: 5 for i in range(200)} and len(first) < 200


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_against_a_plain_solver(spark, least):
    """Rates nearest to 1, none below the bound, with the domain totals of the targets: a projected
    gradient on the rates themselves, with a growing penalty, finds the same."""
    rng = np.random.default_rng(8)
    n, p = 60, rng.dirichlet([0.5, 0.5, 0.5], 60)
    mass = rng.integers(5, 60, n).astype(float)
    rows = [(i, i, 1, int(m), *map(float, x)) for i, (m, x) in enumerate(zip(mass, p))]
    members = spark.createDataFrame(rows, "doc_id long, text_hash long, rows long, tokens long, p0 double, p1 double, p2 double")
    total = 2.2 * mass.sum()
    rate, report = mixing.fit_rates(members, [0.5, 0.3, 0.2], total, tolerance=1e-9, least=least)
    got = np.array([r["r"] for r in members.select("doc_id", rate.alias("r")).orderBy("doc_id").collect()])
    assert report["converged"]
    A, t = (mass[:, None] * p).T, np.array([0.5, 0.3, 0.2]) * total
    r, u = np.ones(n), np.zeros(3)
    for _ in range(200_000):  # gradient steps on the rates and, slowly, on the multipliers
        g = (r - 1) - p @ (u + 0.02 * (t - A @ r))
        r = np.maximum(least, r - 0.01 * g)
        u = u + 0.0002 * (t - A @ r)
    assert np.abs(A @ r - t).max() < 0.5 and np.abs(got - r).max() < 0.02 and got.min() >= least
    assert (mass * (got - 1) ** 2).sum() <= (mass * (r - 1) ** 2).sum() * 1.01


def test_large_components_raise(spark):
    rows = [(0, [1e17] * 4), (1, [1e17] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    with pytest.raises(Exception, match="do not fit a long"):
        topk.top_k(v, F.col("vec_id") % 20 == 0).collect()
    assert topk.accumulate(np.array([[2**31, 1]]), np.array([[2**31, 5], [0, 7]])).tolist() == [[2**62 + 5, 7]]


def test_sample_bounds_rows_not_only_ids(spark):
    docs = spark.createDataFrame([(5, f"text {i % 40}") for i in range(4000)] + [(i, "x") for i in range(6, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    rows = common.first_rows(common.labelled_sample(docs, labels, "toxic", 30), 30).collect()
    assert len(rows) <= 30 and len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    many = common.first_rows(common.labelled_sample(docs, labels, "toxic", 1000), 1000).collect()
    assert sum(r["doc_id"] == 5 for r in many) in (0, 40)


def test_hub_of_links(spark):
    """A node with very many links, a chain, and links given twice and in both directions."""
    links = [(0, i) for i in range(1, 2000)] + [(i, i + 1) for i in range(3000, 3040)] + [(5001, 5000), (5000, 5001), (7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(2000)} | {i: 3000 for i in range(3000, 3041)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_family_in_blocks_of_sets(spark):
    rng, rows = np.random.default_rng(6), []
    base = [f"w{x}" for x in range(60)]
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for blocks in (1, 7, 400):
        got = [tuple(r) for r in jaccard.similar_components(docs, 3, 90, block_sets=blocks).collect()]
        assert sorted(got) == sorted(brute_components(rows, 3, 90))


def test_scratch_of_one_application(spark):
    path = common.scratch_dir(spark)
    df = common.written(spark.range(5), "some")
    assert df.count() == 5 and path in df.inputFiles()[0]
