"""Bit-plane clustering: planes and distances against plain integers, rounds against brute force, edge cases."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthscore.llm import clusters

KIND = "vec_id long, embedding array<double>, v string, cluster int, words binary, label int"


@pytest.mark.parametrize("planes", [1, 5, 28])
def test_planes(planes):
    rng = np.random.default_rng(planes)
    v = rng.integers(-(1 << planes - 1), 1 << planes - 1, (50, 64))
    c = rng.integers(-(1 << planes - 1), 1 << planes - 1, (7, 64))
    words = clusters.pack(v, planes)
    assert (clusters.unpack(words) == v).all()
    which, far = clusters.nearest(words, clusters.pack(c, planes))
    want = ((v[:, None, :].astype(object) - c[None]) ** 2).sum(axis=2)
    assert (far == want.min(axis=1)).all() and (which == np.argmin(want.astype(float), axis=1)).all()


def brute(rows, k, rounds, seed):
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows
         if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [list(x) for _, x in sorted(v, key=key)[:k]]

    def assign():
        out = []
        for i, x in v:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cs]
            out.append((i, d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        a = assign()
        for c in range(len(cs)):
            own = [x for (_, x), r in zip(v, a) if r[1] == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own)]
    return assign(), cs


def test_rounds_and_edges(spark):
    rng = np.random.default_rng(7)
    inf, nan = float("inf"), float("nan")
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, None), (200, None), (201, [nan] * 64), (202, [inf] + [0.0] * 63),
             (203, [None] + [0.0] * 63), (204, [0.1] * 63), (205, []), (206, [0.0] * 64), (207, [0.0] * 64)]
    table = spark.createDataFrame([(i, e, "x", 1, b"y", 2) for i, e in rows], KIND).repartition(3)
    vectors = table.select("vec_id", clusters.quantised(F.col("embedding")).alias("v"), "cluster", "words")
    for k, rounds in ((6, 3), (500, 1)):  # more centroids than vectors: all start as one
        out, centres = clusters.cluster(vectors, k=k, rounds=rounds, seed=2)
        want, cs = brute(rows, k, rounds, 2)
        assert centres.tolist() == cs
        got = clusters.with_digest(out, centres).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cs[r["cluster"]])).encode()).hexdigest()
    out, centres = clusters.cluster(vectors.limit(0))
    assert len(centres) == 0 and clusters.with_digest(out, centres).collect() == []


@pytest.mark.parametrize("x, ok", [(500_000.0, True), (1e6, False), (1e300, False), (-524_288.0, False)])
def test_large_components(spark, x, ok):
    table = spark.createDataFrame([(1, [x] * 64), (2, [-0.5] * 64), (3, [0.1] * 64)], "vec_id long, embedding array<double>")
    vectors = table.select("vec_id", clusters.quantised(F.col("embedding")).alias("v"))
    if not ok:
        with pytest.raises(OverflowError):
            clusters.cluster(vectors, k=2)
        return
    out, centres = clusters.cluster(vectors, k=2, rounds=2)
    want, cs = brute([(1, [x] * 64), (2, [-0.5] * 64), (3, [0.1] * 64)], 2, 2, 2)
    assert centres.tolist() == cs and sorted(tuple(r) for r in out.collect()) == sorted(want)
