"""Periodic runs: the grammar search against a scan of every period, edge cases, the registered query."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from synthscore.llm import periodic, queries

from ..conftest import SF_SMALL
from .test_edges import LONG, TEXTS, WANT, docs, frame, ids, none  # noqa: F401


def brute_runs(w, least=12):
    """(start, length, smallest period): for every period the longest stretches of equal words that far apart."""
    names = {}
    x = np.array([names.setdefault(v, len(names)) for v in w], np.int64)
    out = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= max(least - q, q):
                out.setdefault((int(s), int(e - s) + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def laid_out(texts):
    size = [len(w) for w in texts]
    words = np.array([x for w in texts for x in w], np.int64)
    s, e, q = periodic.runs_of(words, np.repeat(np.arange(len(texts)), size))
    base = np.cumsum([0, *size])
    d = np.searchsorted(base, s, side="right") - 1
    return [sorted(zip((s - base[d])[d == k].tolist(), (e - s)[d == k].tolist(), q[d == k].tolist())) for k in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_grammar_search_equals_scan(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(1, 150), rng.choice([1, 2, 2, 3, 5, 40])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6:  # a periodic tail, some of it broken
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                for _ in range(rng.choice([0, 0, 1, 3])):
                    w[rng.randrange(n)] = rng.randrange(k)
            texts.append(w)
        assert laid_out(texts) == [brute_runs(w) for w in texts]


def test_words_with_many_runs():
    fib, prev = [0, 1], [0]
    while len(fib) < 900:
        fib, prev = fib + prev, fib
    thue = [bin(i).count("1") % 2 for i in range(1024)]  # squares, but nothing longer; polynomial sums mod 2^64 would mix its halves up
    nested = ([1, 2] * 8 + [3]) * 9 + [4] + [5] * 40
    texts = [fib[:900], thue, nested, [7] * 700, list(range(300)) * 2, list(range(300)) * 2 + [0]]
    got = laid_out(texts)
    assert got == [brute_runs(w) for w in texts]
    assert {n / q for _, n, q in got[1]} == {2.0} and got[3] == [(0, 700, 1)] and got[4] == [(0, 600, 300)] and got[5] == [(0, 601, 300)]


def test_grammar_places():
    """Every boundary belongs to one place, places of a symbol derive the same words, repeats share symbols."""
    w = [1, 2, 3, 4] * 32 + list(range(10, 30))
    doc = np.repeat([0, 1], [len(w), len(w)])
    terminal = np.r_[w, np.array(w) + 100]
    g = periodic.Grammar(terminal, doc)
    assert sorted(g.mid) == [i for i in range(1, 2 * len(w)) if i != len(w)]
    by = {}
    for s, a, m, e in zip(g.symbol, g.start, g.mid, g.end):
        assert a < m < e and by.setdefault(s, tuple(terminal[a:e])) == tuple(terminal[a:e])
    assert len(set(g.symbol[g.start < 128])) < 40


def test_edges(docs, none):  # noqa: F811
    rows = periodic.periodic_runs(docs, chunk_words=50).collect()
    assert ids(rows) == WANT
    for r in rows:
        words = [t for i, t in TEXTS if i == r["doc_id"]][0] or ""
        words = words.encode().split()
        if r["doc_id"] is None and not r["n_words"]:
            words = []
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            runs = brute_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs
            assert r["collapsed"] == b" ".join(collapsed(words, runs)).decode()
    long = {r["doc_id"]: r for r in rows}[6]  # 60,000 words of period 5000
    assert [tuple(x) for x in long["runs"]] == [(0, 60_000, 5000)] and long["collapsed"] == " ".join(LONG.split()[:5000])
    assert periodic.periodic_runs(none).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_words=3)


def test_query(spark):
    """The registered query over the whole table, each column worked out anew."""
    found = {r["doc_id"]: r.asDict() for r in queries.op11_periodic_runs(spark, SF_SMALL).collect()}
    texts = duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()
    assert len(found) == len(texts)
    planted = 0
    for i, t in texts:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert found[i] == {
            "doc_id": i, "n_runs": len(runs), "start": s, "length": n, "period": q, "exponent_milli": 1000 * n // q if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()}
    assert planted > 5 and any(r["n_runs"] > 1 for r in found.values())
