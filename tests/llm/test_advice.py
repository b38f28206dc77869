"""Planted tables for the review's findings: each would fail with the cut that the review named."""

import numpy as np
import pytest

from synthscore.llm import line_frequency, mixing, toxicity

from ..conftest import SF_CHECK


def test_lines_that_spread_or_hide_in_a_large_host(spark):
    """One line in 120 documents of 40 hosts (3 each), one in 3 % of a host with 1000 documents."""
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    spread, hidden = own("s", 60), own("h", 60)
    rows = [(i, f"{spread}\n{own(i, 10)}", f"h{i % 40}") for i in range(120)]
    rows += [(i, f"{hidden}\n{own(i, 10)}" if i < 1030 else own(i, 70), "large") for i in range(1000, 2000)]
    rows += [(i, own(i, 70), f"h{i % 40}") for i in range(2000, 2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = lambda d, **limits: {r["doc_id"] for r in line_frequency.judge_documents(d, **limits).collect() if not r["kept"]}
    none = 10**9
    assert gone(docs, corpus_limit=none) == set(range(1000, 1030))
    assert gone(docs, host_limit=none) == set(range(120))
    assert gone(docs) == set(range(120)) | set(range(1000, 1030))  # the registered limits
    assert gone(docs, host_limit=none, corpus_limit=121) == set()
    copies = spark.createDataFrame([(i % 60, f"{spread}\n{own(i % 60, 10)}", f"h{i}") for i in range(120)], docs.schema)
    assert all(r["kept"] for r in line_frequency.judge_documents(copies).collect())  # 60 documents, each in two hosts


@pytest.mark.parametrize("sf_dir", [SF_CHECK, "/root/testdata/sf0.1"])
def test_lines_decide_in_the_real_table(spark, sf_dir):
    """Documents that pass the base rule are rejected by their lines, few of them, each with under three quarters left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = line_frequency.judge_documents(docs).collect()
    lost = [r for r in rows if not r["base_failed"] and not r["kept"]]
    assert 0 < len(lost) < 0.02 * len(rows)
    assert all(r["left_share"] < 0.75 for r in lost)
    assert all(r["left_share"] >= 0.75 for r in rows if r["kept"])


def test_toxicity_fit_learns_a_pair_without_signs_of_its_own():
    """Both of two terms or neither is toxic, each term alone says nothing: fit itself finds the pair."""
    rng = np.random.default_rng(1)
    x = np.repeat([[0, 0], [0, 1], [1, 0], [1, 1]], 200, axis=0)
    docs = [np.unique(np.array([10 + i for i in range(2) if r[i]] + [100, *rng.integers(200, 260, 6)], np.uint32)) for r in x]
    y = (x[:, 0] == x[:, 1]).astype(float)
    fit = toxicity.fit(docs, y)
    assert {10, 11, 100} <= set(fit.terms)
    row, col = fit.cells(docs)
    assert ((fit.score(row, col, len(docs)) > 0.5) == (y > 0)).mean() > 0.99
    clean = [np.array(t, np.uint32) for t in ([100], [10, 100], [11, 100], [10, 11, 100])]  # no filler words to learn by heart
    row, col = fit.cells(clean)
    assert list(fit.score(row, col, 4) > 0.5) == [True, False, False, True]


def test_mixing_by_copies_with_one_domain_over_95_percent(spark):
    """The shares hold for the copies that are returned, not only for rates that are raised to 1 later."""
    rng, targets = np.random.default_rng(2), {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
    langs = ["en"] * 1920 + ["de"] * 32 + ["es"] * 24 + ["fr"] * 24
    rows = [(i, " ".join(f"{d}{x}" if x < 60 else f"all{x}" for x in rng.integers(0, 90, 40)), d) for i, d in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.selectExpr("doc_id", "lang as domain")
    out, report = mixing.fit_mix(docs, labelled, targets)
    rows = out.collect()
    assert report["converged"] and min(r["copies"] for r in rows) == 1 and min(r["rate"] for r in rows) >= 1
    reached = {d: sum(r["copies"] * r["rows"] * r["tokens"] * r[f"p_{d}"] for r in rows) for d in targets}
    assert all(abs(reached[d] / sum(reached.values()) - w) < 0.002 for d, w in targets.items())
    half, report = mixing.fit_mix(docs, labelled, targets, total_tokens=60_000, keep_all=False)
    assert report["converged"] and abs(sum(report["reached"]) - 60_000) < 100
    with pytest.warns(RuntimeWarning, match="not mixed"):  # fewer tokens than the documents have, which all stay
        mixing.mix(docs, labelled, targets, total_tokens=60_000)


def test_toxicity_at_a_useful_cut(spark):
    """Held-out labelled rows of the larger table: most toxic ones pass 0.7, clean ones do not; no term is capped."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = labels.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "toxic")
    scores = {r["doc_id"]: r for r in toxicity.score_documents(known, model).collect() if r["held_out"]}
    truth = {r["doc_id"]: r["toxic"] for r in known.select("doc_id", "toxic").collect() if r["doc_id"] in scores}
    toxic = [scores[i]["predicted"] for i, y in truth.items() if y == 1]
    clean = [scores[i]["predicted"] for i, y in truth.items() if y == 0]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.005
    assert len(model.terms) > 2048


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    a, c = toxicity.calibration(z, y)
    assert abs(a - 0.5) < 0.05 and abs(c - 1) < 0.1
