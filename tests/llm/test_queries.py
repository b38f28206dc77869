"""Registered queries over whole tables: against their SQL, brute force, or held-out accuracy."""

import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from synthscore.llm import jaccard, licenses, line_dedup, packing, queries, toxicity

from ..conftest import SF_CHECK, SF_SMALL
from .test_edges import brute_components


def key(rows):
    return sorted((tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    want = c.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert key(map(tuple, df.select(*cols).collect())) == key(want)


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name, label, recall", [("op1_toxicity_fm", "toxic", 0.4), ("op8_quality_gbdt", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, recall):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF_CHECK).collect()}
    truth = duckdb.sql(f"select doc_id, {label} from '{SF_CHECK}/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    own = [(rows[i]["predicted"], y) for i, y in truth if rows[i]["held_out"]]
    assert np.mean([p for p, y in own if y]) >= recall
    assert np.mean([p for p, y in own if not y]) <= 0.05


def test_toxicity_learns_pairs():
    """Two terms that are toxic only together: no sum of single weights separates them."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (800, 2))
    docs = [np.array([10 + i for i in range(2) if r[i]] + [100], np.uint32) for r in x]
    y = (x[:, 0] ^ x[:, 1] ^ 1).astype(float)  # both or neither
    fm = toxicity.FactorizationMachine(np.array([10, 11], np.uint32), 2.0, np.array([-4.0, -4.0]), np.array([[3.0], [3.0]]))
    row, col = fm.cells(docs)
    assert ((fm.score(row, col, len(docs)) > 0.5) == (y > 0)).all()
    y = (x[:, 0] & x[:, 1]).astype(float)
    fit = toxicity.fit(docs, y, steps=400)
    row, col = fit.cells(docs)
    assert ((fit.score(row, col, len(docs)) > 0.5) == (y > 0)).all()


def test_packing_whole_table(spark, texts):
    rows = queries.op3_pattern_packing(spark, SF_SMALL).collect()
    encode = packing.encoder(queries.tokenizer_path())
    want = []
    for i, t in texts:
        all_ids = np.array([*encode(t or ""), 0], "<u4")
        want += [(i, k, at, n, zlib.crc32(all_ids[at:at + n].tobytes())) for k, (at, n) in enumerate(packing.piece_bounds(len(all_ids), 2048))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 2048 and len(end) <= 1.02 * sum(end.values()) / 2048 + 1


def test_tokenizer_ids(texts):
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(queries.tokenizer_path()), packing.encoder(queries.tokenizer_path())
    for _, t in [*texts, (0, "a <|endoftext|> b"), (0, " \n  \t x")]:
        assert list(encode(t or "")) == own.encode(t or "", add_special_tokens=False).ids


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 5000), np.minimum(2048, rng.lognormal(5.5, 1.2, 20000).astype(int) + 1), np.full(999, 700), np.array([1])):
        counts = dict(zip(*np.unique(lengths, return_counts=True)))
        packing_plan = packing.plan({int(k): int(v) for k, v in counts.items()}, 2048)
        used = {}
        for group, r in packing_plan:
            assert sum(group) <= 2048
            for n in group:
                used[n] = used.get(n, 0) + r
        assert used == counts
    assert sum(r for _, r in packing.plan({700: 999}, 2048)) == 500


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_whole_table(spark, texts, size, percent):
    docs = queries.table(spark, SF_SMALL, "documents")
    rows = [tuple(r) for r in jaccard.similar_components(docs, size, percent).collect()]
    assert sorted(rows) == sorted(brute_components(texts, size, percent))


def test_jaccard_edited_copies(spark):
    """Chains of edits around the limit, of short and long texts, in one bucket family and in small blocks."""
    rng, rows = np.random.default_rng(5), []
    for base in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 12 + 40 * base)]
        for _ in range(25):
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"w{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 90), (1, 80), (2, 60)):
        got = [tuple(r) for r in jaccard.similar_components(docs, size, percent, block_items=300).collect()]
        assert sorted(got) == sorted(brute_components(rows, size, percent))


def test_license_places(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = {r["doc_id"]: r for r in queries.op5_license_scan(spark, SF_SMALL).collect()}
    for i, t in texts:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [k for _, p in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_license_edited_notice(spark):
    """A notice with a word put in, one left out: neighbouring diagonals merge; scattered words do not."""
    notice = licenses.NOTICES[3][1].split()
    edited = " ".join(notice[:5] + ["hereby"] + notice[5:10] + notice[11:])
    rows = spark.createDataFrame([(1, f"x y z {edited} tail"), (2, " filler ".join(notice))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(rows, licenses.templates(spark)).collect()}
    assert (got[1]["labels"], got[1]["base_labels"], got[2]["labels"]) == ("mit", "", "")
    assert 0.7 <= got[1]["score"] < 1


def test_mixing_reaches_targets(spark):
    rows = [r for r in queries.op6_source_mixing(spark, SF_CHECK).collect()]
    reached = {d: sum(r["tokens"] * r["rate"] * r[f"p_{d}"] for r in rows) for d in queries.MIX_TARGETS}
    total = sum(reached.values())
    assert all(abs(reached[d] / total - w) < 0.01 for d, w in queries.MIX_TARGETS.items())
    copied = sum(r["copies"] * r["tokens"] for r in rows)
    assert abs(copied / total - 1) < 0.05 and min(r["copies"] for r in rows) == 1


def test_pipeline_equals_stages(spark):
    """run() is the stages one after the other; each keeps and changes what it says."""
    docs = queries.table(spark, SF_SMALL, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    quality, dedup, near, mixed, packed = [f for _, f in corpus_pipeline.STAGES]
    from synthscore.llm.common import written

    kept = written(quality(spark, docs, SF_SMALL), "t")
    assert all(before[r["doc_id"]] == r for r in kept.collect()) and kept.count() > 0.7 * len(before)
    lines = written(dedup(spark, kept, SF_SMALL), "t")
    assert all(r["n_chars"] == len(r["text"]) and r["text"].split() for r in lines.collect())  # no blank document goes on
    whole = line_dedup.dedup_lines(kept).collect()
    assert {r["doc_id"] for r in lines.collect()} == {r["doc_id"] for r in whole if re.search(r"[^\x20\x09-\x0D]", r["text"])}
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    left = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    one = written(near(spark, lines, SF_SMALL), "t")
    assert {r["doc_id"] for r in one.collect()} == left
    more = written(mixed(spark, one, SF_SMALL), "t")
    assert {r["doc_id"] for r in more.collect()} == left
    pieces = packed(spark, more, SF_SMALL).collect()
    assert min(r["length"] for r in pieces if r["start"] == 0) > 1  # a document of one token would be a blank one
    n = sum(r["length"] for r in pieces)
    assert n == sum(r["length"] for r in corpus_pipeline.run(spark, SF_SMALL).collect())
