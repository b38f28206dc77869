"""Every operator and every stage: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from synthscore.llm import (jaccard, licenses, line_dedup, line_frequency, mixing, packing, quality, topk, toxicity, url_rules)
from synthscore.llm.queries import tokenizer_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, key long, n long, label int, "
          "rank int, batch int, hash binary, host string, copies int, part int, role int, depth int, start long, piece int")
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
LINE = "a line that several documents hold"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "the quick brown fox jumps over the lazy dog and runs away"),
    (2, "the quick brown fox jumps over the lazy dog and runs away"), (3, None), (4, ""), (5, "   \n\t"), (6, LONG), (7, LONG + " end"),
    (None, f"no id here\n{LINE}"), (8, f"{LINE}\nother words\n {LINE.upper()}\t"), (9, f"{LINE}\n\nshort\nshort"), (10, "one"), (11, "one"),
    (12, "Licensed under the Apache License, Version 2.0."), (None, None), (13, "é Ä ß ñ \u2003 x\u0000y <|endoftext|> 漢字"), (14, "-3.5e10 %%% $$$ !!!"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 9 else "s", len(t or ""), 0.5, 1, 2, 1, 1, 1, b"x", "h", 3, 0, 1, 1, 0, 0)
                                  for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 4 else (i + 1) % 2, "extra") for i in range(15)] + [(None, 1, 1, "x"), (1, 1, 0, "again")],
                                 "doc_id long, quality int, toxic int, text string")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


WANT = sorted((i is None, i or 0) for i, _ in TEXTS)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores(spark, docs, none, labels, module, label):
    for training in (labels, labels.limit(0)):
        model = module.train(docs, training, label)
        rows = module.score_documents(docs, model).collect()
        assert ids(rows) == WANT and all(0 <= r["score"] <= 1 for r in rows)
        same = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
        assert len(same) == 1 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert module.score_documents(none, module.train(none, labels, label)).collect() == []


def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer_path(), size=64, keep_ids=True).collect()
    place = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 64 and r["ids_crc32"] >= 0
        for at in range(r["offset"], r["offset"] + r["length"]):
            assert place.setdefault((r["sequence_id"], at), r) is r and at < 64
    by = {}
    for (s, at) in place:
        by.setdefault(s, []).append(at)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    encode = packing.encoder(tokenizer_path())
    ends = [r for r in rows if r["ids"][-1] == 0]
    assert ids(ends) == WANT  # one end per row
    assert sum(r["length"] for r in rows) == sum(len(encode(t or "")) + 1 for _, t in TEXTS)
    assert len(by) <= 1.02 * sum(r["length"] for r in rows) / 64 + 2
    assert packing.pack(none, tokenizer_path()).collect() == []


def brute_components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * len(sets[a] | sets[b]):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    out = []
    for k, (i, _) in enumerate(rows):
        near = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(near) if near else None))
    return out


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (2, 100)])
def test_jaccard(docs, none, size, percent):
    rows = [tuple(r) for r in jaccard.similar_components(docs, size, percent).collect()]
    assert sorted(rows, key=repr) == sorted(brute_components(TEXTS, size, percent), key=repr)
    assert jaccard.similar_components(none, size, percent).collect() == []


def test_licenses(spark, docs, none):
    rows = licenses.scan(docs, licenses.templates(spark)).collect()
    assert ids(rows) == WANT
    hit = {r["doc_id"]: r for r in rows if r["n_base"]}
    assert set(hit) == {12} and (hit[12]["first_word"], hit[12]["base_labels"], hit[12]["score"]) == (3, "apache", 1.0)
    empty = [r for r in rows if r["doc_id"] == 3][0]
    assert (empty["n_words"], empty["first_word"], empty["labels"], empty["score"]) == (0, None, "", 0.0)
    assert licenses.scan(none, licenses.templates(spark)).collect() == []


def test_mixing(spark, docs, none):
    labelled = spark.createDataFrame([(i, "a" if i % 2 else "b", 1) for i in range(15)] + [(None, "a", 2), (1, None, 3)], "doc_id long, domain string, tokens int")
    mixed = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5})
    rows = mixed.collect()
    assert sum(r["rows"] for r in rows) == len(TEXTS) and all(r["rate"] >= 0 and r["copies"] >= 1 for r in rows)
    assert all(abs(r["p_a"] + r["p_b"] - 1) < 1e-9 for r in rows)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] * r["rows"] for r in rows)
    assert mixing.mix(none, labelled, {"a": 0.5, "b": 0.5}).collect() == []


def test_line_frequency(docs, none):
    rows = line_frequency.judge_documents(docs, host_limit=2).collect()
    assert ids(rows) == WANT
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert (got[9]["n_dup_lines"], got[9]["n_words"], got[14]["n_symbols"]) == (1, 8, 6)
    assert line_frequency.judge_documents(none).collect() == []


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    last, owner = 2**63 - 1, {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            owner[key(x)] = min(owner.get(key(x), last), last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (3, 2), (5, 3)])
def test_line_dedup(docs, none, batches, fanout):
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert set(docs.columns) < set(out.columns)
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(rows, key=repr) == brute_lines(TEXTS)
    assert line_dedup.dedup_lines(none, batches=batches).collect() == []


def test_topk(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0, -0.5]), (0, [1.0, 0.0, -0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, []), (None, [1.0]), (20, [0.5, 0.5, 0.5])]
    v = spark.createDataFrame([(i, x, "s", 1, 2) for i, x in rows], "vec_id long, embedding array<double>, v string, n int, h int")
    v = v.select("vec_id", topk.quantised(F.col("embedding")).alias("v"), "n", "h")
    got = [tuple(r) for r in topk.top_k(v, F.col("vec_id") % 20 == 0, k=3, query_block=1, cand_block=2).collect()]
    assert sorted(got) == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 1024), (20, 1, 1, 2048), (20, 2, 2, 2048), (20, 3, 0, 1024)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_url_rules(spark):
    rules = url_rules.rule_table(spark, [("allow", "com", "/"), ("block", "a.com", "/x"), ("allow", "a.com", "/x/y"), ("block", "a.com", "/x/y"),
                                         ("allow", "b.a.com", "/x/y/z"), ("block", "net", "")])
    urls = [(1, "http://a.com/x/y/z?q"), (1, "http://a.com/x/y/z?q"), (2, "s://B.A.com/x/y/zz#f"), (3, "http://a.com"), (4, None), (5, "a.com/x"),
            (6, "http://xa.com/x"), (7, "http://q.net?x"), (8, "http://nets/x"), (None, "http://a.com/xx"), (9, "://"), (10, "http://.com/"), (11, "u://a.com./x")]
    pages = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in urls], "page_id long, url string, host string, key string, part int")
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in url_rules.judge_urls(pages, rules, partitions=3).collect()), key=repr)
    want = [(1, "a.com", "/x/y/z", "a.com/x/y", "block"), (1, "a.com", "/x/y/z", "a.com/x/y", "block"), (2, "b.a.com", "/x/y/zz", "b.a.com/x/y/z", "allow"),
            (3, "a.com", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "xa.com", "/x", "com/", "allow"),
            (7, "q.net", "", "net", "block"), (8, "nets", "/x", None, "allow"), (None, "a.com", "/xx", "a.com/x", "block"), (9, "", "", None, "allow"),
            (10, ".com", "/", "com/", "allow"), (11, "a.com.", "/x", None, "allow")]
    assert got == sorted(want, key=repr)
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, tmp_path, empty):
    (none if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none if empty else docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert empty == (out.count() == 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[-2:] == ["sequence_id", "offset"]
