"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the template positions that hold
the same k-gram.  A hit at word p of a document and word t of a template votes for the diagonal
p - t; a copy of the template gathers its votes on one diagonal, an edited copy on neighbouring
ones.  Votes are aggregated by diagonal and near diagonals are merged.  Stray k-grams can stretch a
merged cluster over half a document, so its spans are verified window by window: the score is the
best share of the template's k-grams that stand, in their order, in a window of bounded length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, rolling

#: Exact phrases and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

#: Wording of public licence notices, found also when edited.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

# words: letters, digits and non-ASCII characters after A-Z are lower-cased
_TO_SPACE = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
K = 2
_CHUNK = 65_536


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()  # bytes.lower() is A-Z only


def templates(spark: SparkSession, phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> DataFrame:
    """(gram, template, label, exact, n_grams, t): every k-gram of every template with its position;
    a fixed list, so broadcasting it is bounded.  Template -1 is met by one mark that every document has."""
    hashes, rows = WordHashes(), [(0, -1, "", False, 1, 0)]
    for i, (label, phrase, exact) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in notices]):
        grams = rolling(hashes.of(words(phrase)), K).view(np.int64)
        rows += [(int(g), i, label, exact, len(grams), t) for t, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, exact boolean, n_grams int, t int")


def gram_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, start, grams): rolling k-gram hashes in chunks, after one mark
    row (gram 0 at start -1) per document."""
    def grams(batches):
        hashes = WordHashes()
        for b in batches:
            ids, th = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            out: list[tuple] = []
            for i, h, text in zip(ids, th, b.column("text").to_pylist()):
                w = words(text)
                g = rolling(hashes.of(w), K).view(np.int64)
                out.append((i, h, len(w), -1, np.zeros(1, np.int64)))
                out += [(i, h, len(w), at, g[at:at + _CHUNK]) for at in range(0, len(g), _CHUNK)]
            sizes = [len(r[4]) for r in out]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                             pa.array(np.concatenate([r[4] for r in out] or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in out], pa.int64()) for k in range(4)], lists],
                                             ["doc_id", "text_hash", "n_words", "start", "grams"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(grams, "doc_id long, text_hash long, n_words long, start long, grams array<long>")


def best_window(hits: list[tuple[int, int]], width: int) -> int:
    """Most template positions that rise strictly with the words of a window of ``width`` words.
    ``hits``: (word, template position)."""
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))  # of one word only one position counts
    best, hi = 0, 0
    for lo in range(len(hits)):
        if lo and hits[lo][0] == hits[lo - 1][0]:
            continue  # a window that begins at the same word
        while hi < len(hits) and hits[hi][0] < hits[lo][0] + width:
            hi += 1
        if hi - lo <= best:
            continue
        tails: list[int] = []
        for _, t in hits[lo:hi]:
            at = bisect_left(tails, t)
            tails[at:at + 1] = [t]
        best = max(best, len(tails))
    return best


def _with_share(spans: DataFrame, max_stretch: float) -> DataFrame:
    """``share`` of the template's k-grams that a cluster of hits holds: all on one diagonal for an exact
    phrase, in the best window for a notice."""
    kept = [c for c in spans.columns if c != "hits"]

    def judged(batches):
        for b in batches:
            share = []
            for hits, n, template, exact in zip(*(b.column(c).to_pylist() for c in ("hits", "n_grams", "template", "exact"))):
                if template < 0:
                    share.append(0.0)
                elif exact or len(hits) == 1:
                    share.append(len(hits) / n)
                else:
                    share.append(best_window([(h["p"], h["t"]) for h in hits], int(max_stretch * (n + K - 1)) - K + 1) / n)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(share, pa.float64())], [*kept, "share"])
    return spans.mapInArrow(judged, ", ".join(f"`{n}` {t}" for n, t in spans.select(*kept).dtypes) + ", share double")


def scan(docs: DataFrame, rules: DataFrame, gap: int = 3, min_cover: float = 0.7, max_stretch: float = 1.5) -> DataFrame:
    """Licence labels per document.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per
    input row.  An exact phrase counts at every diagonal that holds all of its k-grams.  A notice
    is found where a cluster of diagonals at most ``gap`` apart holds ``min_cover`` of its k-grams, in
    their order, within ``max_stretch`` times its length; other hits of the cluster do not matter.
    ``score`` is the largest such share, found or not: 1 for a whole phrase or notice.  Null and empty
    texts have no words and no labels; a null doc_id is passed on; repeated rows stay.  Texts of any
    length are scanned whole; an empty table gives an empty result; columns other than doc_id and text
    are ignored.
    """
    doc, template = ["doc_id", "text_hash"], ["template", "label", "exact", "n_grams"]
    hits = (gram_rows(docs).select(*doc, "n_words", "start", F.posexplode("grams").alias("i", "gram"))
            .join(F.broadcast(rules), "gram")
            .select(*doc, "n_words", *template, "t", (F.col("start") + F.col("i")).alias("p")))
    votes = (hits.withColumn("diagonal", F.col("p") - F.col("t"))
             .groupBy(*doc, *template, "diagonal")
             .agg(F.max("n_words").alias("n_words"), F.count("*").alias("votes"), F.collect_set("t").alias("held"),
                  F.min("p").alias("p0"), F.max("p").alias("p1")))
    # diagonals of one document and template in order; a wide step begins a new cluster
    by = W.partitionBy(*doc, "template").orderBy("diagonal")
    votes = votes.withColumn("step", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= gap, 0).otherwise(1))
    votes = votes.withColumn("cluster", F.when(F.col("exact"), F.col("diagonal")).otherwise(F.sum("step").over(by)))
    spans = (votes.groupBy(*doc, *template, "cluster")
             .agg(F.max("n_words").alias("n_words"), F.sum("votes").alias("votes"), F.min("p0").alias("p0"),
                  F.flatten(F.collect_list(F.transform("held", lambda t: F.struct((F.col("diagonal") + t).alias("p"), t.alias("t"))))).alias("hits")))
    spans = _with_share(spans, max_stretch)
    spans = spans.withColumn("base", F.col("exact") & (F.col("template") >= 0) & (F.col("share") == 1))
    found = F.col("base") | (~F.col("exact") & (F.col("template") >= 0) & (F.col("share") >= min_cover))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"), F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("p0"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("p0"))).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(found).alias("labels"),
        F.least(F.lit(1.0), F.max("share")).alias("score"),
        F.max(F.when(F.col("template") == -1, F.col("votes"))).alias("copies"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                      F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
