"""Licence scan: labels and score by brute force, stretched clusters, order of the words."""

import random

import pytest

from synthscore.llm import licenses


def brute(text, gap=3, min_cover=0.7, max_stretch=1.5):
    """(labels, score): every cluster of diagonals, every window, longest rising chain by dynamic programming."""
    w = [x.decode() for x in licenses.words(text)]
    labels, score = set(), 0.0
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        if any(w[i:i + len(p)] == p for i in range(len(w))):
            labels.add(label)
        for d in range(-len(p), len(w)):
            held = sum(0 <= d + t and w[d + t:d + t + 2] == p[t:t + 2] for t in range(len(p) - 1))
            score = max(score, held / (len(p) - 1))
    for label, phrase in licenses.NOTICES:
        p = [x.decode() for x in licenses.words(phrase)]
        n = len(p) - 1
        hits = sorted((i - t, i, t) for i in range(len(w) - 1) for t in range(n) if w[i:i + 2] == p[t:t + 2])
        clusters, last = [], None
        for d, i, t in hits:
            if last is None or d - last > gap:
                clusters.append([])
            clusters[-1].append((i, t))
            last = d
        for c in clusters:
            for lo, _ in c:
                chain = {}
                for i, t in sorted(x for x in c if lo <= x[0] and x[0] + 2 <= lo + int(max_stretch * len(p))):
                    chain[i, t] = 1 + max([v for (a, b), v in chain.items() if a < i and b < t], default=0)
                score = max(score, max(chain.values()) / n)
                if max(chain.values()) / n >= min_cover:
                    labels.add(label)
    return ",".join(sorted(labels)), min(1.0, score)


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(docs, licenses.templates(spark)).collect()}


def test_brute_force(spark):
    rng = random.Random(1)
    vocab = sorted({x.decode() for _, p in licenses.NOTICES + licenses.PHRASES for x in licenses.words(p)})
    texts = [licenses.NOTICES[0][1].upper(), licenses.NOTICES[1][1]]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(licenses.NOTICES + licenses.PHRASES)[1].split()
            if rng.random() < 0.7:  # edited: words lost, doubled, put in
                p = [y for x in p for y in rng.choice([[x], [x], [x], [x], [], [x, x], [x, rng.choice(vocab)]])]
            if rng.random() < 0.2:
                rng.shuffle(p)
            parts += p + [rng.choice(vocab) for _ in range(rng.choice([0, 3, 30]))]
        texts.append(" ".join(parts))
    got = scan(spark, texts)
    want = {i: brute(t) for i, t in enumerate(texts)}
    assert {i: (a, round(b, 9)) for i, (a, b) in want.items()} == got
    assert len({a for a, _ in want.values()}) > 8


def test_stretched_cluster_keeps_its_notice(spark):
    notice = licenses.NOTICES[1][1]
    got = scan(spark, [notice, notice + " the license x" * 5, "the license x " * 40 + notice + " the license x" * 40, " ".join(reversed(notice.split()))])
    assert got[0] == got[1] == got[2] == ("apache", 1.0)
    assert got[3][0] == "" and got[3][1] < 0.3  # the same words in another order


@pytest.mark.parametrize("hits, width, want", [([], 5, 0), ([(0, 0)], 1, 1), ([(0, 0), (0, 1), (1, 1)], 9, 2), ([(0, 2), (1, 1), (2, 0)], 9, 1),
                                                ([(0, 0), (9, 1)], 9, 1), ([(0, 0), (9, 1)], 10, 2)])
def test_best_window(hits, width, want):
    assert licenses.best_window(hits, width) == want
