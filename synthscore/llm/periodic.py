"""Periodic runs of words, found through a grammar of every document.

A document's word ids are compressed by Re-Pair, in parallel rounds: a round replaces every repeated
pair of neighbouring symbols wherever it is more frequent than the pairs that overlap it there.  What
no longer repeats is paired level by level up to one root.  Every boundary between two words thus
belongs to one nonterminal, and a run lies inside the lowest node that spans it and crosses that
node's boundary.  Runs across a boundary are searched once per nonterminal, at its first place: a run
of 12 words or more has three words next to the boundary that stand again one period further.  They
are moved to all places that derive the nonterminal, and intervals inside a longer one of the same
period are merged into it.  All comparisons use exact names of word sequences, no hashes.

The documents of a chunk are worked on together as numpy arrays; symbols belong to one document.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 12
RUN = "struct<start:long,length:long,period:long>"
_HALF = np.int64(32)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs (a, b) from 0, and how often each code comes."""
    codes = pd.factorize(a.astype(np.int64) << _HALF | b)[0]
    return codes, np.bincount(codes) if len(codes) else np.empty(0, np.int64)


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places whose pair has a higher rank than the overlapping pairs; every other place of a
    stretch of one pair (a a a a)."""
    at = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
    v = rank[at]
    top = (v >= 0) & (v > np.r_[-1, v[:-1]]) & (v > np.r_[v[1:], -1])
    size = np.diff(np.r_[at, len(rank)])[top] + 1 >> 1
    return np.repeat(at[top], size) + 2 * (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


class Grammar:
    """Nonterminals of all documents of a chunk: ``symbol``, ``start``, ``mid``, ``end`` of every
    place (mid: the boundary between its two parts); places of one symbol derive the same words."""

    def __init__(self, terminal: np.ndarray, doc: np.ndarray):
        self.symbol, self.start, self.mid, self.end = ([np.empty(0, np.int64)] for _ in range(4))
        n = len(terminal)
        self._next = int(terminal.max(initial=-1)) + 1
        state = (terminal.astype(np.int64), doc, np.arange(n), np.arange(1, n + 1))
        self._halve(self._repair(state))
        self.symbol, self.start, self.mid, self.end = (np.concatenate(x) for x in (self.symbol, self.start, self.mid, self.end))

    def _replace(self, state, at: np.ndarray, named: np.ndarray):
        sym, doc, start, end = (x.copy() for x in state)
        sym[at], end[at] = named, end[at + 1]
        for to, x in ((self.symbol, named), (self.start, start[at]), (self.mid, start[at + 1]), (self.end, end[at])):
            to.append(x)
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], doc[keep], start[keep], end[keep]

    def _repair(self, state):
        """Replace repeated pairs until no document has one; what is left of the documents."""
        done, keys, names, rng = [], np.empty(0, np.int64), np.empty(0, np.int64), np.random.default_rng(1)
        while len(state[0]) > 1:
            sym, doc, *_ = state
            codes, count = _pairs(sym[:-1], sym[1:])  # symbols belong to one document: pairs across two never repeat
            # pairs of one count in random order: in the order of the text a chain of them would be replaced one by one
            rank = np.where(count > 1, count * len(count) + rng.permutation(len(count)), -1)[codes]
            live = np.zeros(int(doc[-1]) + 1, bool)
            live[doc[:-1][rank >= 0]] = True
            at = _chosen(rank)
            if len(at):
                own, first, code = np.unique(sym[at] << _HALF | sym[at + 1], return_index=True, return_inverse=True)
                k = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                old = keys[k] == own if len(keys) else np.zeros(len(own), bool)
                name = np.empty(len(own), np.int64)
                name[old] = names[k[old]]
                name[~old] = self._next + np.arange((~old).sum())
                self._next += int((~old).sum())
                keys, names = np.r_[keys, own[~old]], np.r_[names, name[~old]]
                order = np.argsort(keys)
                keys, names = keys[order], names[order]
                state = self._replace(state, at, name[code.ravel()])
            rest = live[state[1]]
            done.append(tuple(x[~rest] for x in state))
            state = tuple(x[rest] for x in state)
        done.append(state)
        left = [np.concatenate(x) for x in zip(*done)]
        order = np.argsort(left[1], kind="stable")
        return tuple(x[order] for x in left)

    def _halve(self, state):
        """Pair what is left, level by level, up to one root per document."""
        while len(state[0]) > 1:
            doc = state[1]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
            at = np.flatnonzero((place[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
            if not len(at):
                return
            named = self._next + np.arange(len(at))
            self._next += len(at)
            state = self._replace(state, at, named)


class Names:
    """Names of the word sequences of length 2^k that come at least twice in their document, and the
    longest common extensions of two places that follow from them."""

    def __init__(self, terminal: np.ndarray):
        n = len(terminal)
        count = np.bincount(terminal) if n else np.empty(0, np.int64)
        self.levels = [np.r_[np.where(count[terminal] > 1, terminal, -1), -1]]
        while True:
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            if half >= n:
                break
            high = self._joined(low, half)
            if high is None:
                break
            self.levels.append(high)

    @staticmethod
    def _joined(low: np.ndarray, by: int) -> np.ndarray | None:
        """Names of the sequences that two named ones, ``by`` words apart, cover."""
        at = np.flatnonzero((low[:-1 - by] >= 0) & (low[by:-1] >= 0))
        codes, count = _pairs(low[at], low[at + by])
        if not (count > 1).any():
            return None
        out = np.full(len(low), -1, np.int64)
        twice = count[codes] > 1
        out[at[twice]] = codes[twice]
        return out

    def triples(self) -> np.ndarray:
        """Names of three words: two pairs that overlap."""
        out = self._joined(self.levels[1], 1) if len(self.levels) > 1 else None
        return np.full(len(self.levels[0]), -1, np.int64) if out is None else out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i and j on (i < j)."""
        n, same = len(self.levels[0]) - 1, np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = self.levels[k][i + same], self.levels[k][np.minimum(j + same, n)]
            same += ((a >= 0) & (a == b)).astype(np.int64) << k
        return same

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before places i and j."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = i - same - (1 << k), j - same - (1 << k)
            a, b = self.levels[k][np.maximum(x, 0)], self.levels[k][np.maximum(y, 0)]
            same += ((x >= 0) & (a >= 0) & (a == b)).astype(np.int64) << k
        return same


def _boundary_runs(start, mid, end, names: Names, min_words: int, step: int = 1_000_000):
    """(node, start, end, period) of the runs across the nodes' boundaries, inside the nodes."""
    triple, n = names.triples(), len(names.levels[0])
    at = np.flatnonzero(triple >= 0)
    order = at[np.argsort(triple[at], kind="stable")]
    place = triple[order] * n + order  # ascending
    found = []
    for anchor in (mid, mid - 3):
        ok = (anchor >= start) & (anchor + 3 <= end)
        ok[ok] = triple[anchor[ok]] >= 0
        node = np.flatnonzero(ok)
        own = triple[anchor[node]] * n
        lo, hi = np.searchsorted(place, own + start[node]), np.searchsorted(place, own + end[node] - 2)
        many = hi - lo > 1  # the anchor itself is one
        node, lo, hi = node[many], lo[many], hi[many]
        cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(step, (hi - lo).sum() + step, step))
        for x, y in zip(np.r_[0, cuts[:-1] + 1] if len(cuts) else [], np.minimum(cuts + 1, len(node))):
            if y <= x:
                continue
            size = (hi - lo)[x:y]
            who = np.repeat(node[x:y], size)
            other = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[x:y], size)]
            a = anchor[who]
            who, other, a = (v[other != a] for v in (who, other, a))
            i, j = np.minimum(a, other), np.maximum(a, other)
            s, e, q = np.maximum(i - names.back(i, j), start[who]), np.minimum(j + names.ahead(i, j), end[who]), j - i
            keep = e - s >= np.maximum(min_words, 2 * q)
            found.append(np.stack([who, s, e, q])[:, keep])
    if not found:
        return np.empty((4, 0), np.int64)
    return _least_period(np.concatenate(found, axis=1))


def _least_period(r: np.ndarray) -> np.ndarray:
    """Of rows (group, start, end, period) with one interval those of the smallest period."""
    r = r[:, np.lexsort((r[3], r[2], r[1], r[0]))]
    return r[:, np.r_[True, (r[:3, 1:] != r[:3, :-1]).any(axis=0)]] if r.shape[1] else r


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that lie in no other of the same period, each with its smallest period."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    group = np.cumsum(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    reach = group * (int(e.max(initial=0)) + 1) + e
    far = np.maximum.accumulate(reach) if len(q) else reach
    keep = np.r_[True, (reach[1:] > far[:-1])] if len(q) else np.empty(0, bool)
    out = _least_period(np.stack([np.zeros(keep.sum(), np.int64), s[keep], e[keep], q[keep]]))
    return out[1], out[2], out[3]


def runs_of(words: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in documents laid end to end: ``words`` are word ids, ``doc``
    the ascending document number of every word.  Ordered by start, then period."""
    terminal = pd.factorize(doc.astype(np.int64) << _HALF | words)[0].astype(np.int64)
    g = Grammar(terminal, doc.astype(np.int64))
    long = g.end - g.start >= min_words
    symbol, start, mid, end = g.symbol[long], g.start[long], g.mid[long], g.end[long]
    order = np.argsort(symbol, kind="stable")
    symbol, start, mid, end = symbol[order], start[order], mid[order], end[order]
    first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(symbol) else np.empty(0, np.int64)
    node, s, e, q = _boundary_runs(start[first], mid[first], end[first], Names(terminal), min_words)
    size = np.diff(np.r_[first, len(symbol)])[node]  # all places of the node
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[node], size)
    move = start[place] - np.repeat(start[first[node]], size)
    s, e, q = _merged(np.repeat(s, size) + move, np.repeat(e, size) + move, np.repeat(q, size))
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


class _Ids(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _chunk(docs: list[list[bytes]], min_words: int):
    """Per document its runs (start, length, period as columns) and its words less the repeats."""
    ids = _Ids()
    size = np.array([len(w) if len(w) >= min_words else 0 for w in docs], np.int64)
    total = int(size.sum())
    words = np.fromiter(map(ids.__getitem__, chain.from_iterable(compress(docs, size))), np.int64, total)
    base = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(docs)), size)
    s, e, q = runs_of(words, doc, min_words)
    gone = np.cumsum(np.bincount(s + q, minlength=total + 1) - np.bincount(e, minlength=total + 1))[:total] > 0
    owner = doc[s] if len(s) else s
    at = np.searchsorted(owner, np.arange(len(docs) + 1))
    runs = (s - base[owner], e - s, q)
    kept = [w if at[d] == at[d + 1] else list(compress(w, ~gone[base[d]:base[d] + len(w)])) for d, w in enumerate(docs)]
    return at, runs, kept


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  min_words: int = MIN_WORDS, chunk_words: int = 300_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, ``runs`` (start, length, period; by start, then period)
    and ``collapsed``, the words joined by one space less those that repeat.

    A run is a stretch of words with smallest period q and at least max(min_words, 2 * q) words that
    no neighbouring word extends keeping period q.  A word goes if any run holds it after the run's
    first q words.  Words are separated by ASCII white space and compared exactly.  ``edit`` may
    change a document's words (UTF-8) before.  A null or blank text has no words, no runs and an
    empty ``collapsed``; a null doc_id is passed on; repeated rows are judged each on its own; an
    empty table gives an empty result.  Only doc_id and text are read, other columns are ignored.
    Whole texts are searched; a task holds about ``chunk_words`` words at a time, or one document.
    """
    if min_words < 6:
        raise ValueError("runs of fewer than 6 words need no grammar")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batches):
        for b in batches:
            todo, held = [], 0
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist())
            last = b.num_rows - 1
            for k, (i, text) in enumerate(rows):
                words = (text or b"").split()
                todo.append((i, edit(i, words) if edit and words else words))
                held += len(words)
                if held < chunk_words and k < last:
                    continue
                at, cols, kept = _chunk([w for _, w in todo], min_words)
                values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in todo], pa.int64()), pa.array([len(w) for _, w in todo], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), values),
                     pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])
                todo, held = [], 0

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(searched, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
