"""N-gram Jaccard self-join by universe partitioning and pigeonhole, with components.

Sets of word shingles fall into size bands.  In a band, two sets as similar as asked differ in at
most H shingles, so of H + 1 segments of the hashed universe at least one holds the same shingles
in both.  A set's segment subsets are indexed by hash.  The band has some segments more than H + 1,
so that a set can leave out empty and small segments, which many sets share: the allocation gives 1
to its H + 1 largest segments and 0 to the others.  A set with too few segments in use gives 2 to as
many as it needs, which then also match at distance one, through the subset's one-deletion
neighbourhood; where even this is not enough it falls back on its empty segments.

Sets that meet in a bucket are candidates.  Each bucket first compares its members with its smallest
one; members of buckets that are not yet connected are then compared across components, in blocks.  Every comparison is exact, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, mixed, rolling, written
from .components import connected_components

_SALT, _SEG = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)
INDEX, PROBE = 1, 2  # low bits of a key: what the set does with it


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; with fewer words the whole
    sequence is one.  A-Z are lower-cased, words are separated by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    return np.unique(rolling(hashes.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bands:
    """Size bands: least and largest size, most differing shingles H, number of segments."""

    def __init__(self, percent: int, ratio: float = 1.25, most: int = 2**40):
        self.percent, self.low, self.high, self.diff, self.segments = percent, [], [], [], []
        low = 1
        while low <= most and percent < 100:
            high = max(low, math.ceil(percent / (100 - percent)) - 1) if low == 1 else max(low, int(low * ratio))
            h = high * (100 - percent) // percent
            m = h + 1
            # enough segments that H + 1 of them are in use, three deviations off the mean
            while h and (e := m * math.exp(-low / m)) < low and m - e - 3 * math.sqrt(e) < h + 1 and m < 2 * (h + 1):
                m += max(1, m // 64)
            for to, x in ((self.low, low), (self.high, high), (self.diff, h), (self.segments, m)):
                to.append(x)
            low = high + 1

    def of(self, n: int) -> range:
        """Bands that a set of ``n`` shingles meets: its own last, before it those of smaller partners."""
        if not self.high:
            return range(0)
        return range(bisect_left(self.high, -(-n * self.percent // 100)), bisect_left(self.high, n) + 1)


def keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Bucket keys of one set, roles in the two low bits."""
    out = [np.empty(0, np.uint64)]
    met = bands.of(len(s))
    for band in met:
        h, m, own = bands.diff[band], bands.segments[band], band == met[-1]
        if not h:
            continue  # only equal sets are similar enough
        salt = np.uint64((band + 1) * _SALT % 2**64)
        x = mixed(s + salt)
        seg = (x % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        x, seg = x[order], seg[order]
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        used, total = seg[starts], np.add.reduceat(x, starts)  # a subset's hash is a sum: a deletion subtracts
        count = np.diff(np.r_[starts, len(seg)])
        at = lambda g: salt + g.astype(np.uint64) * _SEG
        exact = mixed(mixed(total) + at(used))
        if len(used) > h:  # the H + 1 largest segments
            chosen = np.zeros(len(used), bool)
            chosen[np.lexsort((used, -count))[:h + 1]] = True
            role = np.where(chosen, PROBE | (INDEX if own else 0), INDEX if own else 0)
            keep = role > 0
            out.append(exact[keep] & ~np.uint64(3) | role[keep].astype(np.uint64))
            continue
        # too few segments in use: indexed here too, with its one-deletion neighbourhood and empty segments
        deleted = mixed(mixed(np.repeat(total, count) - x) + at(seg))
        empty = np.setdiff1d(np.arange(m), used)
        nothing = mixed(mixed(np.zeros(len(empty), np.uint64)) + at(empty))
        short = h + 1 - len(used)
        twos = short <= len(used)
        two = np.zeros(len(used), bool)
        if twos:
            two[np.lexsort((used, -count))[:short]] = True
        both = np.uint64(INDEX | PROBE)
        out.append(exact & ~np.uint64(3) | both)
        out.append(deleted & ~np.uint64(3) | np.where(np.repeat(two, count), both, np.uint64(INDEX)))
        out.append(nothing & ~np.uint64(3) | (np.uint64(INDEX) if twos else both))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def set_ids(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n, fp) of every row: set size and fingerprint name the set."""
    def measured(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, size, hashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) for s in sets], pa.int64())], ["doc_id", "text_hash", "n", "fp"])
    return _rows(docs).mapInArrow(measured, "doc_id long, text_hash long, n long, fp long")


def bucket_rows(docs: DataFrame, size: int, bands: Bands, memo: int = 200_000) -> DataFrame:
    """(key, role, n, fp): one row per bucket that a set indexes or probes.  A task emits a set once
    as long as it remembers it, so large groups of copies shrink before the shuffle."""
    def bucketed(batches):
        hashes, seen = WordHashes(), set()
        for b in batches:
            n, fp, ks = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, size, hashes)
                f = fingerprint(s)
                if not len(s) or (len(s), f) in seen:
                    continue
                if len(seen) >= memo:
                    seen.clear()
                seen.add((len(s), f))
                k = keys(s, bands)
                if len(k):
                    n.append(len(s))
                    fp.append(f)
                    ks.append(k.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ks)]), pa.int32()),
                                             pa.array(np.concatenate([np.empty(0, np.int64), *ks])))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(fp, pa.int64()), lists], ["n", "fp", "keys"])
    rows = _rows(docs).mapInArrow(bucketed, "n long, fp long, keys array<long>").select("n", "fp", F.explode("keys").alias("k"))
    return rows.select(F.expr("k >> 2").alias("key"), F.expr("cast(k & 3 as int)").alias("role"), "n", "fp")


def set_contents(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(n, fp, items) for the sets of the wanted rows (doc_id, text_hash)."""
    def contents(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, size, hashes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["n", "fp", "items"])
    rows = _rows(docs)
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["rep_id"]) & (rows["text_hash"] == wanted["rep_hash"]), "left_semi")
    return rows.mapInArrow(contents, "n long, fp long, items binary").dropDuplicates(["n", "fp"])


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    s = sets.select(F.struct("n", "fp").alias("w"), "items")
    both = (pairs.join(s.withColumnRenamed("w", "u").withColumnRenamed("items", "a"), "u")
            .join(s.withColumnRenamed("w", "v").withColumnRenamed("items", "b"), "v").select("u", "v", "a", "b"))

    def check(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            t = pa.Table.from_batches([b]).select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
            yield from t.to_batches()
    return both.mapInArrow(check, "u struct<n:long,fp:long>, v struct<n:long,fp:long>")


def _shared(keys: list[np.ndarray], n: np.ndarray, comp: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Pairs i * len + j of rows of different components that meet in a bucket, one probing it and
    the other in its index; of two blocks only pairs across them."""
    sizes = [len(k) for k in keys]
    flat, row = np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(flat >> 2, kind="stable")
    flat, row = flat[order], row[order]
    cuts = np.flatnonzero(np.r_[True, flat[1:] >> 2 != flat[:-1] >> 2, True])
    one, out, held = len(np.unique(block)) == 1, [np.empty(0, np.int64)], 0
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2:
            continue
        r, role = row[lo:hi], flat[lo:hi] & 3
        for k in range(len(r)):
            i, j = r[k], r[k + 1:]
            ok = (comp[j] != comp[i]) & ((role[k] & PROBE) & (role[k + 1:] & INDEX) * 2 | (role[k] & INDEX) * 2 & (role[k + 1:] & PROBE) > 0)
            ok &= (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])) & (one | (block[j] != block[i]))
            out.append(np.minimum(i, j[ok]) * len(keys) + np.maximum(i, j[ok]))
            held += len(out[-1])
        if held > 1_000_000:
            out = [np.unique(np.concatenate(out))]
            held = 0
    return np.unique(np.concatenate(out))


def _verify_blocks(percent: int):
    """Links between different components inside one pair of blocks; components found connected on
    the way are not compared again."""
    def check(t: pa.Table) -> pa.Table:
        n, fp, block = (t[c].to_numpy() for c in ("n", "fp", "block"))
        items = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
        _, comp = np.unique(np.stack([t["cn"].to_numpy(), t["cf"].to_numpy()], axis=1), axis=0, return_inverse=True)
        comp, us, vs = comp.ravel().copy(), [], []
        for code in _shared([np.array(k, np.int64) for k in t["keys"].to_pylist()], n, comp, block, percent):
            i, j = divmod(int(code), len(n))
            if comp[i] != comp[j] and similar(items[i], items[j], percent):
                us.append({"n": int(n[i]), "fp": int(fp[i])})
                vs.append({"n": int(n[j]), "fp": int(fp[j])})
                comp[comp == comp[j]] = comp[i]
        kind = pa.struct([("n", pa.int64()), ("fp", pa.int64())])
        return pa.table({"u": pa.array(us, kind), "v": pa.array(vs, kind)})
    return check


def _compare_open(rest: DataFrame, sets: DataFrame, percent: int, block_items: int, block_sets: int) -> DataFrame:
    """Links between the components that meet in open buckets.

    Components joined through open buckets form a family; a set goes to its family once, with its
    bucket keys.  A family is cut into blocks of about ``block_items`` shingles or ``block_sets`` sets,
    whichever is less, and each pair of blocks is one group, so a family of any size is compared
    without one large group.
    """
    families = connected_components(rest.select(F.col("lo").alias("u"), F.col("component").alias("v")).where("u != v").distinct())
    families = families.select(F.col("node").alias("component"), F.col("component").alias("family"))
    nodes = (rest.groupBy("node", "component").agg(F.collect_list(F.col("key") * 4 + F.col("role")).alias("keys"))
             .join(families, "component"))
    blocks = nodes.groupBy("family").agg(F.greatest(
        F.ceil(F.sum("node.n") / block_items), F.ceil(F.count("*") / block_sets)).cast("int").alias("blocks"))
    m = nodes.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("family", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "keys",
                 "node.n", "node.fp", F.col("component.n").alias("cn"), F.col("component.fp").alias("cf")).join(sets, ["n", "fp"])
    return (m.groupBy("family", "b0", "b1")
            .applyInArrow(_verify_blocks(percent), "u struct<n:long,fp:long>, v struct<n:long,fp:long>").distinct())


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with component, of the buckets that hold more than one component; of buckets with
    equal members one is kept."""
    m = members.select("key", "role", F.struct("n", "fp").alias("node")).join(labels, "node", "left")
    m = m.withColumn("component", F.coalesce("component", "node"))
    per = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"),
                               F.sum(F.xxhash64("node", "role").cast("decimal(38,0)")).alias("sum"))
    per = per.where((F.col("lo") != F.col("hi")) & (F.col("size") > 2)).groupBy("size", "sum").agg(F.min("key").alias("key"), F.min("lo").alias("lo"))
    return m.join(per.select("key", "lo"), "key")


def similar_components(docs: DataFrame, size: int = 3, percent: int = 90, block_items: int = 500_000, block_sets: int = 400) -> DataFrame:
    """Components of rows whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns doc_id, n_shingles, component_id for every row: component_id is the smallest doc_id
    reachable by links, its own included.  Null and blank texts have no shingles and are linked with
    nothing (component_id is their own doc_id).  Rows with a null doc_id are linked like others; a
    component of nothing else has a null id.  Repeated rows are links of similarity 1 and stay.
    Shingles are compared by 64-bit hashes, whole texts, sets of any size; no bucket is capped.
    """
    bands = Bands(percent)
    own = written(set_ids(docs, size), "set-ids")
    classes = (own.where("n > 0").groupBy("n", "fp")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("rep"))
               .select("n", "fp", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")))
    by = W.partitionBy("key")
    node = F.struct("n", "fp")
    members = (bucket_rows(docs, size, bands)
               .withColumns({"first": F.min(F.when(F.col("role") >= PROBE, node)).over(by), "lo": F.min(node).over(by), "hi": F.max(node).over(by)})
               .where(F.col("first").isNotNull() & (F.col("lo") != F.col("hi")))
               .groupBy("key", "n", "fp", "first").agg(F.bit_or("role").alias("role")))
    members = written(members, "buckets")
    near = 100 * F.least("u.n", "v.n") >= percent * F.greatest("u.n", "v.n")
    pairs = (members.select(F.col("first").alias("u"), node.alias("v")).where("u != v").where(near)
             .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    wanted = members.select("n", "fp").distinct().join(classes, ["n", "fp"]).select("rep_id", "rep_hash")
    sets = written(set_contents(docs, wanted, size), "set-contents")
    links = written(_verify_pairs(pairs, sets, percent), "links")
    labels = connected_components(links)
    rest = written(_open_buckets(members, labels), "open-buckets")
    if not rest.isEmpty():
        more = written(_compare_open(rest, sets, percent, block_items, block_sets), "links")
        labels = connected_components(links.unionByName(more))
    named = classes.select(node.alias("node"), "rep_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    by_class = named.join(smallest, "component").select(F.col("node.n").alias("n"), F.col("node.fp").alias("fp"), "component_id")
    rows = own.join(by_class, ["n", "fp"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
