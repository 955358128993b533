"""Jaccard join of word n-grams over an R-tree of count vectors.

Every text becomes the set of its n-grams. The tokens of a set are hashed into ``groups`` groups, and the numbers of tokens per group are a point. Two sets share
at most the sum of the coordinate minima of their points, so that sum, against both sizes, tells which pairs can reach the threshold. An R-tree over the points carries the bound to
boxes: the sum of minima of two boxes' upper corners, against the smallest sizes in them. Pairs of boxes are followed downwards, and what survives at the
points is verified on full sets.

Points of unrelated texts of one size lie so close in so many dimensions that boxes part them late. The first level of the tree therefore splits by single tokens, the finest
groups there are: a *cell* holds sets that have a token in their *sample*, the ``4 / 3 * firsts`` smallest tokens by hash.
Two sets at the threshold share at least a known number of tokens of their samples, which depends on their size (see ``shared_at_least``), but for a probability of
(1 - threshold) ^ firsts, 1.3e-10 at 0.85 and 12; sets whose union is no larger than a sample always do. So a set need not be in the cells of its most common tokens: with ``r``
tokens shared, one of them is among all but the ``r - 1`` most common ones of either sample. A set that shares fewer than ``r`` tokens of its sample with anything is in no cell, so
phrases that many unrelated texts have in common bring few of them together.
Cells with many members are split by size, component and hash into tiles, and pairs of tiles whose sizes fit are joined.

Links are confirmed in rounds (see ``linking``). Texts with equal sets are one node throughout.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows without an id are linked with nothing either and keep a null component. Rows that repeat an id
are judged by their own texts; each row gives one row. Very long texts count whole. More columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import per_batch, table, text_or_empty, written
from .linking import linked_rows
from .shingles import fingerprints, shingle_sets

#: Points of a leaf; cells of no more are joined without a tree.
LEAF = 16
#: Point pairs that are listed at once, and those whose coordinate minima are summed at once.
PAIRS, SUMS = 1 << 15, 1 << 12
#: Unions up to this size have their shared tokens counted exactly, larger ones as draws with replacement, which share no more.
UNIONS = 4096


@lru_cache(maxsize=8)
def shared_at_least(percent: int, sample: int, miss: float) -> np.ndarray:
    """At ``[n]``, or the last place for larger sets: how many tokens of both samples a set of ``n`` tokens shares at least with any set at the threshold, but for a probability of ``miss``.

    Of the ``sample`` smallest tokens of a union, those that both sets have are in both samples; hashes make them a draw from the union.
    """
    def most(tail) -> int:
        """The largest count with less than ``miss`` below it."""
        below, r = 0.0, 0
        while r < sample:
            below += tail(r)
            if below > miss:
                break
            r += 1
        return max(1, r)

    p = percent / 100
    large = most(lambda r: comb(sample, r) * p ** r * (1 - p) ** (sample - r))
    of_union = [0]
    for u in range(1, UNIONS + 1):
        both = -(-percent * u // 100)
        of_union.append(max(1, both) if u <= sample else most(lambda r: comb(both, r) * comb(u - both, sample - r) / comb(u, sample)))
    # a union with a set of n tokens has n to n / threshold tokens
    return np.array([0, *(min(of_union[n:100 * n // percent + 1]) for n in range(1, UNIONS * percent // 100)), large], np.int32)


def count_points(docs: DataFrame, words: int, percent: int, groups: int, firsts: int, text: str, key: str) -> DataFrame:
    """``(doc_id, n, s1, s2, point, firsts, least)`` of every row: set size, fingerprints, counts per group (bytes or 32-bit), the sample, how many of it a similar set shares at least."""
    sample = firsts + firsts // 3
    table_of_least = shared_at_least(percent, sample, (1 - percent / 100) ** firsts)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h, offsets = shingle_sets(b.column(1), words)
        n = np.diff(offsets)
        owner = np.repeat(np.arange(len(n)), n)
        # tokens are hashes: their low bits name the group, their order (the high bits) the smallest ones
        counts = np.bincount(owner * groups + (h & np.uint64(groups - 1)).astype(np.int64), minlength=len(n) * groups).reshape(len(n), groups)
        points = [c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes() for c in counts]
        few = np.minimum(n, sample)
        ends = np.concatenate(([0], np.cumsum(few)))
        places = np.repeat(offsets[:-1], few) + np.arange(ends[-1]) - np.repeat(ends[:-1], few)
        s1, s2 = fingerprints(h, offsets)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[places].view(np.int64)))
        least = table_of_least[np.minimum(n, len(table_of_least) - 1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s1), pa.array(s2), pa.array(points, pa.binary()), lists, pa.array(least)],
                                          names=["doc_id", "n", "s1", "s2", "point", "firsts", "least"])

    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("x"))
    return d.mapInArrow(per_batch(run, 256), "doc_id bigint, n bigint, s1 bigint, s2 bigint, point binary, firsts array<bigint>, least int")


def may_reach(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``sizes`` tokens can be similar enough with at most that overlap."""
    return (100 + percent) * overlap >= percent * sizes


def overlaps(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), SUMS):
        k = slice(i, i + SUMS)
        out[k] = np.minimum(points[a[k]], points[b[k]]).sum(1, dtype=np.int32)
    return out


class CountTree:
    """An R-tree over count vectors, packed by splitting at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, n: np.ndarray, leaf: int = LEAF, comp: np.ndarray | None = None):
        m = len(n)
        comp = np.arange(m) if comp is None else comp  # a leaf of one point has no pairs
        self.points, self.n = points, n
        self.depth = max(0, int(np.ceil(np.log2(max(m, 1) / leaf))))
        wide = np.column_stack([points, n])
        order = np.arange(m)
        self.cuts = [np.array([m * i >> level for i in range((1 << level) + 1)]) for level in range(self.depth + 1)]
        for level in range(self.depth):
            for i in range(1 << level):
                lo, mid, hi = self.cuts[level][i], self.cuts[level + 1][2 * i + 1], self.cuts[level][i + 1]
                at = order[lo:hi]
                if mid > lo and hi > mid:
                    axis = int(np.argmax(wide[at].max(0) - wide[at].min(0)))
                    order[lo:hi] = at[np.argpartition(wide[at, axis], mid - lo)]
        self.order = order
        self.upper = [np.maximum.reduceat(points[order], c[:-1]) for c in self.cuts]
        self.least = [np.minimum.reduceat(n[order], c[:-1]) for c in self.cuts]
        self.most = [np.maximum.reduceat(n[order], c[:-1]) for c in self.cuts]
        # a box of one component names it
        self.one = [np.where(np.minimum.reduceat(comp[order], c[:-1]) == np.maximum.reduceat(comp[order], c[:-1]), comp[order[c[:-1]]], -1) for c in self.cuts]

    def _boxes_may(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        up, least, most, one = self.upper[level], self.least[level], self.most[level], self.one[level]
        ok = (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a]) & ((one[a] != one[b]) | (one[a] < 0))
        at = np.flatnonzero(ok)
        for i in range(0, len(at), PAIRS):
            k = at[i:i + PAIRS]
            ok[k] = may_reach(overlaps(up, a[k], b[k]), least[a[k]] + least[b[k]], percent)
        return ok

    def pairs(self, percent: int, wanted: Callable | None = None):
        """Yields ``(a, b, overlap bound)`` of points that may be similar enough, each pair once; ``wanted(a, b)`` tells which pairs count."""
        a = b = np.zeros(1, np.int64)
        for level in range(1, self.depth + 1):
            a, b = np.repeat(2 * a, 4) + np.tile([0, 0, 1, 1], len(a)), np.repeat(2 * b, 4) + np.tile([0, 1, 0, 1], len(b))
            once = a <= b
            a, b = a[once], b[once]
            ok = self._boxes_may(level, a, b, percent)
            a, b = a[ok], b[ok]
        cuts = self.cuts[-1]
        size = np.diff(cuts)
        products = size[a] * size[b]
        ends = np.cumsum(products)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            x, y, p = a[i:j], b[i:j], products[i:j]
            row = np.repeat(np.arange(len(x)), p)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(p) - p, p)
            left, right = cuts[x[row]] + nth // size[y[row]], cuts[y[row]] + nth % size[y[row]]
            once = left < right
            left, right = self.order[left[once]], self.order[right[once]]
            yield from _near(self.points, self.n, left, right, percent, wanted)
            i = j


def _near(points, n, a, b, percent, wanted=None):
    """Of point pairs those that may be similar enough, with the bound on their overlap."""
    for i in range(0, len(a), PAIRS):
        x, y = a[i:i + PAIRS], b[i:i + PAIRS]
        fit = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        if wanted is not None:
            fit &= wanted(x, y)
        x, y = x[fit], y[fit]
        bound = overlaps(points, x, y)
        fit = may_reach(bound, n[x] + n[y], percent)
        yield x[fit], y[fit], bound[fit]


def _candidates(percent: int, groups: int):
    """Candidates within tiles: all pairs of a leaf's worth of points, the tree's pairs of more; of different components and sides only."""
    def pairs_of(t: pa.Table, heads: np.ndarray, sizes: np.ndarray):
        n, comp, side = (t.column(c).to_numpy() for c in ("n", "comp", "side"))
        within = t.column("t1").to_numpy() == t.column("t2").to_numpy()
        # bytes unless there are larger counts
        points = np.stack([np.frombuffer(r, np.uint8 if len(r) == groups else np.uint32) for r in t.column("point").to_pylist()])

        def wanted(a, b, at=0):
            return (comp[a + at] != comp[b + at]) & (within[a + at] | (side[a + at] != side[b + at]))

        def likely(found, at=0):
            for a, b, bound in found:
                yield a + at, b + at, bound / (n[a + at] + n[b + at])

        for m in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
            i, j = np.triu_indices(m, 1)
            head = heads[sizes == m][:, None]
            yield from likely(_near(points, n, (head + i).ravel(), (head + j).ravel(), percent, wanted))
        for g in np.flatnonzero(sizes > LEAF).tolist():
            c = slice(heads[g], heads[g] + sizes[g])
            yield from likely(CountTree(points[c], n[c], comp=comp[c]).pairs(percent, partial(wanted, at=heads[g])), heads[g])

    return pairs_of


def cells_of(nodes: DataFrame) -> DataFrame:
    """``(node, n, place, cell)``: the cells of each node, all but the ``least - 1`` most common tokens of its sample that other nodes have too, in the order of their hashes."""
    sampled = nodes.select("node", "n", "least", F.explode("firsts").alias("cell"))
    shared = sampled.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    own = Window.partitionBy("node")
    # tokens that no other sample has are the rarest ones, and need no cell
    ranked = sampled.join(shared, "cell").withColumn("rank", F.row_number().over(own.orderBy("m", "cell"))).withColumn("shared", F.count(F.lit(1)).over(own))
    kept = ranked.where("rank <= shared - least + 1")
    return kept.select("node", "n", (F.row_number().over(own.orderBy("cell")) - 1).alias("place"), "cell")


def jaccard_links(docs: DataFrame, words: int = 5, percent: int = 80, groups: int = 128, firsts: int = 12, partners: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id)``; texts are linked where ``100 * intersection >= percent * union``."""
    rows = written(count_points(docs, words, percent, groups, firsts, text, key), "points")
    real = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("point").alias("point"), F.any_value("firsts").alias("firsts"), F.any_value("least").alias("least"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    posted = written(cells_of(nodes), "posted")
    linked = linked_rows(rows.select("doc_id", "n", "s1", "s2"), nodes.drop("firsts", "least"), posted, _candidates(percent, groups), docs, words, percent, partners, text, key)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
