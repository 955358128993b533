"""Hard negatives by coordinate pruning over length buckets.

Vectors become integers (``floor(256 x)``), and a score is an integer inner product, so it is exact and ties are ties. A shard of
vectors (a hash of the id) is cut into *length buckets*, longest first. A bucket keeps, for every coordinate, the list of its unit vectors
sorted by that coordinate.

A search asks, per anchor, for the best rows with a score in ``[lo, hi]``; ``lo`` rises to the score of the k-th best found. With the lengths of anchor and
bucket the bounds become a range of angles between the two; with the angle between the anchor and an axis, the triangle inequality turns it into a feasible
range of values of that coordinate. For a few *focus* coordinates, the anchor's largest, that range is a run of the sorted list; the candidate
sets of the runs are intersected, and what is left is verified with the exact product. A bucket whose longest vector cannot reach ``lo`` is skipped.
Ranges that rule out too little to be worth the lookups are not intersected: the bucket is verified as a whole.

The same search runs twice: for the positives (same label, no bounds), then for the negatives (other labels, bounds from each positive's score).
A task holds one shard, one block of anchors and the products of a slice of both; the search is exact, so neither shards nor blocks change the result.

Rows take no part whose id, label or vector is null, or whose vector holds a null or non-finite component or has an integer squared length of 2^62 or more (its
score would not fit a long). Of an id in several rows the one with the smallest label, then vector, stands. Only vectors of equal length meet; zero and empty
vectors score 0. Equal vectors are rows of their own, told apart by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, written

FOUND = "anchor bigint, ask bigint, id bigint, score bigint"
LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: Anchors whose products with a bucket are held at once.
SLICE = 256


class LengthBucket:
    """Rows of similar length, with one sorted list per coordinate."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, length: np.ndarray):
        self.rows, self.longest, self.shortest = rows, float(length[rows[0]]), float(length[rows[-1]])
        self.unit = x[rows] / np.maximum(length[rows], 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.unit, self.order, 0).T)

    def cosines(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the cosine with an anchor of that length for scores in ``[lo, hi]``; an empty range where none can be reached."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = lo / length / np.where(lo >= 0, self.longest, self.shortest)
            most = hi / length / np.where(hi >= 0, self.shortest, self.longest)
        free = (length == 0) | (self.longest == 0)
        least = np.where(free | np.isnan(least), -1.0, least)
        most = np.where(free | np.isnan(most), 1.0, most)
        slack = 1e-9
        return least - slack, most + slack

    def candidates(self, q: np.ndarray, focus: np.ndarray, least: float, most: float, enough: float) -> np.ndarray | None:
        """Places in the bucket that may have a cosine in the range, or None where the lists rule out too little."""
        wide, narrow = np.arccos(max(least, -1.0)), np.arccos(min(most, 1.0))
        axis = np.arccos(np.clip(q[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, np.minimum(axis + wide, 2 * np.pi - axis - narrow))) - 1e-9
        low = np.where(axis + wide >= np.pi, np.where(2 * np.pi - axis - narrow < np.pi, low, -2.0), low)
        high = np.where(axis <= wide, np.where(narrow > axis, np.cos(narrow - axis), 2.0), np.cos(np.maximum(axis - wide, 0))) + 1e-9
        runs = [(np.searchsorted(self.sorted[f], a, "left"), np.searchsorted(self.sorted[f], b, "right")) for f, a, b in zip(focus.tolist(), low.tolist(), high.tolist())]
        sizes = [max(0, j - i) for i, j in runs]
        first = int(np.argmin(sizes))
        if sizes[first] > enough * len(self.rows):
            return None
        i, j = runs[first]
        found = self.order[i:max(i, j), focus[first]]
        for n, f in enumerate(focus.tolist()):
            if n != first and sizes[n] < len(self.rows):
                v = self.unit[found, f]
                found = found[(v >= low[n]) & (v <= high[n])]
        return found


class CoordinateIndex:
    """Length buckets of a shard, longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rows: int = 1024, ratio: float = 0.9, least: int = 64):
        self.ids, self.labels = ids, labels
        squares = (x * x).sum(1)
        length = np.sqrt(squares.astype(np.float64))
        by = np.lexsort((ids, -length))
        # products of vectors this short are exact in double precision, which is the fast way to multiply them
        self.exact = float(length.max(initial=0.0)) < 2.0 ** 26
        self.x = x.astype(np.float64) if self.exact else x
        self.buckets, i = [], 0
        while i < len(by):
            longest = length[by[i]]
            j = min(len(by), i + rows)
            short = i + int(np.searchsorted(-length[by[i:j]], -longest * ratio, "right"))
            j = max(short, min(j, i + least)) if longest > 0 else j
            zero = i + int(np.searchsorted(-length[by[i:j]], 0.0, "left"))
            if i < zero < j:
                j = zero
            self.buckets.append(LengthBucket(by[i:j], x, length))
            i = j

    def search(self, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, asks: pd.DataFrame, k: int, same: bool, focus: int = 5, enough: float = 0.5):
        """For ``asks(anchor, lo, hi)``, sorted by anchor (a row of ``q``): the ``k`` best rows each, as ``(ask, id, score)``.

        ``same``: rows of the anchor's label, else rows of other labels; never the anchor's own.
        """
        out = []
        of = asks["anchor"].to_numpy(np.int64)
        lo, hi = asks["lo"].to_numpy(np.int64), asks["hi"].to_numpy(np.int64)
        q_length = np.sqrt((q * q).sum(1).astype(np.float64))
        q_unit = q / np.maximum(q_length, 1e-300)[:, None]
        exact = self.exact and float(q_length.max(initial=0.0)) < 2.0 ** 26
        x, q = (self.x, q.astype(np.float64)) if exact else (self.x.astype(np.int64), q)
        axes = np.argsort(-np.abs(q_unit), axis=1, kind="stable")[:, :focus]
        for i in range(0, len(q), SLICE):
            n = min(SLICE, len(q) - i)
            a, b = np.searchsorted(of, [i, i + n])
            if a == b:
                continue
            mine, low, high = of[a:b] - i, lo[a:b].copy(), hi[a:b]
            start = np.searchsorted(mine, np.arange(n))
            times = np.searchsorted(mine, np.arange(n), "right") - start
            asked = np.flatnonzero(times)
            best = [np.zeros(0, np.int64) for _ in range(3)]  # ask, id, score
            for bucket in self.buckets:
                least = np.full(n, HIGHEST)
                most = np.full(n, LOWEST)
                np.minimum.at(least, mine, low)
                np.maximum.at(most, mine, high)
                c_low, c_high = bucket.cosines(least.astype(np.float64), most.astype(np.float64), q_length[i:i + n])
                alive = asked[(c_low[asked] <= 1) & (c_high[asked] >= -1) & (c_low[asked] <= c_high[asked]) & (least[asked] <= most[asked])]
                whole, parts = [], []
                for r in alive.tolist():
                    if (c_low[r] <= -1 and c_high[r] >= 1) or not len(axes[i + r]) or bucket.longest == 0:
                        whole.append(r)
                        continue
                    found = bucket.candidates(q_unit[i + r], axes[i + r], c_low[r], c_high[r], enough)
                    if found is None:
                        whole.append(r)
                    elif len(found):
                        rows = bucket.rows[found]
                        parts.append((np.full(len(rows), r), rows, x[rows] @ q[i + r]))
                if whole:
                    w = np.array(whole)
                    s = q[i + w] @ x[bucket.rows].T
                    r, c = np.nonzero((s >= least[w][:, None]) & (s <= most[w][:, None]))
                    parts.append((w[r], bucket.rows[c], s[r, c]))
                if not parts:
                    continue
                r, rows, s = (np.concatenate(p) for p in zip(*parts))
                s = s.astype(np.int64)
                fit = ((self.labels[rows] == q_labels[i + r]) == same) & (self.ids[rows] != q_ids[i + r])
                r, rows, s = r[fit], rows[fit], s[fit]
                at = np.repeat(np.arange(len(r)), times[r])
                ask = start[r[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times[r]) - times[r], times[r])
                fit = (s[at] >= low[ask]) & (s[at] <= high[ask])
                at, ask = at[fit], ask[fit]
                best = [np.concatenate(p) for p in zip(best, (ask, self.ids[rows[at]], s[at]))]
                by = np.lexsort((best[1], -best[2], best[0]))
                rank = np.arange(len(by)) - np.searchsorted(best[0][by], best[0][by])
                by = by[rank < k]
                best = [c[by] for c in best]
                full = np.flatnonzero(rank[rank < k] == k - 1)
                low[best[0][full]] = best[2][full]
            out.append((best[0] + a, best[1], best[2]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search(k: int, same: bool):
    def run(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "ask", "id", "score")})
        if not len(points) or not len(anchors):
            return none
        points, anchors = points.sort_values("id"), anchors.sort_values("id")
        x, q = (np.stack(t["v"].to_numpy()).astype(np.int64) for t in (points, anchors))
        index = CoordinateIndex(points["id"].to_numpy(), points["label"].to_numpy(), x)
        number = np.repeat(np.arange(len(anchors)), anchors["asks"].map(len))
        name, lo, hi = (np.concatenate([np.asarray(a, np.int64) for a in anchors[c]]) for c in ("asks", "lo", "hi"))
        ask, ids, score = index.search(q, anchors["id"].to_numpy(), anchors["label"].to_numpy(), pd.DataFrame({"anchor": number, "lo": lo, "hi": hi}), k, same)
        return pd.DataFrame({"anchor": anchors["id"].to_numpy()[number[ask]], "ask": name[ask], "id": ids, "score": score})

    return run


def _best(points: DataFrame, anchors: DataFrame, k: int, same: bool, shard_rows: int, block_rows: int) -> DataFrame:
    """``(anchor, ask, rank, id, score)`` for ``anchors(id, label, v, asks, lo, hi)``: the ``k`` best of every ask over all shards."""
    n, m = points.count(), anchors.count()
    parallel = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, -(-n // shard_rows), min(parallel, -(-n // 2048))), max(1, -(-m // block_rows))
    key = ["dim", "shard", "block"]
    spread = lambda d, own, a, other, b: d.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias(other),
                                                *[F.col(c).alias(c) for c in d.columns])  # noqa: E731 - own column ids on each side
    found = spread(points, "shard", shards, "block", blocks).groupBy(*key).cogroup(spread(anchors, "block", blocks, "shard", shards).groupBy(*key)).applyInPandas(_search(k, same), FOUND)
    w = W.partitionBy("anchor", "ask").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """``(id, label, v)``: one row per id that takes part."""
    v = F.col(vector).cast("array<double>")
    whole = F.transform(v, lambda e: F.floor(e * 256))
    squares = F.aggregate(v, F.lit(0.0), lambda s, e: s + F.pow(F.floor(e * 256).cast("double"), F.lit(2.0)))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    d = vectors.select(F.col(key).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
                       F.when(finite, F.when(squares < 2.0 ** 62, whole)).alias("v"))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    return d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def hard_negatives(points: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = 32_768, block_rows: int = 4_096) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``anchors`` against ``points``, both from :func:`integer_vectors`.

    An anchor's positives are its best other rows of its label; of each, the best rows of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's are returned. A positive without such rows, and an anchor without positives, has no row.
    """
    whole = lambda n: F.array(F.lit(n).cast("bigint"))
    near = _best(points, anchors.select("id", "label", "v", whole(0).alias("asks"), whole(LOWEST).alias("lo"), whole(HIGHEST).alias("hi")), positives, True, shard_rows, block_rows)
    rest = F.pmod("score", F.lit(100))
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    near = near.withColumn("lo", (hundreds * low + F.ceil(rest * low / 100)).cast("bigint")).withColumn("hi", (hundreds * high + F.floor(rest * high / 100)).cast("bigint"))
    near = written(near.select("anchor", F.col("id").alias("positive"), "score", "lo", "hi"), "positives")
    asks = near.where("lo <= hi").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive", "lo", "hi"))).alias("a"))
    asked = anchors.join(asks, F.col("id") == F.col("anchor")).select("id", "label", "v", F.col("a.positive").alias("asks"), F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))
    far = _best(points, asked, negatives, False, shard_rows, block_rows)
    named = far.select(F.col("anchor"), F.col("ask").alias("positive"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(near.select("anchor", "positive", "score"), ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end")
    points = written(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label=label), "vectors")
    return hard_negatives(points, points.where(F.pmod("id", F.lit(100)) == 0))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, a.label as anchor_label, v.vec_id, v.label,
         cast(list_sum(list_transform(list_zip(a.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0
), pos as (
  select anchor_id, vec_id as positive_id, score as positive_score,
         row_number() over (partition by anchor_id order by score desc, vec_id) as r
  from s where label = anchor_label
), neg as (
  select pos.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by pos.anchor_id, positive_id order by s.score desc, s.vec_id) as int) as rank
  from pos join s on s.anchor_id = pos.anchor_id
  where r <= 5 and s.label <> s.anchor_label and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 10
"""
