"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard.

One more coordinate makes all candidates of a shard equally long; then the largest inner product is the
smallest distance, and the triangle inequality holds. Every shard (a hash of the id) builds a tree: a vantage point, the
median distance to it, the nearer half and the farther half, down to leaves that are compared in one matrix product. A block
of queries walks the tree together, each query into its own half first. The other half is left out when
``factor * |distance to the vantage point - median|`` exceeds the distance of the query's k-th best: with a factor of one
only what cannot hold a neighbour is left out, so the search is exact; larger factors leave out more.

Equal vectors of a shard are one point that carries its smallest ids. Scores are computed anew on the original vectors, in
double precision, in an order that does not depend on the place of a vector, so equal vectors have equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import table

FOUND = "query_id bigint, vec_id bigint, score double"


class VantageTree:
    """A tree over the rows of ``x``, all of one length."""

    def __init__(self, x: np.ndarray, leaf: int = 512, seed: int = 0):
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple] = []
        draw = np.random.default_rng(seed)
        todo = [(0, len(x), None)]
        while todo:
            lo, hi, parent = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = me
            if hi - lo <= leaf:
                self.nodes.append([lo, hi])
                continue
            at = self.order[lo:hi]
            v = x[at[draw.integers(hi - lo)]]
            d = np.sqrt(np.maximum(((x[at] - v) ** 2).sum(1), 0))
            half = (hi - lo) // 2
            part = np.argpartition(d, half)
            self.order[lo:hi] = at[part]
            self.nodes.append([v, float(d[part[:half]].max()), float(d[part[half]]), 0, 0])
            todo += [(lo, lo + half, (me, 3)), (lo + half, hi, (me, 4))]

    def search(self, q: np.ndarray, k: int, factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(query, point)`` pairs that hold every query's ``k`` nearest (ties at the end included). ``q`` has the added coordinate 0."""
        m = len(q)
        best = np.full((m, k), -np.inf)
        reach = (q ** 2).sum(1) + (self.x[0] ** 2).sum()
        slack = 1e-9 * (1 + reach)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def tau(a: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(reach[a] - 2 * best[a, -1] + slack[a], 0))

        def leaf(lo: int, hi: int, a: np.ndarray) -> None:
            points = self.order[lo:hi]
            for i in range(0, len(a), 2048):
                b = a[i:i + 2048]
                s = q[b] @ self.x[points].T
                best[b] = -np.sort(np.partition(-np.concatenate((best[b], s), 1), k - 1, 1)[:, :k], 1)
                r, c = np.nonzero(s >= (best[b, -1] - slack[b])[:, None])
                hits.append((b[r], points[c], s[r, c]))

        def visit(n: int, a: np.ndarray) -> None:
            node = self.nodes[n]
            if len(node) == 2:
                leaf(*node, a)
                return
            v, inner, outer, left, right = node
            d = np.sqrt(np.maximum(reach[a] - 2 * (q[a] @ v), 0))
            near = d <= (inner + outer) / 2
            for first, then, who in ((left, right, near), (right, left, ~near)):
                if who.any():
                    visit(first, a[who])
            for first, then, who, gap in ((left, right, near, outer - d), (right, left, ~near, d - inner)):
                if who.any():
                    # the other half is at least ``gap`` away
                    ask = who & (factor * gap <= tau(a))
                    if ask.any():
                        visit(then, a[ask])

        visit(0, np.arange(m))
        rows, points, score = (np.concatenate(c) for c in zip(*hits))
        ok = score >= best[rows, -1] - slack[rows]
        return rows[ok], points[ok]


def _search(k: int, factor: float, leaf: int):
    def run(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(points) or not len(queries):
            return empty
        points, queries = points.sort_values("id"), queries.sort_values("id")
        ids, x = points["id"].to_numpy(), np.stack(points["v"].to_numpy()).astype(np.float64)
        # equal vectors: one point with its k + 1 smallest ids (one of them may be the query)
        _, first, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(same, kind="stable")
        start = np.searchsorted(same[by], np.arange(len(first) + 1))
        flat = x[first]
        norms = (flat ** 2).sum(1)
        lifted = np.column_stack([flat, np.sqrt(np.maximum(norms.max() - norms, 0))])
        qid, q = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(np.float64)
        tree = VantageTree(lifted, leaf, int(key[1]))
        r, p = tree.search(np.column_stack([q, np.zeros(len(q))]), k + 1, factor)
        score = np.concatenate([(flat[p[i:i + 65536]] * q[r[i:i + 65536]]).sum(1) for i in range(0, len(p), 65536)] or [np.zeros(0)])
        copies = np.minimum(start[p + 1] - start[p], k + 1)
        rows = np.repeat(np.arange(len(p)), copies)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
        vec, who, score = ids[by[start[p[rows]] + nth]], r[rows], score[rows]
        keep = vec != qid[who]
        vec, who, score = vec[keep], who[keep], score[keep]
        order = np.lexsort((vec, -score, who))
        vec, who, score = vec[order], who[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < k
        return pd.DataFrame({"query_id": qid[who[top]], "vec_id": vec[top], "score": score[top]})

    return run


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)``: one row per id with a vector of finite numbers that is not zero; of an id with several vectors the smallest stays."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good).groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.5, shard_rows: int = 65_536, block_rows: int = 8_192, leaf: int = 512) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest of ``vectors(id, v)`` but itself, ties to the smaller id.

    Both sides come from ``usable``. Only vectors of equal length meet. Shards and blocks are bounded in size; a task holds one
    shard, one block and the matrix of a leaf. The product of both grows with queries times vectors, as the task does.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // shard_rows), min(parallel, -(-n // 2048)))
    blocks = max(1, -(-m // block_rows))
    spread = lambda d, c, own, other, count: d.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(c)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(other), "id", "v")
    left = spread(vectors, shards, "shard", "block", blocks).groupBy("dim", "shard", "block")
    right = spread(queries, blocks, "block", "shard", shards).groupBy("dim", "shard", "block")
    found = left.cogroup(right).applyInPandas(_search(k, factor, leaf), FOUND)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nearest(v, v.where(F.pmod("id", F.lit(20)) == 0))
