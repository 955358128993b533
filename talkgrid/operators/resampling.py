"""Bootstrap intervals in one pass: every resample is an element of a vector.

Rows are ordered by score over tasks by range, with a salt so that a score shared by many rows spreads over several of them. A task draws the
weights of all resamples from a hash of the row and adds up, per run of equal scores, what the area under the ROC curve needs. It
returns a few rows, its first and last score alone and everything between as one, so equal scores of several tasks meet before they count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

SEGMENT = "which string, lo double, hi double, run boolean, pos array<double>, neg array<double>, area array<double>"


def poisson_cdf() -> np.ndarray:
    out, total, k = [], 0.0, 0
    while total < 1 - 1e-9:
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
        k += 1
    return np.array(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_weights(row_hash: np.ndarray, repeats: int) -> np.ndarray:
    """Poisson(1) weights, one row per row and one column per resample, fixed by the row's hash; a last column of ones is the plain sample."""
    with np.errstate(over="ignore"):
        streams = _mixed(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = (_mixed(row_hash.view(np.uint64)[:, None] ^ streams[None, :]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    w = np.ones((len(row_hash), repeats + 1))
    w[:, :repeats] = np.searchsorted(poisson_cdf(), u, "right")
    return w


class _Segments:
    """Runs of equal scores in order, as first run, what lies between, and last run."""

    def __init__(self, size: int):
        self.size = size
        self.first = self.last = None
        self.ends, self.pos, self.neg, self.area = None, np.zeros(size), np.zeros(size), np.zeros(size)

    def add(self, scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Runs that follow; the first may go on with the last one held."""
        if self.last is not None:
            if self.last[0] == scores[0]:
                pos[0] += self.last[1]
                neg[0] += self.last[2]
            else:
                scores, pos, neg = np.concatenate(([self.last[0]], scores)), np.vstack((self.last[1], pos)), np.vstack((self.last[2], neg))
        done = len(scores) - 1
        at = 0
        if self.first is None and done:
            self.first, at = (float(scores[0]), pos[0].copy(), neg[0].copy()), 1
        if done > at:
            p, n = pos[at:done], neg[at:done]
            before = self.neg + np.cumsum(n, 0) - n
            self.area += (p * (before + n / 2)).sum(0)
            self.pos += p.sum(0)
            self.neg += n.sum(0)
            self.ends = (float(scores[at]) if self.ends is None else self.ends[0], float(scores[done - 1]))
        self.last = (float(scores[done]), pos[done].copy(), neg[done].copy())

    def rows(self, which: str):
        none = np.zeros(self.size)
        for run in (self.first, self.last):
            if run is not None:
                yield which, run[0], run[0], True, run[1], run[2], none
        if self.ends is not None:
            yield which, *self.ends, False, self.pos, self.neg, self.area


def auc_of_resamples(rows: DataFrame, repeats: int, slice_rows: int = 2048) -> DataFrame:
    """``(which, replicate, auc)`` for ``rows(which, score, y, h)``; replicate ``repeats`` is the plain sample. AUC is null where a class is missing."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isNotNull())
    d = known.withColumn("salt", F.pmod("h", F.lit(1 << 16))).repartitionByRange(n, "which", "score", "salt").sortWithinPartitions("which", "score").select("which", "score", "y", "h")

    def run(batches):
        held: dict[str, _Segments] = {}
        for b in batches:
            for i in range(0, b.num_rows, slice_rows):
                part = b.slice(i, slice_rows)
                which = np.array(part.column(0).to_pylist())
                score, y, h = (part.column(c).to_numpy() for c in (1, 2, 3))
                score = score + 0.0  # zeros of either sign are one score
                for name in dict.fromkeys(which.tolist()):
                    mine = which == name
                    w, s, positive = drawn_weights(h[mine], repeats), score[mine], (y[mine] == 1)[:, None]
                    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    held.setdefault(name, _Segments(repeats + 1)).add(s[cut], np.add.reduceat(w * positive, cut), np.add.reduceat(w * ~positive, cut))
        for name, segments in held.items():
            for r in segments.rows(name):
                yield pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]]), pa.array([r[2]]), pa.array([r[3]]), *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in r[4:]]],
                                                 names=["which", "lo", "hi", "run", "pos", "neg", "area"])

    parts = d.mapInArrow(run, SEGMENT)
    total = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)
    # equal scores of several tasks are one segment now
    merged = parts.groupBy("which", "lo", "hi", "run").agg(total("pos"), total("neg"), total("area"))
    each = merged.select("which", "lo", "hi", "run", F.posexplode(F.arrays_zip("pos", "neg", "area")).alias("replicate", "s")).select("which", "lo", "hi", "run", "replicate", "s.*")
    w = W.partitionBy("which", "replicate").orderBy("lo", "hi")
    before = F.coalesce(F.sum("neg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.when(F.col("run"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("area"))
    got = each.withColumn("part", F.col("pos") * before + inside)
    g = got.groupBy("which", "replicate").agg(F.sum("part").alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return g.select("which", "replicate", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))).alias("auc"))


def bootstrap_auc_difference(df: DataFrame, id_col: str, a: str, b: str, y: str = "y", repeats: int = 1000, seed: int = 2026) -> DataFrame:
    """AUC difference of two scores with a percentile interval over hash-seeded Poisson resamples, all of them in one pass."""
    base = df.select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.col(y).cast("int").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    auc = auc_of_resamples(base.unpivot(["h", "y"], ["a", "b"], "which", "score").select("which", "score", "y", "h"), repeats)
    one = lambda s: F.max(F.when(F.col("which") == s, F.col("auc")))
    diff = auc.groupBy("replicate").agg((one("a") - one("b")).alias("d"))
    drawn = F.col("replicate") < repeats
    q = F.percentile(F.when(drawn, F.col("d")), F.array(F.lit(.025), F.lit(.975)))  # one value per replicate
    return diff.agg(F.max(F.when(~drawn, F.col("d"))).alias("delta_auc"), q.alias("q"), F.count_if(drawn & F.col("d").isNotNull()).alias("replicates")).select(
        "delta_auc", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates")
