"""Choosing documents like a target by importance resampling.

Words and word pairs are hashed into a fixed number of buckets. One generative model (bucket probabilities) is
counted over all documents, another over target documents; a document's log weight is the mean log ratio of
the two over its n-grams, times ``scale`` (as if every document had that many n-grams: the plain sum would only rank by length). Adding
Gumbel noise to the log weights and taking the ``k`` largest draws documents without replacement in proportion to their weights.

The noise is a hash of the document and a seed, so reruns and retried tasks agree. The k-th largest value is found by
narrowing histograms over a written table, not by sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, mix64, per_batch, pieces_of_batch, table, text_bytes, text_or_empty, uniform, word_bounds, written


def gram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and pair of neighbours, and the number of its text."""
    raw, offsets = text_bytes(texts)
    starts, ends = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    size = ends - starts
    with np.errstate(over="ignore"):
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        at = np.repeat(starts, size) + place
        w = mix64(np.add.reduceat(mix64(lower[at] + np.uint64(1)) * power[place], np.cumsum(size) - size))
        doc = np.searchsorted(offsets, starts, "right") - 1
        pair = doc[1:] == doc[:-1]
        two = mix64(w[:-1][pair] * np.uint64(3) + w[1:][pair])
    return (np.concatenate((w, two)) % np.uint64(buckets)).astype(np.int64), np.concatenate((doc, doc[1:][pair]))


def gram_counts(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """Occurrences per bucket over whole texts of all ``docs``; at most ``buckets`` rows reach the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in pieces_of_batch(b, 256):
                total += np.bincount(gram_buckets(part.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    counted = docs.select(text_or_empty(text).alias("x")).mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.b] = r.n
    return out


def log_weights(docs: DataFrame, target: DataFrame, buckets: int = 1 << 16, scale: float = 20.0, text: str = "text", output: str = "log_weight", smooth: float = 1.0) -> DataFrame:
    """``docs`` with ``output``: the log weight of the whole text; 0 for null and empty texts. Without target texts all weights are 0."""
    raw, want = gram_counts(docs, buckets, text), gram_counts(target, buckets, text)
    if want.sum() == 0:
        return docs.withColumn(output, F.lit(0.0))
    ratio = np.log((want + smooth) / (want.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    held = docs.drop(*[c for c in docs.columns if c.lower() == output.lower() and c != text])
    work = free_name(held, "weighed_text")
    schema = held.withColumn(output, F.lit(0.0)).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bucket, doc = gram_buckets(b.column(b.num_columns - 1), buckets)
        n = np.bincount(doc, minlength=b.num_rows)
        value = np.bincount(doc, sent.value[bucket], b.num_rows) / np.maximum(n, 1) * scale
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value)], names=[*b.schema.names[:-1], output])

    return held.withColumn(work, text_or_empty(text)).mapInArrow(per_batch(run, 256), schema)


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The ``k``-th largest value, exactly; None if there are fewer. Every round narrows the range to one of ``bins`` equal parts."""
    r = values.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if k <= 0 or r.n < k:
        return None
    lo, hi, left = r.lo, r.hi, k
    v = F.col(column)
    while hi > lo:
        width = (hi - lo) / bins
        b = F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = values.where(v.between(lo, hi)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for x in sorted(rows, key=lambda x: -x.b):
            if left <= x.n:
                break
            left -= x.n
        if (x.lo, x.hi) == (lo, hi):  # two neighbouring numbers: nothing lies between
            top = values.where(v == hi).count()
            return hi if left <= top else lo
        lo, hi = x.lo, x.hi
    return lo


def resample(docs: DataFrame, target: DataFrame, share: float = 0.85, text: str = "text", key: str = "doc_id", seed: int = 0, **options) -> DataFrame:
    """``docs`` with ``log_weight``, ``draw`` and ``kept``: the ``share`` of rows with the largest log weight plus Gumbel noise.

    The noise depends on ``key`` and text; rows equal in both share their fate, so repeated rows at the very threshold all
    stay. Null keys and texts are hashed as such.
    """
    noise = -F.log(-F.log(uniform(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), text_or_empty(text))))
    weighed = log_weights(docs, target, text=text, **options)
    weighed = weighed.withColumn("draw", F.col("log_weight") + noise)
    slim = written(weighed.select(F.col(key), "log_weight", "draw"), "draws")
    k = round(share * slim.count())
    least = kth_largest(slim, "draw", k)
    return slim.withColumn("kept", F.lit(k > 0) if least is None else F.col("draw") >= least)


def target_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", most: int = 20_000) -> DataFrame:
    """Documents labelled 1: at most ``most`` ids by a hash of the id, a broadcast of that bound."""
    ids = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(F.lit(5), F.col(key)), key).limit(most)
    return docs.join(F.broadcast(ids), key, "left_semi")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return resample(docs, target_documents(docs, labels))
