"""Registries: detection layers as functions on tables, aggregations and perturbations by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import hash_uniform
from .scoring import AGGREGATIONS, call_scores

LAYER_SCHEMA = "call_id {kind}, key string, probability double, quality double, abstained boolean, scored boolean, reason string, latency_ms double"


def layer(key: str, score: Callable[[pd.DataFrame], tuple[float, float]] | None) -> Callable[[DataFrame], DataFrame]:
    """A detection layer from ``score(rows of one call) -> (probability, quality)``.

    A layer that is not available, or fails on a call, abstains with the reason; it never breaks
    the verdict of the others. ``calls`` holds one row per call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                start = time.perf_counter()
                try:
                    p, q = score(row)
                    r = (row["call_id"], key, float(p), float(q), False, True, "")
                except Exception as exc:  # noqa: BLE001 - a failing layer abstains
                    r = (row["call_id"], key, 0.5, 0.0, True, True, f"{type(exc).__name__}: {exc}")
                out.append(r + ((time.perf_counter() - start) * 1000,))
            yield pd.DataFrame(out, columns=["call_id", "key", "probability", "quality", "abstained", "scored", "reason", "latency_ms"])

    def apply(calls: DataFrame) -> DataFrame:
        if score is None:
            blank = calls.select("call_id", F.lit(key).alias("key"), F.lit(0.5).alias("probability"), F.lit(0.0).alias("quality"), F.lit(True).alias("abstained"),
                                 F.lit(False).alias("scored"), F.lit("not available").alias("reason"), F.lit(0.0).alias("latency_ms"))
            return blank
        return calls.mapInPandas(run, LAYER_SCHEMA.format(kind=calls.schema["call_id"].dataType.simpleString()))

    return apply


def expression_layer(key: str, probability: Column, quality: Column) -> Callable[[DataFrame], DataFrame]:
    """The same from column expressions; a NULL probability abstains."""
    def apply(calls: DataFrame) -> DataFrame:
        blank = probability.isNull()
        return calls.select("call_id", F.lit(key).alias("key"), F.coalesce(probability, F.lit(0.5)).alias("probability"),
                            F.when(blank, 0.0).otherwise(quality).alias("quality"), blank.alias("abstained"), F.lit(True).alias("scored"),
                            F.when(blank, "no evidence").otherwise("").alias("reason"), F.lit(0.0).alias("latency_ms"))
    return apply


def score_all(calls: DataFrame, layers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    out = None
    for run in layers:
        s = run(calls)
        out = s if out is None else out.unionByName(s)
    return out


def aggregate_by_name(chunks: DataFrame, method: str) -> DataFrame:
    """Any registered aggregation under one column name."""
    if method not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {method}; one of {sorted(AGGREGATIONS)}")
    return call_scores(chunks, [method]).withColumnRenamed(method, "score")


def _drop_frames(share: float):
    return lambda df: df.where(hash_uniform(F.col("call_id"), F.col("channel"), F.col("frame_idx"), F.lit("drop")) >= share)


def _noise(scale: float):
    return lambda df: df.withColumn("score", F.col("score") + (hash_uniform(F.col("call_id"), F.col("chunk"), F.lit("noise")) - 0.5) * 2 * scale)


def _gain(db: float):
    return lambda df: df.withColumn("rms_db", F.col("rms_db") + db)


#: perturbation registry: name -> transform of a frame or chunk table
PERTURBATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "clean": lambda df: df, "drop_frames_5": _drop_frames(0.05), "gain_-12dB": _gain(-12.0), "score_noise": _noise(0.5)}


def perturbed(df: DataFrame, names: list[str]) -> DataFrame:
    """The table under every named perturbation, one ``condition`` each."""
    out = None
    for n in names:
        d = PERTURBATIONS[n](df).withColumn("condition", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out
