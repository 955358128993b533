"""Deterministic samples, plans and draws: every random choice is a hash of ids and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import (AUGMENTATION_PLAN, CODEC_FAMILIES, LINE_CHANCE, LINE_CHOICE, LINE_SCALED, LINE_UNIFORM,
                               ONE_HOP_SHARE)
from ..functions.ordered import first_k, hash_rank
from ..functions.scalar import hash_uniform


def stratified_fraction(df: DataFrame, label: str, id_col: str, fraction: float, seed: int,
                        at_least: int = 2) -> DataFrame:
    """A seeded fraction of every label, exact in count and never below ``at_least``."""
    r = hash_rank(df, [label], id_col, seed)
    take = F.greatest(F.lit(at_least), F.bround(F.col("group_n") * fraction))
    return r.where(F.col("rank") <= take).drop("rank", "group_n")


def sample_per_class(df: DataFrame, label: str, id_col: str, n: int, seed: int) -> DataFrame:
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    return first_k(df, [label], [h, F.col(id_col)], n).drop("rank")


def balanced_head(df: DataFrame, label: str, id_col: str, limit: int) -> DataFrame:
    return first_k(df, [label], [F.col(id_col)], limit // 2).drop("rank")


def poisson_weights(df: DataFrame, id_col: str, repeats: int, seed: int) -> DataFrame:
    """Bootstrap weights: one Poisson(1) count per row and replicate, fixed by id, replicate and seed."""
    cdf, k, total = [], 0, 0.0
    while total < 1 - 1e-9:
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
        k += 1
    r = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = hash_uniform(F.col(id_col), F.col("replicate"), F.lit(seed))
    w = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    return r.withColumn("w", w)


def augmentation_plan(calls: DataFrame, done: DataFrame | None = None, plan=tuple(AUGMENTATION_PLAN)) -> DataFrame:
    """One row per planned sample (call x family x variant), those already made left out, seed from the sample id."""
    spark = calls.sparkSession
    p = spark.createDataFrame(list(plan), "split string, family string, variants int").where("variants > 0")
    rows = (calls.join(F.broadcast(p), "split")
            .withColumn("variant", F.explode(F.sequence(F.lit(0), F.col("variants") - 1))).drop("variants"))
    rows = rows.withColumn("sample_id", F.concat(F.col("call_id").cast("string"), F.lit("__"), "family", F.col("variant").cast("string")))
    identity = F.concat_ws("|", F.col("call_id").cast("string"), "family", F.col("variant").cast("string"))
    seed = F.conv(F.substring(F.sha2(identity, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    rows = rows.withColumn("seed", seed)
    return rows.join(done.select("sample_id").distinct(), "sample_id", "left_anti") if done is not None else rows


def uniform_draw(seed: Column, name: str, lo: float, hi: float) -> Column:
    return F.lit(lo) + hash_uniform(seed, F.lit(name)) * (hi - lo)


def categorical_draw(seed: Column, name: str, values: Sequence) -> Column:
    u = hash_uniform(seed, F.lit(name))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def draw_line_parameters(plan: DataFrame, severity: float = 1.0) -> DataFrame:
    """Seeded line parameters of every planned sample, each parameter from its own hash stream; ``severity`` scales the impairments, not the draws."""
    s = F.col("seed")

    def codec(i):
        pools = [F.when(F.col("family") == f, categorical_draw(s, f"codec{i}", c)) for f, c in CODEC_FAMILIES.items()]
        return F.coalesce(*pools)

    two = hash_uniform(s, F.lit("hops")) >= ONE_HOP_SHARE
    cols = {"codecs": F.when(two, F.concat_ws("+", codec(0), codec(1))).otherwise(codec(0))}
    cols |= {n: uniform_draw(s, n, *r) for n, r in LINE_UNIFORM.items()}
    cols |= {n: categorical_draw(s, n, v) for n, v in LINE_CHOICE.items()}
    cols |= {n: hash_uniform(s, F.lit(n)) < p for n, p in LINE_CHANCE.items()}
    cols |= {n: cols[n] * F.lit(float(severity)) for n in LINE_SCALED}
    return plan.withColumns(cols | {"severity": F.lit(float(severity))})


def best_model(results: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Best row by worst AUC, then worst accuracy, then least worst Brier, each at its rounding."""
    r = results.where(F.col("domain").isin(*domains)) if domains else results
    g = r.groupBy("model").agg(F.bround(F.min("auc"), 4).alias("worst_auc"),
                               F.bround(F.min("accuracy"), 4).alias("worst_accuracy"),
                               F.bround(F.max("brier"), 5).alias("worst_brier"))
    return g.orderBy(F.desc("worst_auc"), F.desc("worst_accuracy"), F.asc("worst_brier"), "model").limit(1)


def best_within(table: DataFrame, key: str, band: float, *tie_breaks: Column) -> DataFrame:
    """Among the rows within ``band`` of the best ``key``, the first by the tie breaks."""
    top = table.agg(F.max(key).alias("__top"))
    return (table.join(F.broadcast(top)).where(F.col(key) >= F.col("__top") - band).drop("__top")
            .orderBy(*tie_breaks).limit(1))
