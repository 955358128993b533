"""Mixing sources to target weights by balanced sampling (the cube method).

Every source has a target of words. A document is taken ``target / size of its source`` times on average: the whole part of
that number for sure, the fraction as an inclusion probability. The cube method turns the probabilities into
zeros and ones so that the number of documents and of words taken stay (nearly) at their expectations:

*Flight.* Three undecided documents at a time move along the one direction that changes neither total, until one of
them reaches 0 or 1. *Landing.* The last two have no such direction: the word total is let go first, then the rest
is drawn.

A source of any size is cut into blocks by a hash of the document; blocks fly on their own and leave two undecided
documents each. These fly on, in blocks of blocks, until one block is left per source, which lands. All draws are
hashes of ids and a seed, and a block is sorted before it flies, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import NOT_WHITE, comparable, free_name, table, text_or_empty, written


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text_or_empty(text), F.lit(NOT_WHITE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with ``target`` (double).

    Sources in order of code points, null last, weigh ``weights`` in turn and share all words; no target exceeds ``most``
    times the source's size, and what is cut off is shared by weight among the others until none exceeds it. That ends
    where every source gets ``least(cap, weight * level)`` for one level, which is found in a single ordered pass over the
    table of sources.
    """
    n = len(weights)
    every = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % n + 1).cast("int"))
    d = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    d = d.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    d = d.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, by ratio, that stays below its cap gives the level
    fits = F.when((F.col("level") > 0) & (F.col("level") * F.col("w") <= F.col("cap")), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))
    d = d.withColumn("fits", fits).withColumn("level", F.min("fits").over(whole)["level"])
    return d.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fly(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves probabilities ``p`` of units with sizes ``x`` until at most two are undecided; sums of ``p`` and of ``p * x`` stay."""
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    eps = 1e-9
    live: list[int] = []
    for nxt, d in enumerate(draws.tolist()):
        if p[nxt] <= eps or p[nxt] >= 1 - eps:
            p[nxt] = float(round(p[nxt]))
            continue
        live.append(nxt)
        if len(live) < 3:
            continue
        a, b, c = live
        # the direction that keeps both sums: orthogonal to (1, 1, 1) and to the three sizes
        u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(live, u) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(live, u) if v)
        step = up if d < down / (up + down) else -down
        for i, v in zip(live, u):
            p[i] += step * v
        still = []
        for i in live:
            if p[i] <= eps:
                p[i] = 0.0
            elif p[i] >= 1 - eps:
                p[i] = 1.0
            else:
                still.append(i)
        live = still
    return np.array(p)


def land(p: np.ndarray, x: np.ndarray, draws: np.ndarray, start: np.ndarray, most: int = 16) -> np.ndarray:
    """Decides the last units and brings the sum of sizes back to that of the probabilities ``start``.

    Two undecided units move against each other along the word total, the last one is drawn. What then is missing or too much
    is mended by turning over, at most ``most`` times, the unit whose change comes nearest to it.
    """
    p = p.astype(float).copy()
    undecided = lambda: [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    left = undecided()
    while len(left) >= 2:
        a, b = left[:2]
        va, vb = (1.0 / x[a], -1.0 / x[b]) if x[a] > 0 and x[b] > 0 else (1.0, -1.0)
        up, down = min((1 - p[a]) / va, p[b] / -vb), min(p[a] / va, (1 - p[b]) / -vb)
        step = up if draws[a] < down / (up + down) else -down
        p[a], p[b] = p[a] + step * va, p[b] + step * vb
        left = undecided()
    for i in left:
        p[i] = float(draws[i] < p[i])
    p = np.round(p)
    free = np.flatnonzero((start > 1e-9) & (start < 1 - 1e-9) & (x > 0))
    off = float(((p - start) * x).sum())
    for _ in range(most):
        change = np.where(p[free] > 0, -x[free], x[free])
        if not len(free):
            break
        k = int(np.argmin(np.abs(off + change)))
        if abs(off + change[k]) >= abs(off) - 1e-9:
            break
        off += change[k]
        p[free[k]] = 1 - p[free[k]]
    return p


def cube_sample(units: DataFrame, group: str, block: int = 4096, seed: int = 0) -> DataFrame:
    """``units(<group>, u1, u2, size, p)`` with ``taken`` (0 or 1): a balanced sample within each group.

    The two numbers ``u1, u2`` tell units apart. ``p`` outside 0 to 1 is clipped; null counts as 0.
    """
    d = units.select(F.col(group).alias("g"), "u1", "u2", F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("x"),
                     F.least(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("p"))
    schema = "g string, u1 bigint, u2 bigint, x double, p double, decided boolean"

    def pass_over(rows: DataFrame, counts: DataFrame, level: int) -> DataFrame:
        blocks = counts.select(F.col("g").alias("cg"), F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint").alias("blocks"))
        j = rows.join(blocks, rows["g"].eqNullSafe(blocks["cg"])).drop("cg")
        draw = lambda i: F.xxhash64(F.lit(seed), F.lit(level), F.lit(i), "u1", "u2")
        j = j.withColumn("b", F.pmod(draw(0), F.col("blocks"))).withColumn("r", draw(1)).withColumn("d", F.pmod(draw(2), F.lit(1 << 53)))

        def run(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(["r", "u1", "u2"])
            draws = (t["d"].to_numpy(float) + 0.5) / (1 << 53)
            start, x = t["p"].to_numpy(), t["x"].to_numpy()
            p = fly(start, x, draws)
            if t["blocks"].iat[0] == 1:
                p = land(p, x, draws, start)
            return pd.DataFrame({"g": t["g"], "u1": t["u1"], "u2": t["u2"], "x": t["x"], "p": p, "decided": (p == 0) | (p == 1)})

        return j.groupBy("g", "b").applyInPandas(run, schema)

    done, rest, level = None, d, 0
    counts = written(rest.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "cube-groups")
    while True:
        moved = written(pass_over(rest, counts, level), f"cube-{level}")
        part = moved.where("decided").select("g", "u1", "u2", F.col("p").cast("int").alias("taken"))
        done = part if done is None else done.unionByName(part)
        rest = moved.where(~F.col("decided")).drop("decided")
        counts = written(rest.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "cube-groups")
        if counts.isEmpty():
            return done.withColumnRenamed("g", group)
        level += 1


def identity(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row: rows that differ anywhere differ in them."""
    every = comparable(docs)
    every += [c.isNull() for c in every]
    return [F.xxhash64(*every).alias("u1"), F.xxhash64(F.lit(1), *every).alias("u2")]


def mix_units(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", most: float = 3.0, weights: tuple[float, ...] = (1, 2, 3),
              block: int = 4096, seed: int = 0) -> DataFrame:
    """One row per distinct input row: ``(u1, u2, doc_id, source, size, rows, source_size, target, times)``.

    ``rows`` equal input rows are one unit, which the mix holds ``times`` times in all. Null text has size 0, null
    sources are one source. A source without words has target 0 and none of its documents is taken.
    """
    units = docs.select(*identity(docs), F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    units = written(units.groupBy("u1", "u2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = written(source_targets(totals, most, weights), "targets").withColumnRenamed("source", "s")
    d = units.join(targets, units["source"].eqNullSafe(targets["s"])).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0) * F.col("rows")
    d = d.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    got = cube_sample(d.select("source", "u1", "u2", "size", (F.col("rate") - F.col("whole")).alias("p")), "source", block, seed).select("u1", "u2", "taken")
    return d.join(got, ["u1", "u2"]).select("u1", "u2", "doc_id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.col("taken")).cast("bigint").alias("times"))


def each_row(units: DataFrame) -> DataFrame:
    """Units back to rows: ``times`` becomes the share of one of the ``rows`` equal rows."""
    d = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    base = F.floor(F.col("times") / F.col("rows"))
    return d.withColumn("times", (base + (F.col("i") <= F.col("times") - base * F.col("rows")).cast("bigint")).cast("bigint")).drop("i", "rows")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its source's target asks for (options as in ``mix_units``)."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    u1, u2, n = (free_name(docs, c) for c in ("u1", "u2", "times"))
    times = mix_units(docs, **options).where("times > 0").select(F.col("u1").alias(u1), F.col("u2").alias(u2), F.col("times").alias(n))
    hashes = [c.alias(name) for c, name in zip(identity(docs), (u1, u2))]
    maps = [c for c in docs.columns if "map<" in docs.schema[c].dataType.simpleString()]
    plain = [F.col(f"`{c}`") for c in docs.columns if c not in maps]
    rows = docs.select("*", *hashes).groupBy(*plain, u1, u2).agg(F.count(F.lit(1)).alias(n), *[F.any_value(f"`{c}`").alias(c) for c in maps]).drop(n)
    held = rows.join(times, [u1, u2])
    return held.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).select(*names)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = each_row(mix_units(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
