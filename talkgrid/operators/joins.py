"""Joins with the checks and rules the corpus needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import hash_rank, scan, value_block
from .vectors import near_duplicates, nearest_train_neighbour  # noqa: F401


def one_to_one(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails, inside the job, on a key either side holds twice."""
    on = list(on)

    def checked(d, side):
        n = d.groupBy(*on).agg(F.count(F.lit(1)).alias(f"__{side}"), *[F.first(c).alias(c) for c in d.columns if c not in on])
        once = F.when(F.col(f"__{side}") > 1, F.raise_error(F.lit(f"duplicate key on the {side} side"))).otherwise(F.col(f"__{side}"))
        return n.withColumn(f"__{side}", once)

    j = checked(a, "left").join(checked(b, "right"), on)
    return j.where((F.col("__left") == 1) & (F.col("__right") == 1)).drop("__left", "__right")


def left_filled(calls: DataFrame, scores: DataFrame, on: str, fill: dict) -> DataFrame:
    return calls.join(scores, on, "left").fillna(fill)


def missing(calls: DataFrame, have: DataFrame, on: str = "call_id") -> DataFrame:
    return calls.join(have.select(on).distinct(), on, "left_anti")


def held(rows: DataFrame, calls: DataFrame, on: str = "call_id") -> DataFrame:
    return rows.join(calls.select(on).distinct(), on, "left_semi")


MAX_PARAMETERS = 100_000


def with_parameters(df: DataFrame, params: Sequence[tuple], schema: str) -> DataFrame:
    """Every row under every parameter set of a driver-made list of checked length."""
    if len(params) > MAX_PARAMETERS:
        raise ValueError(f"{len(params)} parameter sets; at most {MAX_PARAMETERS} are broadcast")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(params), schema)))


def matched_pairs(a: DataFrame, b: DataFrame, value: str, tolerance: float, id_col: str = "call_id") -> DataFrame:
    """Pairs of nearest values within ``tolerance``, each row used once.

    Rounds of mutual best choice over the *distinct values* of both sides: equal values pair up
    first, then values that name each other as nearest pair as many of their rows as both have
    left, until a round adds none. Rows only come in at the end, by their number within their value.
    Each round goes to the checkpoint folder.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(a.sparkSession)
    v = F.col(value).cast("double")
    rows = (a.select(F.col(id_col).alias("id"), v.alias("v"), F.lit(0).alias("side"))
            .unionByName(b.select(F.col(id_col).alias("id"), v.alias("v"), F.lit(1).alias("side"))))
    count = lambda s: F.count_if(F.col("side") == s)
    zero = F.lit(0).cast("bigint")
    state = rows.groupBy("v").agg(count(0).alias("l0"), count(1).alias("l1"))
    both = F.least("l0", "l1")
    matches = state.where(both > 0).select(F.col("v").alias("va"), F.col("v").alias("vb"), both.alias("k"), zero.alias("oa"), zero.alias("ob"))
    state = state.select("v", (F.col("l0") - both).alias("l0"), (F.col("l1") - both).alias("l1"), both.alias("o")).where("l0 + l1 > 0").checkpoint()

    def nearest(d, sign):
        """The closest value of the other side on one side of each value."""
        x = d.withColumns({"all": F.lit(0), "x": F.col("v") * sign})
        x = x.withColumns({"v0": F.when(F.col("l0") > 0, F.col("v")), "v1": F.when(F.col("l1") > 0, F.col("v"))})
        r = scan(x, ["all"], value_block(F.col("x")), ["x"], {"p0": ("last", "v0"), "p1": ("last", "v1")}, inclusive=False)
        return r.select("v", "l0", "l1", "o", F.when(F.col("l0") > 0, F.col("p1")).otherwise(F.col("p0")).alias("w"))

    while True:  # every round pairs at least the two nearest values, so it ends
        n = nearest(state, 1).unionByName(nearest(state, -1)).withColumn("d", F.abs(F.col("v") - F.col("w"))).where(F.col("d") <= tolerance)
        best = n.groupBy("v").agg(F.min_by("w", F.struct("d", "w")).alias("w"), F.max("l0").alias("l0"), F.max("l1").alias("l1"), F.max("o").alias("o"))
        l = best.where("l0 > 0").select(F.col("v").alias("va"), F.col("w").alias("vb"), F.col("l0").alias("na"), F.col("o").alias("oa"))
        r = best.where("l1 > 0").select(F.col("w").alias("va"), F.col("v").alias("vb"), F.col("l1").alias("nb"), F.col("o").alias("ob"))
        got = l.join(r, ["va", "vb"]).select("va", "vb", F.least("na", "nb").alias("k"), "oa", "ob").checkpoint()
        if not got.limit(1).count():
            break
        matches = matches.unionByName(got)
        used = got.select(F.explode(F.array("va", "vb")).alias("v"), "k")
        state = state.join(used, "v", "left").fillna(0, subset=["k"])
        less = lambda c: F.when(F.col(c) > 0, F.col(c) - F.col("k")).otherwise(0)
        state = state.select("v", less("l0").alias("l0"), less("l1").alias("l1"), (F.col("o") + F.col("k")).alias("o")).where("l0 + l1 > 0").checkpoint()

    ranked = hash_rank(rows, ["side", "v"], "id", 0)

    def members(side, val, off):
        m = ranked.where(F.col("side") == side).join(matches.withColumn("v", F.col(val)), "v")
        m = m.where((F.col("rank") > F.col(off)) & (F.col("rank") <= F.col(off) + F.col("k")))
        return m.select("va", "vb", "oa", (F.col("rank") - F.col(off)).alias("i"), F.col("id"))

    j = members(0, "va", "oa").withColumnRenamed("id", "a_id").join(members(1, "vb", "ob").withColumnRenamed("id", "b_id"), ["va", "vb", "oa", "i"])
    return j.select("a_id", "b_id", F.abs(F.col("va") - F.col("vb")).alias("d"))
