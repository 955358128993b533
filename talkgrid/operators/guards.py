"""Data-quality guards: each returns the offending rows, so an empty result means the rule holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import safe_div  # noqa: F401


def calls_in_two_splits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("call_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def changed_split_or_label(derived: DataFrame, calls: DataFrame) -> DataFrame:
    j = derived.join(calls.select("call_id", F.col("split").alias("own_split"), F.col("label").alias("own_label")), "call_id")
    return j.where((F.col("split") != F.col("own_split")) | (F.col("label") != F.col("own_label")))


def held_out_family_in_training(rows: DataFrame, families: list[str]) -> DataFrame:
    return rows.where((F.col("split") == "train") & F.col("family").isin(*families))


def bad_sample_ids(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Sample ids used twice, not spelling out where they come from, or of unknown calls."""
    want = F.concat(F.col("call_id").cast("string"), F.lit("__"), "family", F.col("variant").cast("string"))
    twice = rows.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("duplicate").alias("problem"))
    wrong = rows.where(F.col("sample_id") != want).select("sample_id", F.lit("origin").alias("problem"))
    lost = rows.join(calls.select("call_id"), "call_id", "left_anti").select("sample_id", F.lit("unknown_call").alias("problem"))
    return twice.unionByName(wrong).unionByName(lost)


def classes_lost(rows: DataFrame, by=("split", "family")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_distinct("label").alias("classes")).where("classes < 2")


def planned_but_missing(plan: DataFrame, made: DataFrame, tolerance_s: float = 0.05) -> DataFrame:
    """Planned samples nobody made, and made ones whose length is off."""
    lost = plan.join(made.select("sample_id"), "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("problem"))
    j = plan.select("sample_id", F.col("duration_s").alias("want")).join(made.select("sample_id", "duration_s"), "sample_id")
    off = j.where(F.abs(F.col("want") - F.col("duration_s")) > tolerance_s).select("sample_id", F.lit("duration").alias("problem"))
    return lost.unionByName(off)


def duration_errors(calls: DataFrame, real: DataFrame, turns: DataFrame) -> DataFrame:
    """How far the manifest is off, and how far turns run past the end of the recording."""
    last = turns.groupBy("call_id").agg((F.max("end_ms") / 1000).alias("last_end_s"))
    j = calls.select("call_id", F.col("duration_s").alias("manifest_s")).join(real.select("call_id", F.col("duration_s").alias("real_s")), "call_id").join(last, "call_id", "left")
    return j.select("call_id", F.abs(F.col("manifest_s") - F.col("real_s")).alias("duration_error_s"),
                    F.greatest(F.lit(0.0), F.col("last_end_s") - F.col("real_s")).alias("turns_past_end_s"))


# ------------------------------------------------------------------------------ set operations

def split_overlap(rows: DataFrame) -> DataFrame:
    ids = lambda s: rows.where(F.col("split") == s).select("call_id")
    return ids("train").intersect(ids("val"))


def id_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids only one of two tables holds."""
    x, y = a.select("call_id"), b.select("call_id")
    return x.exceptAll(y).withColumn("only_in", F.lit("left")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("right")))


def content_duplicates(rows: DataFrame, content: str, digest: str = "md5") -> DataFrame:
    """Contents that occur more than once, by digest."""
    h = F.md5(F.col(content)) if digest == "md5" else F.sha2(F.col(content), 256)
    return rows.groupBy(h.alias("digest")).agg((F.count(F.lit(1)) - 1).alias("duplicates")).where("duplicates > 0")


def top_errors(scored: DataFrame, k: int = 8, threshold: float = 0.5) -> DataFrame:
    """The wrong calls among the ``k`` farthest from their label."""
    top = scored.withColumn("error", F.abs(F.col("p") - F.col("y"))).orderBy(F.desc("error"), "call_id").limit(k)
    return top.where((F.col("p") >= threshold) != (F.col("y") == 1))


def union_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out
