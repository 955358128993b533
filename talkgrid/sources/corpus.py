"""Corpus tables: manifests, turn files, transcripts, rubrics, embeddings, score files.

Readers (``scan_*``) take a path; each hands over to a function on a DataFrame of file
contents, so the same parsing serves files, streams and tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.sampling import stratified_fraction

CALLS_SCHEMA = "anon_id string, label string, split string, duration_s double"
TURNS_SCHEMA = "turns array<struct<channel:int,start:double,end:double>>"
WORDS_SCHEMA = "words array<struct<text:string,start:double,end:double,type:string,logprob:double>>"
RUBRIC_SCHEMA = "scores map<string,struct<score:double,evidencia:string>>"


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


# ------------------------------------------------------------------------------ manifest

def manifest_calls(raw: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Manifest rows as ``calls``: label as 0/1, unreadable ids dropped."""
    c = raw.select(F.col("anon_id").alias("call_id"), "label", "split", "duration_s",
                   F.round(F.col("duration_s") * 1000).cast("bigint").alias("duration_ms"),
                   (F.col("label") == "synthetic").cast("int").alias("y"))
    return c.join(unreadable.select("call_id"), "call_id", "left_anti") if unreadable is not None else c


def scan_calls(spark: SparkSession, path: str, unreadable: DataFrame | None = None) -> DataFrame:
    return manifest_calls(spark.read.schema(CALLS_SCHEMA).csv(path, header=True), unreadable)


def validate_calls(calls: DataFrame, id_pattern: str = "^call_[0-9a-f]+$") -> DataFrame:
    """One row per contract rule with its number of violations."""
    d = F.col("duration_s")
    finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
    rules = {
        "missing_value": F.count_if(F.col("call_id").isNull() | F.col("label").isNull() | F.col("split").isNull() | d.isNull()),
        "bad_id": F.count_if(~F.col("call_id").rlike(id_pattern)),
        "bad_label": F.count_if(~F.col("label").isin("human", "synthetic")),
        "bad_split": F.count_if(~F.col("split").isin("train", "val")),
        "bad_duration": F.count_if(~finite | (d <= 0))}
    wide = calls.agg(*[c.alias(n) for n, c in rules.items()])
    dup = calls.groupBy("call_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return wide.unpivot([], list(rules), "rule", "violations").unionByName(dup.select(F.lit("duplicate_id").alias("rule"), "violations"))


def load_split(calls: DataFrame, split: str, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    s = calls.where(F.col("split") == split)
    return s if fraction >= 1 else stratified_fraction(s, "label", "call_id", fraction, seed)


# ------------------------------------------------------------------------------ turns

def parse_turns(files: DataFrame) -> DataFrame:
    """``(path, content)`` rows of turn files to one row per turn, seconds to integer milliseconds."""
    t = files.select(file_stem(F.col("path")).alias("call_id"), F.explode(F.from_json("content", TURNS_SCHEMA)["turns"]).alias("t"))
    ms = lambda c: F.round(c * 1000).cast("bigint")
    return t.select("call_id", "t.channel", F.col("t.start").alias("start_s"), F.col("t.end").alias("end_s"),
                    ms(F.col("t.start")).alias("start_ms"), ms(F.col("t.end")).alias("end_ms"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def scan_turns(spark: SparkSession, path: str) -> DataFrame:
    return parse_turns(read_texts(spark, path))


def check_turns(turns: DataFrame) -> DataFrame:
    """Adds ``reason``: why a turn cannot be used, NULL for a good one."""
    s, e = F.col("start_s"), F.col("end_s")
    odd = s.isNull() | e.isNull() | F.isnan(s) | F.isnan(e) | (F.abs(s) == float("inf")) | (F.abs(e) == float("inf"))
    return turns.withColumn("reason", F.when(~F.coalesce(F.col("channel").isin(0, 1), F.lit(False)), "channel")
                            .when(odd, "not_finite").when(~((s >= 0) & (s < e)), "order"))


def split_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good turns and quarantined ones."""
    c = check_turns(turns)
    return c.where("reason is null").drop("reason"), c.where("reason is not null")


# ------------------------------------------------------------------------------ transcripts and rubrics

def parse_words(files: DataFrame) -> DataFrame:
    """Cached transcripts named ``<call>_ch<channel>`` to word rows in time order."""
    stem = file_stem(F.col("path"))
    w = files.select(F.regexp_extract(stem, r"^(.*)_ch[01]$", 1).alias("call_id"),
                     F.regexp_extract(stem, r"_ch([01])$", 1).cast("int").alias("channel"),
                     F.posexplode(F.from_json("content", WORDS_SCHEMA)["words"]).alias("pos", "w"))
    return w.where(F.coalesce("w.type", F.lit("word")) == "word").select(
        "call_id", "channel", "pos", "w.text", F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), "w.logprob")


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    return parse_words(read_texts(spark, path))


def parse_rubric(files: DataFrame) -> DataFrame:
    """Cached rubrics named ``<call>_<model>_<prompt>`` to one row per dimension, scores clamped to [0, 1]."""
    stem = file_stem(F.col("path"))
    part = lambda i: F.regexp_extract(stem, r"^(call_[0-9a-f]+)_(.+)_([^_]+)$", i)
    r = files.select(part(1).alias("call_id"), part(2).alias("model"), part(3).alias("prompt"),
                     F.explode(F.from_json("content", RUBRIC_SCHEMA)["scores"]).alias("dimension", "s"))
    return r.select("call_id", "model", "prompt", "dimension",
                    F.least(F.greatest(F.col("s.score"), F.lit(0.0)), F.lit(1.0)).alias("score"), F.col("s.evidencia").alias("evidence"))


def scan_rubric(spark: SparkSession, path: str) -> DataFrame:
    return parse_rubric(read_texts(spark, path))


def pooled_embeddings(df: DataFrame, pooling: str = "mean") -> DataFrame:
    """Chunk vectors from stored ``mean_emb`` and ``std_emb``: the mean alone or both joined."""
    if pooling not in ("mean", "mean+std"):
        raise ValueError(f"unknown pooling {pooling}")
    emb = F.col("mean_emb") if pooling == "mean" else F.concat("mean_emb", "std_emb")
    return df.withColumn("emb", emb).drop("mean_emb", "std_emb")


def scan_chunk_embeddings(spark: SparkSession, path: str, layer: int, pooling: str = "mean") -> DataFrame:
    """One layer of the chunk vectors; the table is partitioned by layer, so the others are never read."""
    return pooled_embeddings(spark.read.parquet(path).where(F.col("layer") == layer), pooling)


# ------------------------------------------------------------------------------ score files and item sets

def first_source_wins(sources: Sequence[DataFrame], on: str = "call_id") -> DataFrame:
    """Rows of several sources in priority order; the first that knows a call answers for it."""
    out = None
    for i, s in enumerate(sources):
        d = s.withColumn("priority", F.lit(i))
        out = d if out is None else out.unionByName(d)
    cols = [c for c in out.columns if c not in (on, "priority")]
    best = out.groupBy(on).agg(F.min_by(F.struct(*cols), F.struct("priority", *cols)).alias("b"), F.min("priority").alias("source_rank"))
    return best.select(on, *[F.col(f"b.{c}").alias(c) for c in cols], "source_rank")


def domain_items(val: DataFrame, augmented: DataFrame, external: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Evaluation items per domain: validation calls, their line variants by family, external clips, stress conditions."""
    base = val.select(F.lit("validation").alias("domain"), F.col("call_id").cast("string").alias("item"), "y", F.lit(None).cast("string").alias("condition"))
    ok = augmented.where("status = 'ok' and split = 'val'").select(
        F.concat(F.lit("channel_"), F.col("family")).alias("domain"), F.col("sample_id").alias("item"), "y", F.lit(None).cast("string").alias("condition"))
    ext = external.select(F.explode(F.array(
        F.struct(F.lit("external").alias("domain"), F.lit(None).cast("string").alias("condition")),
        F.struct(F.lit("external_channel").alias("domain"), F.lit("unseen").alias("condition")))).alias("d"), F.col("item"), "y").select(
        "d.domain", "item", "y", "d.condition")
    cond = F.explode(F.array(*[F.lit(c) for c in conditions]))
    stress = val.select("call_id", "y", cond.alias("condition")).select(
        F.lit("stress").alias("domain"), F.concat_ws("|", F.col("call_id").cast("string"), "condition").alias("item"), "y", "condition")
    return base.unionByName(ok).unionByName(ext).unionByName(stress)


# ------------------------------------------------------------------------------ cached feature tables

def table_checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-free checksum of a table."""
    cols = [F.col(c) for c in (columns or sorted(df.columns))]
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("checksum"))


def feature_table_problems(features: DataFrame, calls: DataFrame, stored_config: dict, config: dict) -> DataFrame:
    """Why a cached feature table must not be used; no row when it may."""
    spark = features.sparkSession
    keys = ["call_id", "split", "y"]
    lost = calls.select(*keys).exceptAll(features.select(*keys)).select(F.lit("missing_or_changed").alias("problem"), F.col("call_id").cast("string"))
    extra = features.select(*keys).exceptAll(calls.select(*keys)).select(F.lit("unknown_or_changed").alias("problem"), F.col("call_id").cast("string"))
    out = lost.unionByName(extra)
    if stored_config != config:
        out = out.unionByName(spark.createDataFrame([("stale_config", None)], "problem string, call_id string"))
    return out
