"""The verdict log, its mirrored telemetry, and append-only run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LAYER_FIELDS = ("key", "probability", "quality", "abstained", "scored", "role", "consulted", "share", "reason")
DETECTION_FIELDS = {"call_id": "string", "is_synthetic": "boolean", "confidence": "double", "acoustic_score": "double",
                    "behavioral_score": "double", "semantic_score": "double", "final_score": "double", "latency_ms": "double"}
SCORES = ("confidence", "acoustic_score", "behavioral_score", "semantic_score", "final_score")


def merge_layer_views(results: DataFrame, contributions: DataFrame) -> DataFrame:
    """What a layer measured over what the fusion made of it; where a call has no results, the contributions alone."""
    on = ["call_id", "key"]
    shared = [c for c in results.columns if c in contributions.columns and c not in on]
    c = contributions.withColumnsRenamed({s: f"__{s}" for s in shared})
    j = results.join(c, on, "left")
    merged = j.select(*on, *[F.coalesce(F.col(s), F.col(f"__{s}")).alias(s) for s in shared],
                      *[x for x in results.columns if x not in shared and x not in on],
                      *[x for x in contributions.columns if x not in shared and x not in on])
    alone = contributions.join(results.select("call_id").distinct(), "call_id", "left_anti")
    return merged.unionByName(alone, allowMissingColumns=True)


def layers_of_call(layers: DataFrame) -> DataFrame:
    """The layers of a call as one nested list, one entry per layer key however often it was logged."""
    fields = [c for c in LAYER_FIELDS if c in layers.columns]
    rest = [c for c in fields if c != "key"]
    once = layers.groupBy("call_id", "key").agg(F.max(F.struct(*rest)).alias("l")).select("call_id", "key", "l.*")
    return once.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("layers"))


def log_rows(verdicts: DataFrame, layers: DataFrame) -> DataFrame:
    """Verdicts as log rows, one per call, with their layers nested and the day they belong to."""
    v = F.when(~F.coalesce("decisive", F.lit(True)), "abstained").when(F.col("is_synthetic"), "synthetic").otherwise("human")
    return (verdicts.withColumn("verdict", v).join(layers_of_call(layers), "call_id", "left")
            .withColumnsRenamed({"call_id": "id"}).withColumn("date", F.to_date("at")))


def append_call_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("date").parquet(path)


def usable(prob: Column = None) -> Column:
    return ~F.coalesce("abstained", F.lit(False)) & F.coalesce("scored", F.lit(True))


def telemetry_view(layers: DataFrame) -> DataFrame:
    """One column per layer score, NULL where a layer abstained or was not asked."""
    p = F.when(usable(), F.bround("probability", 4))
    g = layers.withColumn("p", p).groupBy("call_id").pivot("key", ["acoustic", "behaviour", "semantic"]).agg(F.first("p", True))
    return g.withColumnsRenamed({"acoustic": "acoustic_score", "behaviour": "behavioral_score", "semantic": "semantic_score"})


def evidence_row(layers: DataFrame, calls: DataFrame) -> DataFrame:
    """The panel's three scores, 0 where there is none, and a bounded queue label."""
    t = telemetry_view(layers)
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return calls.join(t, "call_id", "left").select(
        "call_id", zero("acoustic_score", "acoustic"), zero("behavioral_score", "conversational"), zero("semantic_score", "semantic"),
        F.left(F.coalesce("queue", F.lit("api")), F.lit(40)).alias("queue"))


def parse_detections(events: DataFrame, body: str = "body") -> DataFrame:
    """Typed telemetry events with ``problem``: unknown or missing fields, scores outside [0, 1], negative latency."""
    schema = ", ".join(f"{n} {t}" for n, t in DETECTION_FIELDS.items())
    d = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(body)
    e = events.withColumns({"d": d, "keys": keys}).select(*events.columns, "d.*", "keys")
    unknown = F.size(F.array_except("keys", F.array(*[F.lit(n) for n in DETECTION_FIELDS]))) > 0
    out = F.lit(False)
    for s in SCORES:
        out = out | ~F.coalesce(F.col(s).between(0, 1), F.lit(True))
    # a field that is present but came out NULL had the wrong type
    wrong = F.lit(False)
    for n in DETECTION_FIELDS:
        raw = F.get_json_object(body, f"$.{n}")
        wrong = wrong | (raw.isNotNull() & F.col(n).isNull())
    problem = (F.when(F.col("keys").isNull(), "not_json").when(unknown, "unknown_field").when(wrong, "type")
               .when(F.coalesce(F.length("call_id"), F.lit(0)) == 0, "call_id").when(F.col("is_synthetic").isNull() | F.col("confidence").isNull(), "missing")
               .when(out, "range").when(F.col("latency_ms") < 0, "latency"))
    return e.withColumn("problem", problem).drop("keys")


def detection_sink(events: DataFrame, good: str, quarantine: str, body: str = "body") -> None:
    """Append valid events by day, stamped at ingest; the rest to quarantine with the reason."""
    p = parse_detections(events, body).withColumn("timestamp", F.current_timestamp())
    ok = p.where("problem is null").select("timestamp", *DETECTION_FIELDS, F.to_date("timestamp").alias("date"))
    ok.write.mode("append").partitionBy("date").parquet(good)
    p.where("problem is not null").select("timestamp", body, "problem").write.mode("append").parquet(quarantine)


def compact_manifest(rows: DataFrame, order: str = "created_at") -> DataFrame:
    """The last record of every sample."""
    cols = [c for c in rows.columns if c != "sample_id"]
    g = rows.groupBy("sample_id").agg(F.max_by(F.struct(*cols), F.struct(order, F.xxhash64(*cols))).alias("r"))
    return g.select("sample_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def write_manifest(rows: DataFrame, path: str) -> None:
    """All good samples, laid out so a split or a split and family is one folder."""
    compact_manifest(rows).where("status = 'ok'").write.mode("overwrite").partitionBy("split", "family").parquet(path)


def log_experiment(spark, path: str, title: str, **params) -> None:
    text = {k: f"{v:.4f}" if isinstance(v, float) else str(v) for k, v in params.items()}
    row = spark.createDataFrame([(title, text)], "title string, params map<string,string>")
    append_experiments(row, path)


def append_experiments(records: DataFrame, path: str) -> None:
    """``records(title, params map<string,string>)`` to the end of an experiment log, stamped with the time."""
    records.select(F.current_timestamp().alias("ts"), "title", "params").write.mode("append").parquet(path)
