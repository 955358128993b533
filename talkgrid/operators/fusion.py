"""Fusing what several detection layers say about a call.

``layer_scores(call_id, key, probability, quality, abstained, scored, latency_ms)`` meets a
table of configurations; the whole two-stage decision of a call under a configuration is one
grouped aggregation, so re-deciding a corpus under many configurations is one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalar import clamp, logit, safe_div, sigmoid

CONFIG_SCHEMA = ("config_id string, weights map<string,double>, roles map<string,string>, mode string, on_abstain string, "
                 "use_quality boolean, threshold double, confidence_mode string, verify_threshold double, use_verifiers boolean")
# fixed values: what a configuration says when it says nothing
BASE = {"weights": {"acoustic": 0.5, "behaviour": 0.5, "semantic": 0.15},
        "roles": {"acoustic": "primary", "behaviour": "primary", "semantic": "verifier"},
        "mode": "weighted_mean", "on_abstain": "renormalise", "use_quality": False, "threshold": 0.5,
        "confidence_mode": "verdict", "verify_threshold": 0.80, "use_verifiers": True}
FIELDS = list(BASE)
MAX_CONFIGS = 10_000


def config_rows(spark: SparkSession, configs: Iterable[dict]) -> DataFrame:
    """Candidate configurations as given, absent fields NULL."""
    rows = [tuple([c.get("config_id", f"c{i}")] + [c.get(f) for f in FIELDS]) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def complete_configs(spark: SparkSession, partial: DataFrame) -> DataFrame:
    """Partial configurations completed from the base row; map entries override key by key. Adds ``invalid``."""
    base = config_rows(spark, [BASE]).select(*[F.col(f).alias(f"__{f}") for f in FIELDS])
    j = partial.join(F.broadcast(base))  # one row
    empty = {"weights": F.create_map().cast("map<string,double>"), "roles": F.create_map().cast("map<string,string>")}

    def field(f):
        if f in ("weights", "roles"):
            own = F.coalesce(f, empty[f])
            kept = F.map_filter(f"__{f}", lambda k, v: ~F.map_contains_key(own, k))
            return F.map_concat(kept, own)
        return F.coalesce(f, f"__{f}")

    c = j.select("config_id", *[field(f).alias(f) for f in FIELDS])
    bad_weight = F.exists(F.map_values("weights"), lambda w: w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")))
    bad_role = F.exists(F.map_values("roles"), lambda r: ~r.isin("primary", "verifier"))
    reason = (F.when(~F.col("mode").isin("weighted_mean", "logit_mean"), "mode")
              .when(~F.col("on_abstain").isin("renormalise", "neutral"), "on_abstain")
              .when(~((F.col("threshold") > 0) & (F.col("threshold") < 1)), "threshold")
              .when(~F.col("confidence_mode").isin("verdict", "synthetic"), "confidence_mode")
              .when(bad_weight, "weights").when(bad_role, "roles")
              .when(~F.col("verify_threshold").between(0.5, 1.0), "verify_threshold"))
    return c.withColumn("invalid", reason)


def valid_configs(spark: SparkSession, configs: Iterable[dict]) -> DataFrame:
    configs = list(configs)
    if len(configs) > MAX_CONFIGS:
        raise ValueError(f"{len(configs)} configurations: broadcast only up to {MAX_CONFIGS}, split the list")
    return complete_configs(spark, config_rows(spark, configs)).where("invalid is null").drop("invalid")


def contributions(layers: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per call, configuration and layer with its effective weight before the gate.

    ``configs`` is a parameter table of at most :data:`MAX_CONFIGS` rows.
    """
    j = layers.join(F.broadcast(configs))
    p = F.when(F.col("abstained"), 0.5).otherwise(clamp(F.col("probability"), 0.0, 1.0))
    return j.withColumns({"p": p, **_weights()})


def _weights() -> dict[str, Column]:
    """Weights and role of a layer under the settings of its row."""
    raw = F.coalesce(F.try_element_at("weights", F.col("key")), F.lit(0.0))
    dropped = F.col("abstained") & (F.col("on_abstain") == "renormalise")
    effective = (F.when(dropped | ~F.col("scored"), 0.0)
                 .otherwise(raw * F.when(F.col("use_quality"), F.col("quality")).otherwise(1.0)))
    role = F.coalesce(F.try_element_at("roles", F.col("key")), F.lit("primary"))
    return {"weight": raw, "effective_weight": effective, "layer_role": role}


def combine(layers: DataFrame, configs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The verdict of every call under every configuration.

    Primaries decide first; verifiers join only when the primaries stay below the verify
    threshold, or when the gate is off. ``extra`` columns of the layer table are kept per call.
    The few layers of a call are dealt by it before they meet the configurations, so that what is shuffled does not grow with these.
    """
    c = contributions(layers.repartition("call_id", *extra), configs)
    x = F.when(F.col("mode") == "logit_mean", logit(F.col("p"))).otherwise(F.col("p"))
    first = F.col("layer_role") == "primary"
    w = F.col("effective_weight")
    knobs = ["mode", "threshold", "confidence_mode", "verify_threshold", "use_verifiers"]
    g = c.groupBy("call_id", "config_id", *extra).agg(
        F.sum(F.when(first, w).otherwise(0.0)).alias("pw"), F.sum(F.when(first, w * x).otherwise(0.0)).alias("px"),
        F.sum(F.when(first, 0.0).otherwise(w)).alias("vw"), F.sum(F.when(first, 0.0).otherwise(w * x)).alias("vx"),
        F.count_if(first & (w > 0)).alias("np"), F.count_if(~first & (w > 0)).alias("nv"),
        F.count_if(~first).alias("verifiers"), F.bool_and("abstained").alias("all_abstained"))
    # the settings come back by their id: text carried through an aggregation would make it sort
    g = g.join(F.broadcast(configs.select("config_id", *knobs)), "config_id")

    def mixed(xs, ws):
        m = safe_div(xs, ws)
        return F.coalesce(F.when(F.col("mode") == "logit_mean", sigmoid(m)).otherwise(m), F.lit(0.5))

    g = g.withColumn("primary_p", mixed(F.col("px"), F.col("pw")))
    pc = F.when(F.col("pw") > 0, F.greatest(F.col("primary_p"), 1 - F.col("primary_p"))).otherwise(0.0)
    g = g.withColumn("primary_confidence", pc)
    # 12 digits: the order in which partial sums meet must not decide a tie with a threshold
    g = g.withColumn("settled", (F.col("pw") > 0) & (F.round(pc, 12) >= F.col("verify_threshold")))
    gate = (F.col("verifiers") > 0) & F.col("use_verifiers")
    g = g.withColumns({"gate_on": gate, "consult": (F.col("verifiers") > 0) & (~gate | ~F.col("settled"))})
    total = F.col("pw") + F.when(F.col("consult"), F.col("vw")).otherwise(0.0)
    sums = F.col("px") + F.when(F.col("consult"), F.col("vx")).otherwise(0.0)
    decisive = total > 0
    g = g.withColumns({"p": mixed(sums, total), "decisive": decisive,
                       "n_layers_used": F.when(decisive, F.col("np") + F.when(F.col("consult"), F.col("nv")).otherwise(0)).otherwise(0)})
    conf = F.when(F.col("confidence_mode") == "verdict", F.greatest(F.col("p"), 1 - F.col("p"))).otherwise(F.col("p"))
    note = (F.when(~decisive & F.col("all_abstained"), "every layer abstained").when(~decisive, "no layer carries weight")
            .when(~F.col("gate_on"), "").when(F.col("settled"), "settled by the primaries").otherwise("verifier consulted"))
    return g.select(
        "call_id", "config_id", *extra, F.bround("p", 6).alias("p"),
        F.when(decisive, F.round("p", 12) >= F.col("threshold")).otherwise(False).alias("is_synthetic"),
        F.bround(F.when(decisive, conf).otherwise(0.5), 4).alias("confidence"), "decisive", "n_layers_used",
        F.bround("primary_p", 6).alias("primary_p"), F.bround("primary_confidence", 4).alias("primary_confidence"),
        "settled", (F.col("consult") & decisive).alias("verifiers_consulted"), note.alias("note"))


def layer_shares(layers: DataFrame, configs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of every layer in the verdict it took part in.

    A call's few layers travel once, as a list, and are weighed next to each verdict of the call.
    """
    own = layers.groupBy("call_id").agg(F.collect_list(F.struct("key", "quality", "abstained", "scored")).alias("layers"))
    settings = F.broadcast(configs.select("config_id", "weights", "roles", "on_abstain", "use_quality"))
    v = verdicts.select("call_id", "config_id", "verifiers_consulted").join(own, "call_id")
    c = v.select("call_id", "config_id", "verifiers_consulted", F.inline("layers")).join(settings, "config_id").withColumns(_weights())
    out = (F.col("layer_role") == "verifier") & ~F.col("verifiers_consulted")
    c = c.select("call_id", "config_id", "key", "layer_role", "weight", F.when(out, 0.0).otherwise(F.col("effective_weight")).alias("w"))
    total = F.sum("w").over(W.partitionBy("call_id", "config_id"))
    return c.select("call_id", "config_id", "key", F.col("layer_role").alias("role"), "weight", F.coalesce(safe_div(F.col("w"), total), F.lit(0.0)).alias("share"))


def verification_worklist(layers: DataFrame, verdicts: DataFrame, verifier_keys: Sequence[str], held_out: DataFrame,
                          use_verifiers: bool = True) -> DataFrame:
    """Calls whose verifier must be asked: unsettled (all of them without a gate) and not answered for free."""
    todo = verdicts.where(~F.col("settled")) if use_verifiers else verdicts
    k = todo.select("call_id", F.explode(F.array(*[F.lit(v) for v in verifier_keys])).alias("key")).distinct()
    scored = layers.where(F.col("scored")).select("call_id", "key")
    return k.join(scored, ["call_id", "key"], "left_anti").join(held_out.select("call_id", "key"), ["call_id", "key"], "left_anti")


def weight_sweep(layers: DataFrame, labels: DataFrame, a: str, b: str, steps: int) -> DataFrame:
    """Metrics for every split of the weight between two layers, in one job."""
    spark = layers.sparkSession
    grid = [{"config_id": f"{i:04d}", "weights": {a: i / (steps - 1), b: 1 - i / (steps - 1)}} for i in range(steps)]
    v = combine(layers.where(F.col("key").isin(a, b)), valid_configs(spark, grid))
    return fusion_metrics(v, labels).withColumn("weight", F.col("config_id").cast("int") / (steps - 1))


def fusion_metrics(verdicts: DataFrame, labels: DataFrame, by: Sequence[str] = ("config_id",)) -> DataFrame:
    v = verdicts.join(labels.select("call_id", "y"), "call_id")
    pos, pred = F.col("y") == 1, F.col("is_synthetic")
    fp, tn = F.count_if(~pos & pred), F.count_if(~pos & ~pred)
    fn, tp = F.count_if(pos & ~pred), F.count_if(pos & pred)
    return v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((pred == pos).cast("double")).alias("accuracy"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
        safe_div(fp, fp + tn).alias("fpr"), safe_div(fn, fn + tp).alias("fnr"),
        F.count_if("verifiers_consulted").alias("n_verifier_consulted"), F.count_if("settled").alias("n_settled"),
        F.count_if(~F.col("decisive")).alias("n_abstained"))


def layer_only(layers: DataFrame, calls: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """What each layer would decide alone: over the calls it answered, and over all with a 0.5 fallback."""
    from .metrics import roc_auc
    every = calls.select("call_id", "y", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    j = every.join(layers.select("call_id", "key", "probability", "abstained"), ["call_id", "key"], "left")
    blank = F.coalesce(F.col("abstained"), F.lit(True))
    j = j.withColumns({"answered": ~blank, "p": F.when(blank, 0.5).otherwise(F.col("probability"))})
    ok = ((F.col("p") >= threshold) == (F.col("y") == 1)).cast("double")
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    g = j.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("answered").alias("n_answered"), F.avg(ok).alias("accuracy_forced"), F.avg(sq).alias("brier"),
        F.avg(F.when(F.col("answered"), ok)).alias("accuracy"), F.avg(F.when(F.col("answered"), sq)).alias("brier_answered"))
    return g.join(roc_auc(j.where("answered"), ["key"], "p"), "key", "left")


def equal_weights(layers: DataFrame) -> DataFrame:
    """Every layer of a call the same weight and no gate: the plain mean of what answered."""
    n = F.count(F.lit(1))
    ok = ~F.col("abstained") & F.col("scored")
    p = F.avg(F.when(ok, clamp(F.col("probability"), 0.0, 1.0)))
    return layers.groupBy("call_id").agg((1 / n).alias("weight"), F.bround(F.coalesce(p, F.lit(0.5)), 6).alias("p"),
                                         F.coalesce(F.round(p, 12) >= 0.5, F.lit(False)).alias("is_synthetic"))  # noise decides no verdict


def simple_weighted(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the available modality columns; NULL when none is."""
    num = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return scores.withColumn("p", clamp(safe_div(num, den), 0.0, 1.0))


def meta_features(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only calls with every modality reach a stacked model."""
    return scores.dropna(subset=list(keys))
