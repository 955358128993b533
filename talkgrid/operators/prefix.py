"""How early could we have known: running verdicts over the chunks of a call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import first_k, quantiles, running_positions, scan
from ..functions.scalar import calibrate, is_confident, known_mean, logit, safe_div, sigmoid
from ..session import checkpoint_dir
from .intervals import CALL

CHUNK_BLOCK = 1024
RUNNING = ("mean", "max", "min", "mean_prob", "duration_weighted")


def progression(chunks: DataFrame, aggregation: str = "mean", a: float = 1.0, b: float = 0.0, hi: float = 0.85,
                lo: float = 0.15) -> DataFrame:
    """After every chunk: the call score of the chunks so far, both clocks, and whether it is a commitment."""
    if aggregation not in RUNNING:
        return prefix_progression(chunks, aggregation, a, b, hi, lo)
    s, d = F.col("score"), F.col("end_s") - F.col("start_s")
    c = chunks.select("call_id", F.col("chunk").cast("bigint").alias("chunk"), "start_s", "end_s", "score", d.alias("dur"),
                      sigmoid(s, None).alias("ps"), (s * d).alias("sd"), F.lit(1).alias("one"))
    specs = {"n": ("sum", "one"), "speech": ("sum", "dur")}
    specs |= {"mean": {"acc": ("sum", "score")}, "max": {"acc": ("max", "score")}, "min": {"acc": ("min", "score")},
              "mean_prob": {"acc": ("sum", "ps")}, "duration_weighted": {"acc": ("sum", "sd")}}[aggregation]
    r = scan(c, CALL, F.floor(F.col("chunk") / CHUNK_BLOCK), ["chunk"], specs)
    acc, n = F.col("acc"), F.col("n")
    running = {"mean": acc / n, "max": acc, "min": acc, "mean_prob": logit(acc / n),
               "duration_weighted": acc / F.greatest(F.col("speech"), F.lit(1e-9))}[aggregation]
    return _steps(r.withColumn("running", running), a, b, hi, lo)


#: Calls of at most this many chunks have their prefixes sorted in one window; longer ones are searched in rounds.
SHORT_CALL = 128


def prefix_progression(chunks: DataFrame, aggregation: str, a: float, b: float, hi: float, lo: float) -> DataFrame:
    """The same for order statistics, which no running sum gives: the scores at one or two sorted positions of every prefix.

    Prefixes of short calls are sorted where they are, those of longer ones found by :func:`running_positions`, so a call may be of any length and hold any
    share of the chunks. Missing scores count for nothing.
    """
    if aggregation not in ("median", "top25_mean", "trimmed_mean"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    dur, score = F.col("end_s") - F.col("start_s"), F.nanvl(F.col("score").cast("double"), F.lit(None))
    c = chunks.select("call_id", F.col("chunk").cast("bigint").alias("chunk"), "start_s", "end_s", "score", dur.alias("dur"), score.alias("value"))
    c = c.where("call_id is not null and chunk is not null")
    m = F.col("m")
    if aggregation == "median":
        asked = {"low": F.floor((m - 1) / 2), "high": F.floor(m / 2)}
    elif aggregation == "top25_mean":
        asked = {"low": m - F.greatest(F.lit(1), F.ceil(m / 4))}
    else:
        asked = {"low": F.floor(m / 10), "high": F.when(m >= 10, m - F.floor(m / 10))}
    asked = {t: F.when(m > 0, p).cast("bigint") for t, p in asked.items()}
    checkpoint_dir(c.sparkSession)
    many = c.groupBy(*CALL).count().where(F.col("count") > SHORT_CALL).select(*CALL).checkpoint()
    if many.isEmpty():
        j = _short_prefixes(c, asked)
    else:
        j = _short_prefixes(c.join(many, CALL, "left_anti"), asked).unionByName(_long_prefixes(c.join(many, CALL, "left_semi"), asked))
    if aggregation == "median":
        running = F.when(F.col("low_at") == F.col("high_at"), F.col("low_at")).otherwise(F.col("low_at") + (F.col("high_at") - F.col("low_at")) * 0.5)
    elif aggregation == "top25_mean":
        running = (F.col("total") - F.col("low_below")) / (m - F.col("at_low"))
    else:
        running = (F.coalesce("high_below", "total") - F.col("low_below")) / (F.coalesce("at_high", "m") - F.col("at_low"))
    return _steps(j.withColumn("running", F.when(m > 0, running)), a, b, hi, lo)


def _prefixes(d: DataFrame, asked: dict[str, Column]) -> DataFrame:
    kept = ["call_id", "chunk", "start_s", "end_s", "score", "speech", "m", "total"]
    return d.select(*kept, *[f"at_{t}" for t in asked], *[f"{t}_{c}" for t in asked for c in ("at", "below")])


def _short_prefixes(c: DataFrame, asked: dict[str, Column]) -> DataFrame:
    """Known scores of every prefix in order, at most ``SHORT_CALL``, and what they hold at the positions asked for."""
    w = W.partitionBy(*CALL).orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    d = c.withColumns({"speech": F.sum("dur").over(w), "total": F.sum(F.coalesce("value", F.lit(0.0))).over(w), "sorted": F.collect_list("value").over(w)})
    d = d.withColumn("sorted", F.sort_array("sorted")).withColumn("m", F.size("sorted").cast("bigint"))
    d = d.withColumns({f"at_{t}": p for t, p in asked.items()})
    at = lambda t: F.col(f"at_{t}").cast("int")
    d = d.withColumns({f"{t}_at": F.get("sorted", at(t)) for t in asked} | {
        f"{t}_below": F.aggregate(F.slice("sorted", F.lit(1), at(t)), F.lit(0.0), lambda x, y: x + y) for t in asked})
    return _prefixes(d, asked)


def _long_prefixes(c: DataFrame, asked: dict[str, Column]) -> DataFrame:
    c = c.select("*", F.col("value").isNotNull().cast("int").alias("has"), F.coalesce("value", F.lit(0.0)).alias("known"))
    block = F.floor(F.col("chunk") / CHUNK_BLOCK)
    r = scan(c, CALL, block, ["chunk"], {"speech": ("sum", "dur"), "m": ("sum", "has"), "total": ("sum", "known")})
    r = r.withColumns({f"at_{t}": p for t, p in asked.items()})
    found = running_positions(r.select("call_id", "chunk", "score", *[f"at_{t}" for t in asked]), CALL, block, "chunk", "score", {t: f"at_{t}" for t in asked})
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    wide = found.groupBy("call_id", "chunk").agg(*[pick(t, c).alias(f"{t}_{c}") for t in asked for c in ("at", "below")])
    return _prefixes(r.join(wide, ["call_id", "chunk"], "left"), asked)


def _steps(r: DataFrame, a, b, hi, lo) -> DataFrame:
    # without a known score there is no verdict yet
    p = F.when(F.col("running").isNotNull(), calibrate(F.col("running"), a, b))
    return r.select("call_id", "chunk", F.bround("end_s", 2).alias("call_time_s"), F.bround("start_s", 2).alias("chunk_start_s"),
                    F.bround("speech", 2).alias("caller_speech_s"), F.bround("score", 4).alias("chunk_score"),
                    F.bround(calibrate(F.col("score"), a, b), 4).alias("chunk_probability"), F.bround(p, 4).alias("p"),
                    is_confident(p, hi, lo).alias("confident"))


def detection_metrics(steps: DataFrame, calls: DataFrame, threshold: float = 0.5) -> DataFrame:
    """First and confident prediction, lead, and agreement of the early with the final verdict, per call.

    Everything a call cannot support is NULL, never 0.
    """
    row = F.struct("chunk", "call_time_s", "caller_speech_s", "p")
    g = steps.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min_by(row, "chunk").alias("first"), F.max_by(row, "chunk").alias("final"),
        F.min_by(F.when(F.col("confident"), row), F.when(F.col("confident"), F.col("chunk"))).alias("sure"),
        F.max("p").alias("p_max"), F.min("p").alias("p_min"))
    j = calls.join(g, "call_id", "left")
    at, dur = F.col("sure.call_time_s"), F.col("duration_s")
    usable = at.isNotNull() & (dur > 0)
    verdict = lambda p: F.when(p >= threshold, "synthetic").when(p.isNotNull(), "human")
    return j.select(
        "call_id", *[c for c in ("label", "split", "y") if c in calls.columns], dur, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.col("first.call_time_s").alias("first_at_s"), F.col("first.caller_speech_s").alias("first_after_speech_s"), F.col("first.p").alias("first_p"),
        at.alias("confident_at_s"), F.col("sure.caller_speech_s").alias("confident_after_speech_s"), F.col("sure.p").alias("early_p"),
        F.col("sure.chunk").alias("confident_chunk"), F.col("final.p").alias("final_p"),
        F.when(usable, F.bround(F.greatest(dur - at, F.lit(0.0)), 2)).alias("lead_s"),
        F.when(usable, F.bround(F.least(at / dur, F.lit(1.0)) * 100, 1)).alias("percent_elapsed"),
        verdict(F.col("sure.p")).alias("early_verdict"), verdict(F.col("final.p")).alias("final_verdict"),
        (verdict(F.col("sure.p")) == verdict(F.col("final.p"))).alias("agrees"),
        (F.col("final").isNotNull() & F.col("sure").isNull()).alias("never_confident"),
        F.bround(F.coalesce(F.col("p_max") - F.col("p_min"), F.lit(0.0)), 4).alias("spread"))


def decided_at(chunks: DataFrame) -> DataFrame:
    """End of the first chunk from which the running mean keeps its final sign.

    That is the chunk after the last one whose running sign differs from the final sign; every
    row knows the running mean before it, so one scan and one aggregation do.
    """
    c = chunks.select("call_id", F.col("chunk").cast("bigint").alias("chunk"), "end_s", "score", F.lit(1).alias("one"))
    r = scan(c, CALL, F.floor(F.col("chunk") / CHUNK_BLOCK), ["chunk"],
             {"acc": ("sum<", "score"), "n": ("sum<", "one"), "all_acc": ("total", "score"), "all_n": ("total", "one")})
    before = safe_div(F.col("acc"), F.col("n")) >= 0
    was_off = (F.col("n") > 0) & (before != ((F.col("all_acc") / F.col("all_n")) >= 0))
    settled = F.max_by(F.when(was_off, F.col("end_s")), F.when(was_off, F.col("chunk")))
    return r.groupBy("call_id").agg(F.bround(F.coalesce(settled, F.min_by("end_s", "chunk")), 2).alias("decided_at_s"))


def latency_benchmark(m: DataFrame, label: str = "label") -> DataFrame:
    """Medians and shares over all calls and per class."""
    both = m.select("*", F.explode(F.array(F.lit("all"), F.col(label))).alias("scope"))
    got = F.col("confident_at_s").isNotNull()
    pct = F.col("percent_elapsed")
    base = both.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(got).alias("n_detected"), F.count_if("never_confident").alias("n_never_confident"),
        F.bround(F.avg(F.when(pct.isNotNull(), (pct <= 50).cast("double"))) * 100, 1).alias("before_halfway_pct"),
        F.bround(known_mean(F.col("agrees")) * 100, 1).alias("agrees_pct"))
    long = both.where(got).unpivot(["scope"], ["confident_after_speech_s", "confident_at_s", "lead_s", "percent_elapsed"], "metric", "value")
    med = quantiles(long, ["scope", "metric"], "value", {"m": .5})
    pick = lambda c: F.bround(F.max(F.when(F.col("metric") == c, F.col("m"))), 2)
    wide = med.groupBy("scope").agg(pick("confident_after_speech_s").alias("median_speech_s"), pick("confident_at_s").alias("median_call_s"),
                                    pick("lead_s").alias("median_lead_s"), pick("percent_elapsed").alias("median_percent"))
    return base.join(wide, "scope", "left")


def notable_calls(m: DataFrame, k: int = 6) -> DataFrame:
    """The calls whose running verdict moved most, and every call whose early verdict did not last."""
    gradual = m.where(F.col("n_chunks") >= 3).orderBy(F.desc("spread"), "call_id").limit(k).withColumn("why", F.lit("gradual"))
    return gradual.unionByName(m.where(~F.col("agrees")).withColumn("why", F.lit("disagreed"))).select("call_id", "why", "spread", "first_p", "final_p")


def flat_calls(m: DataFrame, below: float = 0.02) -> DataFrame:
    return m.agg(F.count_if(F.col("spread") < below).alias("n_flat"), F.count(F.lit(1)).alias("n_total"))


def features_at_steps(norm: DataFrame, steps: DataFrame) -> DataFrame:
    """Behaviour features of every call cut at each of its steps, ``steps(call_id, chunk, call_time_s)``."""
    from .events import behaviour_features, evidence_quality
    from .intervals import clip_to_prefix
    lim = steps.select("call_id", "chunk", F.floor(F.col("call_time_s") * 1000).cast("bigint").alias("duration_ms")).where("duration_ms > 0")
    keys = ["call_id", "chunk"]
    cut = clip_to_prefix(norm, lim.withColumnRenamed("duration_ms", "prefix_ms"), on=["call_id"])
    return evidence_quality(behaviour_features(cut.drop("prefix_ms"), lim, keys))


def fusion_progression(steps: DataFrame, norm: DataFrame, configs: DataFrame, behaviour_p: Column, hi: float = 0.85, lo: float = 0.15) -> DataFrame:
    """What the fusion would have said at each chunk: exact acoustic prefix, behaviour of the clipped call, verifier never asked.

    ``behaviour_p`` scores a feature row; a call without evidence abstains.
    """
    from .events import behaviour_result
    from .fusion import combine
    f = behaviour_result(features_at_steps(norm, steps).withColumn("p", behaviour_p))
    beh = f.select("call_id", "chunk", F.lit("behaviour").alias("key"), F.col("p").alias("probability"), "quality",
                   (F.col("insufficient") | (F.col("quality") <= 0)).alias("abstained"))
    aco = steps.select("call_id", "chunk", F.lit("acoustic").alias("key"), F.col("p").alias("probability"), F.lit(1.0).alias("quality"),
                       F.lit(False).alias("abstained"))
    sem = steps.select("call_id", "chunk", F.lit("semantic").alias("key"), F.lit(0.5).alias("probability"), F.lit(0.0).alias("quality"), F.lit(False).alias("abstained"))
    layers = aco.unionByName(beh).withColumn("scored", F.lit(True)).unionByName(sem.withColumn("scored", F.lit(False)))
    v = combine(layers, configs, extra=["chunk"])
    return v.join(steps.select("call_id", "chunk", "call_time_s", "caller_speech_s"), ["call_id", "chunk"]).select(
        "call_id", "chunk", "call_time_s", "caller_speech_s", F.bround("p", 4).alias("p"),
        (is_confident(F.col("p"), hi, lo) & F.col("decisive")).alias("confident"), "n_layers_used")


def prefix_features(norm: DataFrame, calls: DataFrame, prefixes_s: Sequence[float]) -> DataFrame:
    """Behaviour features of every call as known at a few fixed seconds and at its end."""
    lim = calls.select("call_id", "y", "duration_ms", F.explode(F.array(*[F.lit(float(x)) for x in prefixes_s], F.lit(float("inf")))).alias("prefix_s"))
    steps = lim.select("call_id", "y", F.when(F.col("prefix_s") == float("inf"), "full").otherwise(F.col("prefix_s").cast("int").cast("string")).alias("prefix"),
                       F.least(F.col("prefix_s") * 1000, F.col("duration_ms").cast("double")).cast("bigint").alias("duration_ms"))
    from .events import behaviour_features, evidence_quality
    from .intervals import clip_to_prefix
    keys = ["call_id", "prefix"]
    cut = clip_to_prefix(norm, steps.select(*keys, F.col("duration_ms").alias("prefix_ms")), on=["call_id"]).drop("prefix_ms")
    return evidence_quality(behaviour_features(cut, steps.drop("y"), keys)).join(steps.select(*keys, "y"), keys)


def prefix_table(results: DataFrame, seconds: str | None = None) -> DataFrame:
    """Evidence and, where measured, time per prefix: ``results(prefix, event_count, quality, confidence, insufficient)``."""
    g = results.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.avg("event_count").alias("mean_events"), F.avg("quality").alias("mean_quality"),
        F.avg("confidence").alias("mean_confidence"), F.count_if("insufficient").alias("insufficient_calls"))
    if seconds:
        t = results.groupBy("prefix").agg(F.avg(seconds).alias("time_mean"))
        g = g.join(t, "prefix").join(quantiles(results, ["prefix"], seconds, {"time_p50": .5, "time_p95": .95}), "prefix")
    return g


def decision_policy_impact(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion per prefix before and after unanswerable calls stop being flagged."""
    blank = (F.col("quality") <= 0) | (F.col("event_count") < 2)
    before, pos = F.col("p") >= threshold, F.col("y") == 1
    after = before & ~blank
    hit = lambda v: F.avg((v == pos).cast("double"))
    return results.groupBy("prefix").agg(
        hit(before).alias("accuracy_before"), hit(after).alias("accuracy_after"), F.count_if(~blank).alias("available"),
        F.count_if(blank).alias("fallback"), F.count_if(blank & ~pos).alias("fallback_human"), F.count_if(blank & pos).alias("fallback_synthetic"))
