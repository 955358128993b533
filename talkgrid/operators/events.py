"""Conversation events of normalised turns, and the behaviour features built from them.

Turns of one channel are disjoint after normalisation, so the turn that contains an onset is
always the latest one started before it: events need one ordered pass over a call, no
pairing of its turns. NULL means right-censored: the recording ended before the outcome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.feature_sets import ALL_BEHAVIOUR
from ..functions.fixed import (CV_MIN_MEAN_MS, IMMEDIATE_RETAKE_MS, IMMEDIATE_YIELD_MS, LONG_GAP_MS, MIN_OVERLAP_MS,
                               MIN_VARIABILITY_EVENTS, ONSET_TOLERANCE_MS, SHORT_AGENT_TURN_MS)
from ..functions.ordered import interpolated
from ..functions.scalar import clamp, known_mean, safe_div
from .intervals import CALL, normalize_turns, response_latency_simple, speaking_states


def turn_context(norm: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Every turn with the latest and next turn of the other side and its own next turn."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("start_ms", "channel")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # "what follows" as a growing frame in reverse order: a shrinking frame costs the square of the call
    after = (W.partitionBy(*keys).orderBy(F.desc("start_ms"), F.desc("channel")).rowsBetween(W.unboundedPreceding, -1))
    span = F.struct("start_ms", "end_ms")
    own = W.partitionBy(*keys, "channel").orderBy("start_ms")
    side = lambda ch: F.when(F.col("channel") == ch, span)
    c = norm.withColumns({
        "prev_caller": F.last(side(0), True).over(before), "prev_agent": F.last(side(1), True).over(before),
        "next_caller": F.last(side(0), True).over(after), "next_own": F.lead("start_ms").over(own)})
    return c.join(calls.select(*keys, "duration_ms"), keys)


def _interruption() -> tuple[Column, dict[str, Column]]:
    """Whether a turn of :func:`turn_context` interrupts, and the event's columns."""
    cs, ce = F.col("prev_caller.start_ms"), F.col("prev_caller.end_ms")
    a, ae, dur = F.col("start_ms"), F.col("end_ms"), F.col("duration_ms")
    overlap = F.least(ce, ae) - a
    hit = (F.col("channel") == 1) & (cs + ONSET_TOLERANCE_MS < a) & (a < ce) & (overlap >= MIN_OVERLAP_MS)
    observed = ce < dur
    yielded = F.when(observed, ce < ae - ONSET_TOLERANCE_MS)
    ns = F.col("next_caller.start_ms")
    resumed = F.when(yielded & (ns < F.coalesce("next_own", "duration_ms")), ns)
    return hit, {
        "onset_ms": a, "overlap_ms": overlap, "stop_latency_ms": F.when(observed, ce - a), "yielded": yielded,
        "immediate_yield": F.when(observed, yielded & (ce - a <= IMMEDIATE_YIELD_MS)), "recovery_ms": resumed - ce,
        "recovery_gap_ms": F.when(ae < dur, resumed - ae), "retake": resumed <= ae + IMMEDIATE_RETAKE_MS}


def _barge_in() -> tuple[Column, dict[str, Column]]:
    as_, ae = F.col("prev_agent.start_ms"), F.col("prev_agent.end_ms")
    c, ce, dur = F.col("start_ms"), F.col("end_ms"), F.col("duration_ms")
    overlap = F.least(ce, ae) - c
    hit = (F.col("channel") == 0) & (as_ + ONSET_TOLERANCE_MS < c) & (c < ae) & (overlap >= MIN_OVERLAP_MS)
    return hit, {"onset_ms": c, "overlap_ms": F.when(F.least(ce, ae) < dur, overlap), "lead_ms": F.when(ae < dur, ae - c),
                 "continues": F.when(ae < dur, ce > ae + ONSET_TOLERANCE_MS)}


def _events(df: DataFrame, keys: Sequence[str], event: tuple[Column, dict[str, Column]]) -> DataFrame:
    hit, cols = event
    return df.where(hit).select(*keys, *[c.alias(n) for n, c in cols.items()])


def interruptions(context: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Agent onsets inside a caller turn, with the caller's yield and recovery."""
    return _events(context, keys, _interruption())


def barge_ins(context: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Caller onsets inside an agent turn."""
    return _events(context, keys, _barge_in())


def _followed(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("start_ms")
    return states.withColumns({"s1": F.lead("state", 1).over(w), "t1": F.lead("start_ms", 1).over(w),
                               "s2": F.lead("state", 2).over(w), "t2": F.lead("start_ms", 2).over(w)})


def _response() -> tuple[Column, dict[str, Column]]:
    onset = F.when(F.col("s1") == 1, F.col("t1")).when((F.col("s1") == 0) & (F.col("s2") == 1), F.col("t2"))
    return (F.col("state") == 2) & onset.isNotNull(), {
        "onset_ms": onset, "latency_ms": onset - F.col("end_ms"), "agent_ms": F.col("end_ms") - F.col("agent_start_ms")}


def _gap(min_ms: int = LONG_GAP_MS) -> tuple[Column, dict[str, Column]]:
    """An interior silence: something was before it and something comes after it."""
    length = F.col("end_ms") - F.col("start_ms")
    hit = (F.col("state") == 0) & (F.col("start_ms") > 0) & F.col("s1").isNotNull() & (length >= min_ms)
    return hit, {"onset_ms": F.col("start_ms"), "duration_ms": length, "caller_next": F.col("s1") == 1}


def responses(states: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Agent alone, then silence or nothing, then caller alone: latency and the agent turn's length."""
    return _events(_followed(states, keys), keys, _response())


def extended_gaps(states: DataFrame, keys: Sequence[str] = CALL, min_ms: int = LONG_GAP_MS) -> DataFrame:
    """Interior silences of at least ``min_ms`` and whether the caller breaks them."""
    return _events(_followed(states, keys), keys, _gap(min_ms))


# ------------------------------------------------------------------------------ summaries

def summary_columns(value: str, scale: float = 1000.0) -> dict[str, Column]:
    """Count, mean, median of a ranked value; spread only from three values on; cv only for clearly positive ones."""
    v = F.col(value)
    n = F.count(v)
    enough = n >= MIN_VARIABILITY_EVENTS
    std = F.when(enough, F.stddev_samp(v) / scale)
    mean = F.avg(v) / scale
    stable = enough & (F.avg(v) >= CV_MIN_MEAN_MS * scale / 1000.0) & (F.min(v) >= 0)
    iqr = interpolated(.75, value) - interpolated(.25, value)
    return {"count": n, "mean": mean, "median": interpolated(.5, value) / scale, "std": std,
            "iqr": F.when(enough, iqr / scale), "cv": F.when(stable, std / mean)}


def ranked_in_call(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Known values with their sorted position, shaped for :func:`interpolated`.

    One call's measurements, bounded by its length. Window and the aggregation behind it share one
    shuffle, and ranks keep the aggregation hash-based where ``percentile`` would not.
    """
    w = W.partitionBy(*keys)
    return long.where(F.col(value).isNotNull()).withColumns({
        "n": F.lit(1), "cum_n": F.row_number().over(w.orderBy(value)) - 1, "tot_n": F.count(F.lit(1)).over(w)})


def summarize(long: DataFrame, keys: Sequence[str] = ("call_id", "metric"), value: str = "value") -> DataFrame:
    """Summary of values in seconds per call and metric."""
    keys = list(keys)
    known = ranked_in_call(long.withColumn("__v", F.col(value) * 1000.0), keys, "__v")
    g = known.groupBy(*keys).agg(*[c.alias(n) for n, c in summary_columns("__v").items()])
    return long.select(*keys).distinct().join(g, keys, "left").fillna(0, subset=["count"])


def _facts(norm: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything a feature is made of, as ``(keys, metric, value in ms or 0/1)`` rows.

    One pass over the turns and one over the states; a row gives whatever it has evidence for.
    """

    def rows(df, metrics):
        pairs = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
        known = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
        return df.select(*keys, F.explode(known).alias("f")).select(*keys, "f.metric", "f.value")

    caller, d = F.col("channel") == 0, F.col("end_ms") - F.col("start_ms")
    done = F.col("end_ms") < F.col("duration_ms")
    cut, i = _interruption()
    barge, b = _barge_in()
    react = F.when(i["immediate_yield"], 0).when(i["yielded"], 1).when(i["yielded"].isNotNull(), 2)
    turn = {
        "caller_speech": F.when(caller, d), "agent_speech": F.when(~caller, d), "caller_turn": F.when(caller & done, d),
        "agent_turn": F.when(~caller & done, d), "caller_pause": F.when(caller, F.col("next_own") - F.col("end_ms")),
        "start": F.col("start_ms"), "end": F.col("end_ms")}
    turn |= {m: F.when(cut, c) for m, c in {
        "interruption": F.lit(1), "interruption_stop_latency": i["stop_latency_ms"], "yielded": i["yielded"].cast("int"),
        "immediate": i["immediate_yield"].cast("int"), "recovery_latency": i["recovery_ms"], "recovery_gap": i["recovery_gap_ms"],
        "retake": i["retake"].cast("int"), "reaction": react}.items()}
    turn |= {m: F.when(barge, c) for m, c in {
        "barge_in": F.lit(1), "barge_overlap": b["overlap_ms"], "continues": b["continues"].cast("int")}.items()}
    answered, r = _response()
    silent, g = _gap()
    lat, short = r["latency_ms"], r["agent_ms"] < SHORT_AGENT_TURN_MS
    state = {
        "silence": F.when(F.col("state") == 0, d), "overlap": F.when(F.col("state") == 3, d), "response_latency": F.when(answered, lat),
        "short_context_response": F.when(answered & short, lat), "long_context_response": F.when(answered & ~short, lat),
        "extended_gap": F.when(silent, 1), "gap_caller": F.when(silent, g["caller_next"].cast("int"))}
    return rows(turn_context(norm, calls, keys), turn).unionByName(rows(_followed(speaking_states(norm, calls, keys), keys), state))


def behaviour_features(turns: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL, normalised: bool = False) -> DataFrame:
    """The 51 behaviour columns of every call, NULL where there is no evidence."""
    keys = list(keys)
    norm = turns if normalised else normalize_turns(turns, calls, keys=keys)
    f = _facts(norm, calls, keys)
    cols = summary_columns("value")
    s = ranked_in_call(f, [*keys, "metric"], "value").groupBy(*keys, "metric").agg(*[c.alias(n) for n, c in cols.items()], F.sum("value").alias("total"),
                                       F.min("value").alias("least"), F.max("value").alias("most"),
                                       *[F.count_if(F.col("value") == k).alias(f"n{k}") for k in (0, 1, 2)])
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    spread = ("response_latency", "interruption_stop_latency", "recovery_latency", "barge_overlap")
    out = {
        "caller_speech_s": zero(pick("caller_speech", "total")) / 1000, "agent_speech_s": zero(pick("agent_speech", "total")) / 1000,
        "silence_s": zero(pick("silence", "total")) / 1000, "overlap_s": zero(pick("overlap", "total")) / 1000,
        "caller_turn_count": zero(pick("caller_speech", "count")), "agent_turn_count": zero(pick("agent_speech", "count")),
        "first_start": pick("start", "least"), "last_end": pick("end", "most"),
        "interruption_count": zero(pick("interruption", "count")), "barge_in_count": zero(pick("barge_in", "count")),
        "extended_gap_count": zero(pick("extended_gap", "count")),
        "interruption_yield_fraction": pick("yielded", "mean") * 1000,
        "interruption_immediate_yield_fraction": pick("immediate", "mean") * 1000,
        "immediate_retake_fraction": pick("retake", "mean") * 1000, "barge_continues_fraction": pick("continues", "mean") * 1000,
        "extended_gap_caller_fraction": pick("gap_caller", "mean") * 1000,
        "recovery_gap_mean": pick("recovery_gap", "mean"), "barge_overlap_mean": pick("barge_overlap", "mean"),
        "caller_pause_median": pick("caller_pause", "median"),
        "short_context_response_std": pick("short_context_response", "std"),
        "long_context_response_std": pick("long_context_response", "std"),
        "response_latency_count": zero(pick("response_latency", "count")),
        "recovery_latency_count": zero(pick("recovery_latency", "count")),
        "interruption_stop_latency_count": zero(pick("interruption_stop_latency", "count"))}
    for stat in ("mean", "median", "std", "iqr"):
        out[f"caller_turn_{stat}"] = pick("caller_turn", stat)
    for stat in ("mean", "median"):
        out[f"agent_turn_{stat}"] = pick("agent_turn", stat)
        for m in ("response_latency", "interruption_stop_latency"):
            out[f"{m}_{stat}"] = pick(m, stat)
    out["recovery_latency_mean"] = pick("recovery_latency", "mean")
    for m in spread:
        for stat in ("std", "iqr", "cv"):
            out[f"{m}_{stat}"] = pick(m, stat)
    n = F.max(F.when(F.col("metric") == "reaction", F.col("count")))
    share = [F.max(F.when(F.col("metric") == "reaction", F.col(f"n{k}"))) / n for k in (0, 1, 2)]
    bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    out["reaction_entropy"] = F.when(n >= MIN_VARIABILITY_EVENTS, bits)
    wide = s.groupBy(*keys).agg(*[c.alias(k) for k, c in out.items()])
    counts = [c for c in out if c.endswith("_count") or c in ("caller_speech_s", "agent_speech_s", "silence_s", "overlap_s")]
    j = calls.select(*keys, "duration_ms").join(wide, keys, "left").fillna(0, subset=counts)
    dur = F.col("duration_ms") / 1000
    j = j.withColumns({
        "duration_s": dur,
        "leading_silence_s": F.coalesce(F.col("first_start") / 1000, dur),
        "trailing_silence_s": dur - F.coalesce(F.col("last_end") / 1000, F.lit(0.0)),
        "caller_proportion": F.col("caller_speech_s") / dur,
        "interruption_rate": safe_div(F.col("interruption_count"), F.col("agent_turn_count")),
        "barge_in_rate": safe_div(F.col("barge_in_count"), F.col("caller_turn_count"))})
    return j.select(*keys, *ALL_BEHAVIOUR, "interruption_stop_latency_count")


def reaction_entropy(inter: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Bits of yield-now / yield / hold among the known reactions, from three on."""
    known = F.col("yielded").isNotNull()
    n = F.count_if(known)
    now, later = F.count_if(F.col("immediate_yield")), F.count_if(F.col("yielded") & ~F.col("immediate_yield"))
    hold = F.count_if(known & ~F.col("yielded"))
    bits = sum((F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0) for k in (now, later, hold)), F.lit(0.0))
    return inter.groupBy(*keys).agg(n.alias("n_known"), F.when(n >= MIN_VARIABILITY_EVENTS, bits).alias("reaction_entropy"))


def evidence_quality(features: DataFrame, stability: Column | float = 1.0) -> DataFrame:
    """Adds ``event_count`` and ``quality``: how much a call's events can carry, in [0, 1]."""
    stab = stability if isinstance(stability, Column) else F.lit(float(stability))
    r, i, b = F.col("response_latency_count"), F.col("interruption_count"), F.col("barge_in_count")
    one = F.lit(1.0)
    speech = F.least(one, F.col("caller_speech_s") / 10, F.col("agent_speech_s") / 10)
    events = (F.least(one, r / 8) * .45 + F.least(one, (i + b) / 5) * .35
              + F.least(one, F.greatest(F.lit(0), i - 2) / 4) * .20)
    q = speech * F.least(one, F.col("duration_s") / 30) * events * clamp(stab, 0.0, 1.0)
    return features.withColumns({"event_count": r + i + b, "quality": clamp(q, 0.0, 1.0)})


def behaviour_result(scored: DataFrame, p: str = "p") -> DataFrame:
    """Too little evidence answers 0.5 with quality 0; confidence is quality times distance from 0.5."""
    weak = (F.col("event_count") < 2) | (F.least("caller_speech_s", "agent_speech_s") < 1)
    s = scored.withColumns({"insufficient": weak, p: F.when(weak, 0.5).otherwise(F.col(p)),
                            "quality": F.when(weak, 0.0).otherwise(F.col("quality"))})
    return s.withColumn("confidence", F.col("quality") * F.abs(2 * F.col(p) - 1))


def challenge_response(scored: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """Boolean answer; without evidence a non-flag at 0.5."""
    blank = (F.col("quality") <= 0) | (F.col("event_count") < 2)
    pos = F.col(p) >= threshold
    return scored.withColumns({
        "abstained": blank, "is_synthetic": F.when(blank, False).otherwise(pos),
        "answer_confidence": F.when(blank, 0.5).when(pos, F.col(p)).otherwise(1 - F.col(p))})


def conversation_features(norm: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """The older 35-column set: five statistics of turns, pauses and latencies, 0 where there is nothing."""
    keys = list(keys)
    ctx = turn_context(norm, calls, keys)
    caller, d = F.col("channel") == 0, (F.col("end_ms") - F.col("start_ms")) / 1000
    lat = response_latency_simple(norm, keys).select(*keys, F.lit("latency").alias("metric"), (F.col("latency_ms") / 1000).alias("value"))
    inside = caller & (F.col("prev_agent.end_ms") > F.col("start_ms"))
    # a simultaneous agent onset sorts behind the caller's: look it up on the next agent turn too
    metrics = {"caller_turn": F.when(caller, d), "agent_turn": F.when(~caller, d),
               "pause": F.when(caller & F.col("next_own").isNotNull(), F.greatest(F.lit(0.0), (F.col("next_own") - F.col("end_ms")) / 1000)),
               "interruption": F.when(inside | (caller & F.col("same_start")), 1.0)}
    tie = F.lead("channel").over(W.partitionBy(*keys).orderBy("start_ms", "channel"))
    tie_at = F.lead("start_ms").over(W.partitionBy(*keys).orderBy("start_ms", "channel"))
    ctx = ctx.withColumn("same_start", F.coalesce((tie == 1) & (tie_at == F.col("start_ms")), F.lit(False)))
    pairs = [F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
    f = ctx.select(*keys, F.explode(F.array(*pairs)).alias("f")).select(*keys, "f.metric", "f.value").where(F.col("value").isNotNull())
    st = speaking_states(norm, calls, keys).where("state = 3").select(
        *keys, F.lit("overlap").alias("metric"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("value"))
    f = f.unionByName(lat).unionByName(st)
    s = f.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
                                       F.max("value").alias("max"), F.median("value").alias("median"), F.count("value").alias("n"),
                                       F.sum("value").alias("total"), F.count_if(F.col("value") <= 0.5).alias("quick"))
    pick = lambda m, c: F.coalesce(F.max(F.when(F.col("metric") == m, F.col(c))), F.lit(0)).cast("double")
    names = {"caller_turn": "caller_turn_duration", "agent_turn": "agent_turn_duration", "pause": "caller_pause",
             "latency": "response_latency"}
    cols = {f"{n}_{stat}": pick(m, stat) for m, n in names.items() for stat in ("mean", "std", "min", "max", "median")}
    cols |= {"caller_turns": pick("caller_turn", "n"), "agent_turns": pick("agent_turn", "n"), "response_count": pick("latency", "n"),
             "interruptions": pick("interruption", "n"), "caller_speech_seconds": pick("caller_turn", "total"),
             "agent_speech_seconds": pick("agent_turn", "total"), "overlap_seconds": pick("overlap", "total"), "quick": pick("latency", "quick")}
    w = s.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    j = calls.select(*keys, (F.col("duration_ms") / 1000).alias("duration")).join(w, keys, "left").fillna(0)
    dur = F.col("duration")
    ratio = lambda a, b: safe_div(F.col(a), F.col(b), 0.0)
    return j.withColumns({
        "caller_speech_ratio": F.col("caller_speech_seconds") / dur, "agent_speech_ratio": F.col("agent_speech_seconds") / dur,
        "overlap_ratio": F.col("overlap_seconds") / dur, "pause_cv": ratio("caller_pause_std", "caller_pause_mean"),
        "response_latency_cv": ratio("response_latency_std", "response_latency_mean"),
        "quick_response_ratio": ratio("quick", "response_count"),
        "interruption_rate": F.col("interruptions") / F.greatest(F.lit(1.0), F.col("caller_turns"))}).drop("quick")


def event_count_delta(a: DataFrame, b: DataFrame, counts: Sequence[str], keys: Sequence[str] = CALL) -> DataFrame:
    """Absolute change of event counts between two segmentations of the same calls."""
    keys = list(keys)
    r = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in counts])
    return a.join(r, keys).select(*keys, *[F.abs(F.col(c) - F.col(f"__{c}")).alias(f"{c}_delta") for c in counts])
