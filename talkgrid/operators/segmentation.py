"""Frame series to speech regions, and level summaries of frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ordered import quantiles, scan
from .intervals import CHANNEL, islands, merge_intervals, speech_iou


def _frames_of(seconds: float, hop_s: float) -> int:
    return max(1, round(seconds / hop_s))


def runs_to_regions(frames: DataFrame, speech: Column, keys: Sequence[str], close_below: int, keep_from: int) -> DataFrame:
    """True runs with inner gaps shorter than ``close_below`` frames closed, then only runs of ``keep_from`` frames."""
    t = frames.where(speech).select(*keys, F.col("frame_idx").alias("start_idx"), (F.col("frame_idx") + 1).alias("end_idx"))
    r = merge_intervals(t, keys, close_below - 1, "start_idx", "end_idx", tile=8192)
    return r.where(F.col("end_idx") - F.col("start_idx") >= keep_from)


def crosstalk_gate(frames: DataFrame, margin_db: float | None) -> DataFrame:
    """Adds ``loud_enough``: a caller frame must not be quieter than the agent's by more than the margin."""
    if margin_db is None:
        return frames.withColumn("loud_enough", F.lit(True))
    other = frames.where(F.col("channel") == 1).select("call_id", "frame_idx", F.col("rms_db").alias("agent_db"))
    caller = frames.where(F.col("channel") == 0).join(other, ["call_id", "frame_idx"], "left")
    ok = F.coalesce(F.col("rms_db") >= F.col("agent_db") - margin_db, F.lit(True))
    return caller.withColumn("loud_enough", ok).drop("agent_db")


def energy_vad(frames: DataFrame, lengths: DataFrame, keys: Sequence[str] = CHANNEL, threshold_db: float = 15.0,
               min_abs_db: float = -55.0, min_speech_s: float = 0.30, min_gap_s: float = 0.30, pad_ms: int = 100,
               hop_ms: int = 10, frame_ms: int = 20, margin_db: float | None = None) -> DataFrame:
    """Speech where a frame is ``threshold_db`` above the channel's 10th percentile and above ``min_abs_db``.

    ``lengths(call_id, length_ms)`` bounds the padded regions.
    """
    keys = list(keys)
    floor = quantiles(frames, keys, "rms_db", {"floor_db": .1})
    f = crosstalk_gate(frames, margin_db).join(floor, keys)
    speech = (F.col("rms_db") > F.greatest(F.col("floor_db") + threshold_db, F.lit(min_abs_db))) & F.col("loud_enough")
    hop_s = hop_ms / 1000
    r = runs_to_regions(f, speech, keys, _frames_of(min_gap_s, hop_s), _frames_of(min_speech_s, hop_s))
    r = r.join(lengths, "call_id").select(
        *keys, F.greatest(F.lit(0), F.col("start_idx") * hop_ms - pad_ms).alias("start_ms"),
        F.least("length_ms", (F.col("end_idx") - 1) * hop_ms + frame_ms + pad_ms).alias("end_ms"))
    return merge_intervals(r, keys)


def energy_vad_peak(frames: DataFrame, lengths: DataFrame, keys: Sequence[str] = CHANNEL, margin_db: float = 12.0,
                    gap_ms: int = 250, min_ms: int = 150, pad_ms: int = 40, hop_ms: int = 10, frame_ms: int = 25) -> DataFrame:
    """Peak-normalised variant: levels relative to the channel's peak, gaps closed up to and including ``gap_ms``."""
    keys = list(keys)
    floor = quantiles(frames, keys, "rms_db", {"floor_db": .1})  # dividing by the peak shifts level and floor alike
    f = frames.join(floor, keys).where(F.col("rms_db") > F.col("floor_db") + margin_db)
    t = f.select(*keys, (F.col("frame_idx") * hop_ms).alias("start_ms"), (F.col("frame_idx") * hop_ms + frame_ms).alias("end_ms"))
    # runs touch at the hop, so frames further apart than one hop are separate runs whose gap is start - end
    r = merge_intervals(t, keys, gap_ms).where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    r = r.join(lengths, "call_id").select(*keys, F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms"),
                                          F.least("length_ms", F.col("end_ms") + pad_ms).alias("end_ms"))
    return merge_intervals(r, keys)


def energy_vad_fast(frames: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Linear-level variant: above the smaller of 1.8 x lower quartile and half the peak, at least 1e-4; runs of frames."""
    keys = list(keys)
    lin = frames.withColumn("rms", F.pow(F.lit(10.0), F.col("rms_db") / 20))
    q = quantiles(lin, keys, "rms", {"q25": .25}).join(lin.groupBy(*keys).agg(F.max("rms").alias("peak")), keys)
    thr = F.greatest(F.least(F.col("q25") * 1.8, F.col("peak") * 0.5), F.lit(1e-4))
    return islands(lin.join(q, keys), F.col("rms") > thr, keys)


def hysteresis_vad(frames: DataFrame, lengths: DataFrame, keys: Sequence[str] = CHANNEL, p: str = "p",
                   threshold: float | Column = 0.5, hysteresis: float = 0.15, min_silence_ms: int = 160,
                   min_speech_ms: int = 160, pad_ms: int = 32, gap_ms: int = 150, frame_ms: int = 32) -> DataFrame:
    """Speech opens at ``threshold`` and closes after ``min_silence_ms`` of frames below ``threshold - hysteresis``.

    Within the gap behind a high frame only the first and last low frame matter: when they are
    ``min_silence_ms`` apart the segment ended at the first. Frames between the two thresholds
    neither open, close nor reset. An open last segment ends with the call.
    """
    keys = list(keys)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    f = frames.join(lengths, "call_id").withColumn("t", F.col("frame_idx") * frame_ms).where(F.col("t") < F.col("length_ms"))
    f = f.select(*keys, "t", "length_ms", F.when(F.col(p) >= thr, F.col("t")).alias("high"),
                 (F.col(p) < thr - hysteresis).alias("low"))
    # block-wise carry of the last high frame, so a long call spreads over its blocks
    f = scan(f, keys, F.floor(F.col("t") / (frame_ms * 8192)), ["t"],
             {"last_high": ("last", "high"), "final_high": ("total_max", "high")})
    g = f.where(F.col("last_high").isNotNull()).groupBy(*keys, "last_high").agg(
        F.min(F.when(F.col("low"), F.col("t"))).alias("lo"), F.max(F.when(F.col("low"), F.col("t"))).alias("hi"),
        (F.max("t") + frame_ms).alias("to"), F.max("length_ms").alias("length_ms"), F.max("final_high").alias("final_high"))
    silent = F.coalesce(F.col("hi") - F.col("lo") >= min_silence_ms, F.lit(False))
    # each high frame holds up to its cut, else up to the next high frame, which then touches it
    end = F.when(silent, F.col("lo")).when(F.col("last_high") == F.col("final_high"), F.col("length_ms")).otherwise(F.col("to"))
    held = g.select(*keys, F.col("last_high").alias("start_ms"), end.alias("end_ms"))
    seg = merge_intervals(held, keys).where(F.col("end_ms") - F.col("start_ms") >= min_speech_ms).join(lengths, "call_id")
    r = seg.select(*keys, F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms"),
                   F.least("length_ms", F.col("end_ms") + pad_ms).alias("end_ms"))
    return merge_intervals(r, keys, gap_ms)


def segmentation_stability(frames: DataFrame, lengths: DataFrame, threshold: float = 0.5, step: float = 0.1, **kw) -> DataFrame:
    """Agreement of the segmentations at a lower and a higher threshold, mean over the channels."""
    low = hysteresis_vad(frames, lengths, threshold=max(.2, round(threshold - step, 10)), **kw)
    high = hysteresis_vad(frames, lengths, threshold=min(.9, round(threshold + step, 10)), **kw)
    both = lengths.select("call_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    return speech_iou(low, high, both, CHANNEL).groupBy("call_id").agg(F.avg("iou").alias("stability"))


def vad_config_scores(frames: DataFrame, lengths: DataFrame, reference: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Mean agreement with reference regions of every configuration, best first decided by the caller."""
    both = lengths.select("call_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    out = None
    for name, kw in configs.items():
        got = hysteresis_vad(frames, lengths, **kw)
        s = speech_iou(got, reference, both, CHANNEL).agg(F.avg("iou").alias("mean_iou")).withColumn("config", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def dynamic_range(frames: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    q = quantiles(frames, list(keys), "rms_db", {"p10": .1, "p50": .5, "p95": .95})
    return q.withColumn("range_db", F.col("p95") - F.col("p10"))


def peak_envelope(frames: DataFrame, buckets: int = 100, keys: Sequence[str] = CHANNEL, value: str = "peak") -> DataFrame:
    """Highest level in each of ``buckets`` equal stretches of a channel, relative to the channel's top."""
    keys = list(keys)
    top = frames.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("n"), F.max(F.abs(value)).alias("top"))
    j = frames.join(top, keys)
    b = F.floor(F.col("frame_idx") * F.least(F.lit(buckets), F.col("n")) / F.col("n"))
    return j.groupBy(*keys, b.alias("bucket")).agg(
        F.bround(F.max(F.abs(value)) / F.max(F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))), 4).alias("level"))
