"""Interval and time-series operators over turns, regions and frames.

Times are integer milliseconds and intervals half open. Union (:func:`merge_intervals`)
cuts the timeline into tiles, so no call is ever sorted in one task; its result holds
disjoint intervals, which the length of a call bounds (two per ``gap`` of audio), and
the windows per call further down run on that.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import MERGE_GAP_MS
from ..functions.ordered import quantiles, scan
from ..functions.scalar import bool_int, hash_uniform, safe_div

CALL = ["call_id"]
CHANNEL = ["call_id", "channel"]
TILE = 60_000
BIN_TASKS = 256


# ------------------------------------------------------------------------------ union

def merge_intervals(df: DataFrame, keys: Sequence[str] = CHANNEL, gap: int = 0, start: str = "start_ms",
                    end: str = "end_ms", tile: int = TILE) -> DataFrame:
    """Union of intervals per key; neighbours at most ``gap`` apart become one.

    Intervals sharing a start collapse before the shuffle, and each tile takes the furthest
    end of the tiles before it from a table of one row per tile. An interval opens an island
    when it starts beyond that; the island ends where the next opener found the furthest end.
    """
    keys = list(keys)
    d = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    s = scan(d, keys, F.floor(F.col(start) / tile), [start],
             {"__before": ("max", end), "__last": ("total_max", end)}, inclusive=False)
    opens = s.where(F.col("__before").isNull() | (F.col(start) > F.col("__before") + gap))
    w = W.partitionBy(*keys).orderBy(start)
    closed = F.coalesce(F.lead("__before").over(w), F.col("__last"))
    return opens.select(*keys, start, closed.alias(end))


def islands(frames: DataFrame, flag: Column, keys: Sequence[str] = CHANNEL, idx: str = "frame_idx") -> DataFrame:
    """Runs of true frames as ``[start_idx, end_idx)``."""
    t = frames.where(flag).select(*keys, F.col(idx).alias("start_idx"), (F.col(idx) + 1).alias("end_idx"))
    return merge_intervals(t, keys, 0, "start_idx", "end_idx", tile=8192)


def normalize_turns(turns: DataFrame, calls: DataFrame, gap: int = MERGE_GAP_MS,
                    keys: Sequence[str] = CALL) -> DataFrame:
    """Turns clipped to their call's length and united per channel, never across channels."""
    keys = list(keys)
    t = turns.groupBy(*keys, "channel", "start_ms").agg(F.max("end_ms").alias("end_ms"))
    t = t.join(calls.select(*keys, "duration_ms"), keys).where(F.col("start_ms") < F.col("duration_ms"))
    t = t.select(*keys, "channel", "start_ms", F.least("end_ms", "duration_ms").alias("end_ms"))
    return merge_intervals(t, keys + ["channel"], gap)


def select_channel(df: DataFrame, channel: int, n_channels: str | None = None) -> DataFrame:
    """One side of the call; a mono recording counts as the caller."""
    ch = F.when(F.col(n_channels) == 1, F.lit(0)).otherwise(F.col("channel")) if n_channels else F.col("channel")
    return df.where(ch == channel)


def clip_to_prefix(df: DataFrame, prefixes: DataFrame, start: str = "start_ms", end: str = "end_ms",
                   limit: str = "prefix_ms", on: Sequence[str] = ()) -> DataFrame:
    """Intervals as known at each prefix. A few fixed prefixes for all calls, or rows joined ``on`` the call."""
    j = df.join(prefixes, list(on)) if on else df.join(F.broadcast(prefixes))  # literal list of prefixes
    return j.where(F.col(start) < F.col(limit)).withColumn(end, F.least(F.col(end), F.col(limit)))


# ------------------------------------------------------------------------------ overlap

def tiled_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Overlapping pieces of two interval lists, joined on key and tile so a long call is many small joins.

    Intervals are cut at tile borders: every shared millisecond lies in exactly one tile.
    """
    keys = list(keys)

    def cut(df, p):
        s, e = F.col("start_ms"), F.col("end_ms")
        t = df.select(*keys, s, e, F.explode(F.sequence(F.floor(s / tile), F.floor((e - 1) / tile))).alias("tile"))
        return t.select(*keys, "tile", F.col("start_ms").alias(f"{p}_start"), F.col("end_ms").alias(f"{p}_end"),
                        F.greatest(s, F.col("tile") * tile).alias(f"{p}_s"),
                        F.least(e, (F.col("tile") + 1) * tile).alias(f"{p}_e"))

    j = cut(a, "a").join(cut(b, "b"), keys + ["tile"])
    return j.where((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))).withColumn(
        "shared_ms", F.least("a_e", "b_e") - F.greatest("a_s", "b_s"))


def intersection_duration(a: DataFrame, b: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    return tiled_overlaps(a, b, keys).groupBy(*keys).agg(F.sum("shared_ms").alias("shared_ms"))


def speech_iou(a: DataFrame, b: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Intersection over union of two segmentations per key of ``calls``; 1 when both are empty."""
    keys = list(keys)
    i = intersection_duration(a, b, keys)
    total = lambda d, n: d.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(n))
    j = (calls.select(*keys).join(i, keys, "left").join(total(a, "a_ms"), keys, "left").join(total(b, "b_ms"), keys, "left")
         .fillna(0, subset=["shared_ms", "a_ms", "b_ms"]))
    union = F.col("a_ms") + F.col("b_ms") - F.col("shared_ms")
    return j.select(*keys, F.when(union == 0, 1.0).otherwise(safe_div(F.col("shared_ms"), union)).alias("iou"))


def rasterize(regions: DataFrame, keys: Sequence[str] = CALL, hop: int = 10) -> DataFrame:
    """True bins only, one row per bin of ``hop`` ms.

    Regions become disjoint ranges of bins before a bin is written, so no table of all bins is held to find repeats. Ranges are far smaller
    than their bins: they go to a fixed number of tasks at least, which what they shuffle would not ask for.
    """
    tasks = max(BIN_TASKS, int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = bin_spans(regions, keys, hop).repartition(tasks, *keys)
    return spans.select(*keys, F.explode(F.sequence("start_ms", F.col("end_ms") - 1)).alias("bin"))


def bin_spans(regions: DataFrame, keys: Sequence[str] = CALL, hop: int = 10) -> DataFrame:
    """The true bins of :func:`rasterize` as disjoint bin ranges: counts and overlaps need no row per bin."""
    b = regions.select(*keys, F.floor(F.col("start_ms") / hop).alias("start_ms"), F.ceil(F.col("end_ms") / hop).alias("end_ms"))
    return merge_intervals(b, keys, tile=TILE // hop)


def _shared_bins(a, b, keys, hop):
    return intersection_duration(bin_spans(a, keys, hop), bin_spans(b, keys, hop), keys)


def overlap_seconds(caller: DataFrame, agent: DataFrame, keys: Sequence[str] = CALL, hop: int = 10) -> DataFrame:
    s = _shared_bins(caller, agent, keys, hop)
    return s.select(*keys, (F.col("shared_ms") * hop / 1000).alias("overlap_s"))


def frame_agreement(ref: DataFrame, hyp: DataFrame, keys: Sequence[str] = CALL, hop: int = 10) -> DataFrame:
    """Precision, recall and F1 of one segmentation against another on the bin grid."""
    keys = list(keys)
    r, h = bin_spans(ref, keys, hop), bin_spans(hyp, keys, hop)
    n = lambda d, c: d.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(c))
    j = (n(r, "in_ref").join(n(h, "in_hyp"), keys, "full").join(intersection_duration(r, h, keys), keys, "left")
         .fillna(0, subset=["in_ref", "in_hyp", "shared_ms"]))
    tp = F.col("shared_ms")
    g = j.select(*keys, safe_div(tp, F.col("in_hyp"), 0.0).alias("precision"), safe_div(tp, F.col("in_ref"), 0.0).alias("recall"))
    return g.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


# ------------------------------------------------------------------------------ speaking states

def speaking_states(norm: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Sweep of normalised turns: state 0 silence, 1 caller, 2 agent, 3 both, equal neighbours joined.

    ``agent_start_ms`` is the start of the latest agent turn at the segment's start.
    """
    keys = list(keys)
    ch = F.col("channel")
    # two points per turn: no second read of the turns
    points = norm.select(*keys, F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.when(ch == 0, 1).otherwise(0).alias("d0"),
                 F.when(ch == 1, 1).otherwise(0).alias("d1"), F.when(ch == 1, F.col("start_ms")).alias("agent")),
        F.struct(F.col("end_ms").alias("t"), F.when(ch == 0, -1).otherwise(0).alias("d0"),
                 F.when(ch == 1, -1).otherwise(0).alias("d1"), F.lit(None).cast("bigint").alias("agent")))).alias("e"))
    points = points.select(*keys, "e.*")
    zero = calls.select(*keys, F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("d0"), F.lit(0).alias("d1"),
                        F.lit(None).cast("bigint").alias("agent"))
    g = points.unionByName(zero).groupBy(*keys, "t").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"),
                                                         F.max("agent").alias("agent"))
    w = W.partitionBy(*keys).orderBy("t")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    s = g.select(*keys, "t", (bool_int(F.sum("d0").over(run) > 0) + 2 * bool_int(F.sum("d1").over(run) > 0)).alias("state"),
                 F.last("agent", ignorenulls=True).over(run).alias("agent_start_ms"))
    s = s.join(calls.select(*keys, "duration_ms"), keys).where(F.col("t") < F.col("duration_ms"))
    s = s.withColumn("__prev", F.lag("state").over(w)).where(F.col("__prev").isNull() | (F.col("__prev") != F.col("state")))
    return s.select(*keys, F.col("t").alias("start_ms"),
                    F.coalesce(F.lead("t").over(w), F.col("duration_ms")).alias("end_ms"), "state", "agent_start_ms")


# ------------------------------------------------------------------------------ per-call statistics

def silence_stats(regions: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Leading, trailing and speech seconds of disjoint regions; a call without any is all silence."""
    keys = list(keys)
    g = regions.groupBy(*keys).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"),
                                   F.sum(F.col("end_ms") - F.col("start_ms")).alias("s"), F.count(F.lit(1)).alias("n"))
    d, s, n = F.col("duration_ms"), F.coalesce("s", F.lit(0)), F.coalesce("n", F.lit(0))
    return calls.join(g, keys, "left").select(
        *keys, (F.coalesce("a", d) / 1000).alias("leading_silence_s"),
        ((d - F.coalesce("b", F.lit(0))) / 1000).alias("trailing_silence_s"), (s / 1000).alias("speech_s"),
        safe_div(s, d, 0.0).alias("speech_fraction"), n.alias("n_regions"), safe_div(s / 1000, n, 0.0).alias("mean_region_s"))


def response_latency_simple(norm: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Caller start minus the latest agent end at or before it, where there is one."""
    keys = list(keys)
    is_agent = F.col("channel") == 1
    ev = norm.select(*keys, F.when(is_agent, F.col("end_ms")).otherwise(F.col("start_ms")).alias("t"),
                     F.when(is_agent, 0).otherwise(1).alias("kind"),
                     F.when(is_agent, F.col("end_ms")).alias("agent_end"))
    w = W.partitionBy(*keys).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    r = ev.withColumn("agent_end", F.max("agent_end").over(w)).where((F.col("kind") == 1) & F.col("agent_end").isNotNull())
    return r.select(*keys, F.col("t").alias("onset_ms"), (F.col("t") - F.col("agent_end")).alias("latency_ms"))


def turn_stats(norm: DataFrame, calls: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """The twelve turn numbers of a call: counts, seconds, caller extremes, response latency, overlap."""
    keys = list(keys)
    caller, d = F.col("channel") == 0, (F.col("end_ms") - F.col("start_ms")) / 1000
    own = lambda c: F.when(caller, c)
    g = norm.groupBy(*keys).agg(
        F.count_if(caller).alias("n_caller_turns"), F.count_if(~caller).alias("n_agent_turns"),
        F.sum(own(d)).alias("caller_speech_s"), F.sum(F.when(~caller, d)).alias("agent_speech_s"),
        F.avg(own(d)).alias("mean_caller_turn_s"), F.max(own(d)).alias("max_caller_turn_s"),
        F.min(own(F.col("start_ms") / 1000)).alias("first_caller_start_s"),
        F.max(own(F.col("end_ms") / 1000)).alias("last_caller_end_s"))
    lat = response_latency_simple(norm, keys).groupBy(*keys).agg(
        (F.median("latency_ms") / 1000).alias("median_response_latency_s"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("latency_ms") / 1000).alias("std_response_latency_s"))
    ov = overlap_seconds(norm.where(caller), norm.where(~caller), keys)
    j = calls.join(g, keys, "left").join(lat, keys, "left").join(ov, keys, "left")
    j = j.fillna(0, subset=["n_caller_turns", "n_agent_turns", "caller_speech_s", "agent_speech_s", "overlap_s",
                            "mean_caller_turn_s", "max_caller_turn_s", "last_caller_end_s"])
    j = j.withColumn("first_caller_start_s", F.coalesce("first_caller_start_s", F.col("duration_ms") / 1000))
    return j.withColumn("caller_speech_fraction", F.col("caller_speech_s") * 1000 / F.col("duration_ms")).select(
        *keys, "n_caller_turns", "n_agent_turns", "caller_speech_s", "agent_speech_s", "caller_speech_fraction",
        "mean_caller_turn_s", "max_caller_turn_s", "first_caller_start_s", "last_caller_end_s",
        "median_response_latency_s", "std_response_latency_s", "overlap_s")


# ------------------------------------------------------------------------------ comparing segmentations

def segment_match(ref: DataFrame, hyp: DataFrame, keys: Sequence[str] = CHANNEL, min_iou: float = 0.1) -> DataFrame:
    """Segments paired when each is the other's best overlap (IoU at least ``min_iou``)."""
    keys = list(keys)
    o = tiled_overlaps(ref, hyp, keys).groupBy(*keys, "a_start", "a_end", "b_start", "b_end").agg(F.sum("shared_ms").alias("i"))
    iou = F.col("i") / (F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start") - F.col("i"))
    o = o.withColumn("iou", iou).where(F.col("iou") >= min_iou)
    best_a = F.row_number().over(W.partitionBy(*keys, "a_start").orderBy(F.desc("iou"), "b_start"))
    best_b = F.row_number().over(W.partitionBy(*keys, "b_start").orderBy(F.desc("iou"), "a_start"))
    return o.withColumns({"ra": best_a, "rb": best_b}).where("ra = 1 and rb = 1").select(
        *keys, "a_start", "a_end", "b_start", "b_end", "iou")


def segment_match_summary(pairs: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("iou").alias("mean_iou"),
        (F.avg(F.abs(F.col("a_start") - F.col("b_start"))) / 1000).alias("onset_mae_s"),
        (F.avg(F.abs(F.col("a_end") - F.col("b_end"))) / 1000).alias("offset_mae_s"))


def edge_distances(ref: DataFrame, hyp: DataFrame, keys: Sequence[str] = CALL) -> DataFrame:
    """Distance of every reference edge to the nearest hypothesis edge, by carrying edges both ways."""
    keys = list(keys)

    def edges(d, is_ref):
        return d.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("t"), F.lit(is_ref).alias("is_ref"))

    u = edges(ref, True).unionByName(edges(hyp, False)).withColumn("h", F.when(~F.col("is_ref"), F.col("t")))
    w = W.partitionBy(*keys).orderBy("t")
    back = W.partitionBy(*keys).orderBy(F.desc("t"))  # a growing frame in reverse order, not a shrinking one
    prev = F.last("h", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0))
    nxt = F.last("h", ignorenulls=True).over(back.rangeBetween(W.unboundedPreceding, 0))
    e = u.withColumns({"p": prev, "n": nxt}).where("is_ref")
    return e.select(*keys, "t", F.least(F.col("t") - F.col("p"), F.col("n") - F.col("t")).alias("error_ms"))


def boundary_error(ref: DataFrame, hyp: DataFrame, within_ms: int = 100) -> DataFrame:
    """Median, mean and share within ``within_ms`` of all boundary errors; integer errors collapse first."""
    e = edge_distances(ref, hyp).withColumn("__k", F.lit(1))
    m = quantiles(e, ["__k"], "error_ms", {"median_ms": .5})
    a = e.groupBy("__k").agg(F.count(F.lit(1)).alias("boundaries"), F.avg("error_ms").alias("mean_ms"),
                             F.avg(F.coalesce(F.col("error_ms") <= within_ms, F.lit(False)).cast("double")).alias("within"))
    return a.join(m, "__k", "left").drop("__k")


# ------------------------------------------------------------------------------ chunks and packing

def chunk_regions(regions: DataFrame, keys: Sequence[str] = CALL, chunk_ms: int = 4000, min_ms: int = 1000,
                  max_chunks: int | None = None) -> DataFrame:
    """Disjoint regions cut into pieces that never cross a border; all of a call, or its first ``max_chunks``."""
    keys = list(keys)
    length = F.col("end_ms") - F.col("start_ms")
    pieces = regions.where(length >= min_ms).select(*keys, "start_ms", "end_ms", F.explode(
        F.sequence(F.lit(0), F.floor(length / chunk_ms).cast("int"))).alias("i"))
    s = F.col("start_ms") + F.col("i") * chunk_ms
    e = F.least(s + chunk_ms, F.col("end_ms"))
    pieces = pieces.select(*keys, s.alias("start_ms"), e.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= min_ms)
    if max_chunks:
        w = W.partitionBy(*keys).orderBy("start_ms")
        return pieces.withColumn("chunk", F.row_number().over(w)).where(F.col("chunk") <= max_chunks)
    minute = F.floor(F.col("start_ms") / 60_000)
    return scan(pieces.withColumn("__one", F.lit(1)), keys, minute, ["start_ms"], {"chunk": ("sum", "__one")}).drop("__one")


PACK_BLOCK = 4096


def _successors(d: DataFrame, keys: list[str], max_ms: int) -> DataFrame:
    """For each segment ``(idx, before, after)`` (its number and the voice before and after it) the first one that no longer fits a pack starting with it, in ``nxt``."""
    span = F.lit(max(64 * max_ms, 1)).cast("bigint")
    seg = d.select(*keys, (-F.col("after")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("asker"), F.lit(None).cast("bigint").alias("from"),
                   F.struct(F.col("idx").alias("idx"), F.col("before").alias("before")).alias("seg"))
    ask = d.select(*keys, (-(F.col("before") + max_ms)).alias("at"), F.lit(0).alias("kind"), F.col("idx").alias("asker"), F.col("before").alias("from"),
                   F.lit(None).cast("struct<idx:bigint,before:bigint>").alias("seg"))
    # from the right: what lies beyond the question's place has come up before it, the nearest last; of equal places the first segment counts
    both = seg.unionByName(ask).withColumn("order", F.when(F.col("kind") == 1, -F.col("seg.idx")).otherwise(F.lit(-(1 << 62)).cast("bigint")))
    r = scan(both, keys, F.floor(F.col("at") / span), ["at", "order"], {"first": ("last", "seg")}, inclusive=False).where("kind = 0")
    # a pack that holds nothing yet takes even what does not fit
    nxt = F.when(F.col("first.before") > F.col("from"), F.col("first.idx")).otherwise(F.col("first.idx") + 1)
    return r.select(*keys, F.col("asker").alias("idx"), nxt.alias("nxt"))


def pack_segments(segs: DataFrame, keys: Sequence[str] = CALL, max_ms: int = 20_000) -> DataFrame:
    """Greedy runs of consecutive disjoint segments with at most ``max_ms`` of voice; adds ``pack``.

    Each fill depends on the one before. Every segment first finds, by running sums and an as-of search, where a pack that starts with it would end. Within blocks of
    ``PACK_BLOCK`` segments these jumps are followed to the block's border; over blocks they are doubled until the blocks' entries are known, in a number of rounds
    that is the logarithm of a call's blocks (none for a call of one block). No call is held by one task.
    """
    from ..session import checkpoint_dir
    keys = list(keys)
    checkpoint_dir(segs.sparkSession)
    voice = (F.col("end_ms") - F.col("start_ms")).cast("bigint")
    d = segs.select(*keys, "start_ms", "end_ms", voice.alias("voice"), F.lit(1).cast("bigint").alias("one"))
    d = scan(d, keys, F.floor(F.col("start_ms") / TILE), ["start_ms", "end_ms"], {"number": ("sum", "one"), "before": ("sum<", "voice")})
    d = d.select(*keys, "start_ms", "end_ms", (F.col("number") - 1).alias("idx"), F.col("before").cast("bigint").alias("before"), (F.col("before") + F.col("voice")).cast("bigint").alias("after")).checkpoint()
    n = d.groupBy(*keys).agg(F.max("idx").alias("final"))
    jumps = _successors(d, keys, max_ms).join(n, keys).select(*keys, "idx", F.when(F.col("nxt") <= F.col("final"), F.col("nxt")).alias("nxt"), F.floor(F.col("idx") / PACK_BLOCK).alias("blk")).checkpoint()
    types = ", ".join(f"`{k}` {segs.schema[k].dataType.simpleString()}" for k in keys)

    def borders(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("idx")
        first, m = int(t["idx"].iat[0]), len(t)
        nxt = t["nxt"].fillna(-1).to_numpy(np.int64)
        out = nxt.copy()
        for i in range(m - 1, -1, -1):
            j = nxt[i] - first
            if nxt[i] >= 0 and j < m:
                out[i] = out[j]
        t = t[[*keys, "idx"]].assign(out=pd.array(np.where(out < 0, 0, out), "Int64"))
        t.loc[out < 0, "out"] = pd.NA
        return t

    entries = d.where("idx = 0").select(*keys, F.col("idx").alias("entry"))
    if not d.where(F.col("idx") >= PACK_BLOCK).isEmpty():
        far = jumps.groupBy(*keys, "blk").applyInPandas(borders, f"{types}, idx bigint, out bigint").where("out is not null").checkpoint()
        known = 0
        while True:
            reached = entries.withColumnRenamed("entry", "idx").join(far, [*keys, "idx"]).select(*keys, F.col("out").alias("entry"))
            entries = entries.unionByName(reached).distinct().checkpoint()
            now = entries.count()
            if now == known:
                break
            known = now
            far = far.join(far.select(*keys, F.col("idx").alias("out"), F.col("out").alias("further")), [*keys, "out"]).select(*keys, "idx", F.col("further").alias("out")).checkpoint()
    entries = entries.withColumn("blk", F.floor(F.col("entry") / PACK_BLOCK))

    def starts(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("idx")
        first, m = int(t["idx"].iat[0]), len(t)
        nxt, flag = t["nxt"].fillna(-1).to_numpy(np.int64), np.zeros(m, np.int64)
        i = -1 if pd.isna(t["entry"].iat[0]) else int(t["entry"].iat[0])
        while first <= i < first + m:
            flag[i - first] = 1
            i = int(nxt[i - first])
        return t[[*keys, "idx"]].assign(starts=flag)

    marked = jumps.join(entries, [*keys, "blk"], "left").groupBy(*keys, "blk").applyInPandas(starts, f"{types}, idx bigint, starts bigint")
    j = d.join(marked, [*keys, "idx"])
    packed = scan(j, keys, F.floor(F.col("idx") / PACK_BLOCK), ["idx"], {"packs": ("sum", "starts")})
    return packed.select(*keys, "start_ms", "end_ms", (F.col("packs") - 1).cast("bigint").alias("pack"))


def compact_timeline(segs: DataFrame, keys: Sequence[str] = CALL, join_ms: int = 500) -> DataFrame:
    """Where each kept segment lands when silences shrink to ``join_ms`` joins."""
    w = W.partitionBy(*keys).orderBy("start_ms").rowsBetween(W.unboundedPreceding, -1)
    d = F.col("end_ms") - F.col("start_ms")
    at = F.coalesce(F.sum(d + join_ms).over(w), F.lit(0))
    return segs.select(*keys, at.alias("compact_ms"), "start_ms", d.alias("length_ms"))


def to_original(points: DataFrame, timeline: DataFrame, keys: Sequence[str] = CALL, t: str = "t_ms") -> DataFrame:
    """Compacted times back on the call's clock; a time inside a join clamps to the segment's end."""
    keys = list(keys)
    p = points.select(*keys, F.col(t).alias("t"), F.lit(True).alias("is_point"), F.lit(None).cast("struct<c:bigint,o:bigint,d:bigint>").alias("seg"))
    m = timeline.select(*keys, F.col("compact_ms").alias("t"), F.lit(False).alias("is_point"),
                        F.struct(F.col("compact_ms").alias("c"), F.col("start_ms").alias("o"), F.col("length_ms").alias("d")).alias("seg"))
    w = W.partitionBy(*keys).orderBy("t", "is_point").rowsBetween(W.unboundedPreceding, 0)
    j = p.unionByName(m).withColumn("seg", F.last("seg", ignorenulls=True).over(w)).where("is_point")
    inside = F.least(F.greatest(F.col("t") - F.col("seg.c"), F.lit(0)), F.col("seg.d"))
    return j.select(*keys, F.col("t").alias(t), (F.col("seg.o") + inside).alias("original_ms"))


def jitter_turns(turns: DataFrame, calls: DataFrame, seed: int, by_ms: int = 32) -> DataFrame:
    """Both edges moved by up to ``by_ms`` either way, fixed by the turn and the seed, then normalised again."""
    ids = [F.col("call_id"), F.col("channel"), F.col("start_ms"), F.col("end_ms"), F.lit(seed)]
    move = lambda which: F.floor(hash_uniform(*ids, F.lit(which)) * (2 * by_ms + 1)) - by_ms
    d = turns.join(calls.select("call_id", "duration_ms"), "call_id")
    s = F.greatest(F.lit(0), F.least(F.col("start_ms") + move("start"), F.col("duration_ms") - 1))
    e = F.least(F.col("duration_ms"), F.greatest(s + 1, F.col("end_ms") + move("end")))
    return normalize_turns(d.select("call_id", "channel", s.alias("start_ms"), e.alias("end_ms")), calls)
