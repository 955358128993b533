"""Turns, states, events and frames on small, hand-checked calls."""

import random

import pytest
from pyspark.sql import functions as F

from talkgrid.functions.feature_sets import ALL_BEHAVIOUR, BEHAVIOUR_SETS
from talkgrid.operators import events as E
from talkgrid.operators import intervals as I
from talkgrid.operators import segmentation as S

TURN = "call_id bigint, channel int, start_ms bigint, end_ms bigint"


def calls(spark, *durations_ms):
    return spark.createDataFrame([(i, d) for i, d in enumerate(durations_ms)], "call_id bigint, duration_ms bigint")


def turns(spark, *rows):
    """(call, channel, start s, end s)"""
    return spark.createDataFrame([(c, ch, round(a * 1000), round(b * 1000)) for c, ch, a, b in rows], TURN)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_union_per_channel_and_states(spark):
    t = turns(spark, (0, 0, 1, 2), (0, 0, 1.5, 3), (0, 0, 3.1, 4), (0, 1, 1.5, 2.5))
    c = calls(spark, 3500)
    n = I.normalize_turns(t, c)
    assert rows(n, "channel", "start_ms") == [(0, 0, 1000, 3500), (0, 1, 1500, 2500)]
    st = I.speaking_states(n, c).select("start_ms", "end_ms", "state")
    assert rows(st, "start_ms") == [(0, 1000, 0), (1000, 1500, 1), (1500, 2500, 3), (2500, 3500, 1)]


def test_union_does_not_depend_on_tiles(spark):
    rng = random.Random(5)
    data = []
    for call in range(6):
        for _ in range(60):
            a = rng.randrange(0, 20_000)
            data.append((call, rng.randrange(2), a, a + rng.randrange(1, 4000)))
    df = spark.createDataFrame(data, TURN)

    def brute(gap):
        out = []
        for key in sorted({(r[0], r[1]) for r in data}):
            cur = None
            for _, _, a, b in sorted(r for r in data if (r[0], r[1]) == key):
                if cur and a <= cur[1] + gap:
                    cur[1] = max(cur[1], b)
                else:
                    cur = [a, b]
                    out.append((*key, cur))
        return sorted((k, ch, s, e) for k, ch, (s, e) in out)

    for tile in (700, 5000, 1_000_000):
        for gap in (0, 150):
            assert rows(I.merge_intervals(df, gap=gap, tile=tile), "call_id", "channel", "start_ms") == brute(gap)


def test_interruption_with_recovery(spark):
    c = calls(spark, 7000)
    n = I.normalize_turns(turns(spark, (0, 0, 1, 4), (0, 1, 3.5, 5), (0, 0, 5.3, 6)), c)
    r = E.interruptions(E.turn_context(n, c)).first()
    assert (r.onset_ms, r.stop_latency_ms, r.yielded, r.immediate_yield) == (3500, 500, True, True)
    assert (r.recovery_ms, r.recovery_gap_ms, r.retake) == (1300, 300, True)


def test_recovery_blocked_by_next_agent_turn(spark):
    c = calls(spark, 9000)
    n = I.normalize_turns(turns(spark, (0, 0, 1, 3), (0, 1, 2, 4), (0, 1, 5, 6), (0, 0, 7, 8)), c)
    r = E.interruptions(E.turn_context(n, c)).first()
    assert r.yielded and r.recovery_ms is None and r.recovery_gap_ms is None and r.retake is None


def test_response_latency(spark):
    c = calls(spark, 15_000)
    st = I.speaking_states(I.normalize_turns(turns(spark, (0, 1, 8, 10), (0, 0, 10.35, 12)), c), c)
    assert rows(E.responses(st), "onset_ms") == [(0, 10350, 350, 2000)]


def test_simultaneous_onsets_are_no_event(spark):
    c = calls(spark, 6000)
    ctx = E.turn_context(I.normalize_turns(turns(spark, (0, 0, 1, 3), (0, 1, 1.03, 4)), c), c)
    assert E.interruptions(ctx).count() == 0 and E.barge_ins(ctx).count() == 0


@pytest.mark.parametrize("duration,expected", [(7000, (1000, 1000, True)), (4500, (None, None, None))])
def test_barge_in_and_its_censoring(spark, duration, expected):
    c = calls(spark, duration)
    r = E.barge_ins(E.turn_context(I.normalize_turns(turns(spark, (0, 1, 1, 5), (0, 0, 4, 6)), c), c)).first()
    assert (r.overlap_ms, r.lead_ms, r.continues) == expected


def test_one_interior_gap(spark):
    c = calls(spark, 12_000)
    st = I.speaking_states(I.normalize_turns(turns(spark, (0, 1, 3, 4), (0, 0, 7, 8)), c), c)
    assert rows(E.extended_gaps(st), "onset_ms") == [(0, 4000, 3000, True)]


def test_summaries_need_evidence(spark):
    d = spark.createDataFrame([(1, "a", x) for x in (1.0, 2.0, 3.0)] + [(1, "b", x) for x in (.2, .3)] + [(1, "c", 0.0)] * 3,
                              "call_id int, metric string, value double")
    s = {r.metric: r for r in E.summarize(d).collect()}
    assert (s["a"].std, s["a"].iqr, s["a"].cv) == (1.0, 1.0, 0.5)
    assert s["b"]["count"] == 2 and s["b"].std is None
    assert s["c"].std == 0.0 and s["c"].cv is None


def test_feature_columns_and_time_shift(spark):
    assert len(ALL_BEHAVIOUR) == 51 and len(set(ALL_BEHAVIOUR)) == 51
    base = [(0, 1, 1), (4, 0, 3), (3.5, 1, 5), (5.3, 0, 6), (8, 1, 10), (10.4, 0, 12), (15, 1, 16), (16.2, 0, 17)]
    spans = [(0, ch, a, b) for (a, ch, b) in [(1, 1, 3), (3.4, 0, 4.5), (4, 1, 5), (5.3, 0, 6), (8, 1, 10), (10.35, 0, 12), (15, 1, 16), (16.2, 0, 17)]]
    shifted = [(1, ch, a + 5, b + 5) for _, ch, a, b in spans]
    c = calls(spark, 20_000, 25_000)
    f = {r.call_id: r for r in E.behaviour_features(turns(spark, *spans, *shifted), c).collect()}
    for name in BEHAVIOUR_SETS["consistency"]:
        assert f[0][name] == pytest.approx(f[1][name]) if f[0][name] is not None else f[1][name] is None, name
    assert base  # the spans above are the same conversation


def test_calls_without_turns_are_kept(spark):
    c = calls(spark, 5000)
    f = E.evidence_quality(E.behaviour_features(turns(spark).limit(0), c)).first()
    assert f.leading_silence_s == 5.0 and f.caller_turn_count == 0 and f.quality == 0.0 and f.response_latency_count == 0
    assert f.interruption_rate is None and f.caller_turn_mean is None
    assert f.silence_s == 5.0


def stepwise(probs, duration, thr=.5, hyst=.15, min_sil=160, min_sp=160, pad=32, gap=150, frame=32):
    """The rule frame by frame, in whole milliseconds."""
    begin = pending = None
    found = []
    for i, p in enumerate(probs):
        t = i * frame
        if t >= duration:
            break
        if p >= thr:
            pending = None
            begin = t if begin is None else begin
        elif begin is not None and p < thr - hyst:
            pending = t if pending is None else pending
            if t - pending >= min_sil:
                if pending - begin >= min_sp:
                    found.append((begin, pending))
                begin = pending = None
    if begin is not None and duration - begin >= min_sp:
        found.append((begin, duration))
    out = []
    for a, b in ((max(0, a - pad), min(duration, b + pad)) for a, b in found):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_hysteresis_against_the_stepwise_rule(spark):
    rng = random.Random(11)
    series, data, lengths = {}, [], []
    for call in range(60):
        n, level = rng.randrange(1, 120), 0.5
        probs = []
        for _ in range(n):
            level = min(1, max(0, level + rng.uniform(-.25, .25)))
            probs.append(round(float(level), 2))
        series[call] = probs
        lengths.append((call, n * 32 - rng.randrange(0, 32)))
        data += [(call, 0, i, p) for i, p in enumerate(probs)]
    frames = spark.createDataFrame(data, "call_id bigint, channel int, frame_idx bigint, p double")
    ln = spark.createDataFrame(lengths, "call_id bigint, length_ms bigint")
    got = {}
    for r in S.hysteresis_vad(frames, ln).orderBy("call_id", "start_ms").collect():
        got.setdefault(r.call_id, []).append((r.start_ms, r.end_ms))
    for call, length in lengths:
        assert got.get(call, []) == stepwise(series[call], length), call


def test_chunks_stay_inside_regions(spark):
    r = spark.createDataFrame([(0, 0, 9500), (0, 10_000, 10_900), (0, 20_000, 24_500)], "call_id bigint, start_ms bigint, end_ms bigint")
    assert rows(I.chunk_regions(r).select("start_ms", "end_ms"), "start_ms") == [(0, 4000), (4000, 8000), (8000, 9500), (20_000, 24_000)]


def test_packing_is_greedy(spark):
    r = spark.createDataFrame([(0, s, s + d) for s, d in ((0, 9000), (10_000, 9000), (20_000, 5000), (30_000, 25_000), (60_000, 100))],
                              "call_id bigint, start_ms bigint, end_ms bigint")
    assert [x.pack for x in I.pack_segments(r).orderBy("start_ms").collect()] == [0, 0, 1, 2, 3]


def test_empty_segmentations_agree(spark):
    c = spark.createDataFrame([(0,)], "call_id bigint")
    nothing = turns(spark).limit(0)
    assert I.speech_iou(nothing, nothing, c).first().iou == 1.0


def test_jitter_is_reproducible_and_bounded(spark):
    c = calls(spark, 20_000)
    t = turns(spark, (0, 0, 1, 2), (0, 0, 5, 6), (0, 1, 8, 9))
    a, b = (rows(I.jitter_turns(t, c, 3), "channel", "start_ms") for _ in range(2))
    assert a == b and a != rows(I.jitter_turns(t, c, 4), "channel", "start_ms")
    for (_, _, s, e), (s0, e0) in zip(a, ((1000, 2000), (5000, 6000), (8000, 9000))):
        assert abs(s - s0) <= 32 and abs(e - e0) <= 32


def test_energy_regions(spark):
    db = [-70] * 100 + [-20] * 50 + [-70] * 10 + [-20] * 50 + [-70] * 100 + [-20] * 10 + [-70] * 80
    f = spark.createDataFrame([(0, 0, i, float(x)) for i, x in enumerate(db)], "call_id bigint, channel int, frame_idx bigint, rms_db double")
    ln = spark.createDataFrame([(0, 4010)], "call_id bigint, length_ms bigint")
    assert rows(S.energy_vad(f, ln), "start_ms") == [(0, 0, 900, 2210)]


def test_many_copies_of_a_turn_cost_one_row(spark):
    one = turns(spark, (0, 0, 1, 2), (0, 1, 3, 4))
    many = one.join(spark.range(5000).select(F.lit(0).cast("bigint").alias("call_id")), "call_id")
    c = calls(spark, 6000)
    assert rows(I.normalize_turns(many, c), "start_ms") == rows(I.normalize_turns(one, c), "start_ms")
