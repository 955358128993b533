"""A running verdict per call while its chunks arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["call_id", "chunk", "call_time_s", "caller_speech_s", "p", "confident", "first_confident", "gap", "settled", "missing"]
OUTPUT = ("call_id {kind}, chunk bigint, call_time_s double, caller_speech_s double, p double, confident boolean, "
          "first_confident boolean, gap boolean, settled boolean, missing bigint")
STATE = "n bigint, acc double, speech double, sure boolean, last_time double, p double, chunks array<bigint>, ends array<double>, spans array<double>, scores array<double>"


def running_verdict(chunks: DataFrame, delay: str = "10 minutes", a: float = 1.0, b: float = 0.0, hi: float = 0.85, lo: float = 0.15) -> DataFrame:
    """``chunks(call_id, chunk, start_s, end_s, score, at)`` to one row per chunk, in order.

    The state of a call is its count, score sum and seconds of speech, and only the chunks that came before their turn. When
    event time passes a call by ``delay`` it is closed: chunks still waiting behind a gap come out in order, flagged
    ``gap``, then one ``settled`` row over all chunks heard, with the number ``missing``. A chunk that comes twice counts once.
    A chunk of a call already settled opens it anew and comes out, flagged, when that settles.
    """
    minutes, unit = delay.split()
    wait_ms = int(float(minutes) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1000)
    kind = chunks.schema["call_id"].dataType.simpleString()

    def heard(call, number, ends, spans, scores, n, acc, speech, sure, gap) -> tuple[pd.DataFrame, float, float, bool, float]:
        """Rows of chunks taken up in order, after ``n`` others; and the sums after them."""
        sums = np.cumsum(np.concatenate(([acc], scores)))[1:]
        speeches = np.cumsum(np.concatenate(([speech], spans)))[1:]
        z = np.clip(a * sums / (n + 1 + np.arange(len(number))) + b, -40.0, 40.0)
        p = 1.0 / (1.0 + np.exp(-z))
        conf = (p >= hi) | (p <= lo)
        first = conf & (np.cumsum(conf) == 1) & (not sure)
        rows = pd.DataFrame({"call_id": call, "chunk": number, "call_time_s": [round(x, 2) for x in ends.tolist()], "caller_speech_s": [round(x, 2) for x in speeches.tolist()],
                             "p": [round(x, 4) for x in p.tolist()], "confident": conf, "first_confident": first, "gap": gap, "settled": False, "missing": 0}, columns=COLUMNS)
        return rows, float(sums[-1]), float(speeches[-1]), bool(sure or conf.any()), float(p[-1])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, acc, speech, sure, last, p = 0, 0.0, 0.0, False, None, 0.5
        number, ends, spans, scores = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0)
        if state.exists:
            n, acc, speech, sure, last, p, *held = state.get
            number, ends, spans, scores = np.array(held[0], np.int64), *(np.array(h, float) for h in held[1:])
        if state.hasTimedOut:
            state.remove()
            total = n + len(number)
            newest = int(number[-1]) if len(number) else n
            if len(number):
                rows, acc, speech, sure, p = heard(key[0], number, ends, spans, scores, n, acc, speech, sure, True)
                last = float(ends[-1])
                yield rows
            yield pd.DataFrame([(key[0], newest, last, round(speech, 2), round(p, 4), p >= hi or p <= lo, False, False, True, newest - total)], columns=COLUMNS)
            return
        parts = [t for t in batches if len(t)]
        newest = 0
        if parts:
            t = pd.concat(parts, ignore_index=True)
            newest = int(t["at"].max().timestamp() * 1000)
            number = np.concatenate((number, t["chunk"].to_numpy(np.int64)))
            ends = np.concatenate((ends, t["end_s"].to_numpy(float)))
            spans = np.concatenate((spans, (t["end_s"] - t["start_s"]).to_numpy(float)))
            scores = np.concatenate((scores, t["score"].to_numpy(float)))
            number, first = np.unique(number, return_index=True)
            first, number = first[number > n], number[number > n]
            ends, spans, scores = ends[first], spans[first], scores[first]
            run = int((number == n + 1 + np.arange(len(number))).cumprod().sum())
            if run:
                rows, acc, speech, sure, p = heard(key[0], number[:run], ends[:run], spans[:run], scores[:run], n, acc, speech, sure, False)
                n, last = n + run, float(ends[run - 1])
                number, ends, spans, scores = number[run:], ends[run:], spans[run:], scores[run:]
                yield rows
        state.update((n, acc, speech, sure, last, p, number.tolist(), ends.tolist(), spans.tolist(), scores.tolist()))
        state.setTimeoutTimestamp(max(newest + wait_ms, state.getCurrentWatermarkMs() + 1))

    w = chunks.withWatermark("at", delay)
    return w.groupBy("call_id").applyInPandasWithState(step, OUTPUT.format(kind=kind), STATE, "append", GroupStateTimeout.EventTimeTimeout)
