"""Recordings to frame tables. Spark reads and spreads the files; numpy decodes one recording at a time."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

RATE = 8000
#: A piece of results is handed on once it has so many rows or comes from so many recordings: the results of one recording are a small table with an overhead of its own.
EMIT_ROWS, EMIT_RECORDINGS = 50_000, 256
# fixed values: the field names a request may carry its audio in
PAYLOAD_FIELDS = ("audio", "wav", "audio_base64", "file", "data", "audio_b64", "base64", "wav_base64")


def scan_recordings(spark: SparkSession, path: str) -> DataFrame:
    from .corpus import file_stem
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return f.select(file_stem(F.col("path")).alias("call_id"), "content")


def decode_payloads(requests: DataFrame, body: str = "body") -> DataFrame:
    """Audio bytes of JSON requests: a known field, else the first string over 100 characters, else the body itself."""
    b = F.trim(F.col(body))
    fields = F.from_json(b, "map<string,string>")
    known = F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in PAYLOAD_FIELDS])
    long = F.get(F.filter(F.map_values(fields), lambda v: F.length(v) > 100), F.lit(0))
    text = F.when(b.startswith("{"), F.coalesce(known, long)).otherwise(F.regexp_replace(b, '^"|"$', ""))
    bare = F.when(text.startswith("data:"), F.substring_index(text, ",", -1)).otherwise(text)
    content = F.try_to_binary(F.regexp_replace(bare, r"\s", ""), F.lit("base64"))
    reason = F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, "empty").when(content.isNull(), "not_base64")
    return requests.withColumns({"content": content, "reason": reason})


def riff_chunks(content: bytes) -> dict[bytes, tuple[int, int]] | None:
    """Where each chunk of a RIFF/WAVE file begins and how long it says it is; None if it is no such file. The first of a name counts."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    found, at = {}, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        found.setdefault(name, (at + 8, size))
        at += 8 + size + size % 2
    return found


def decode_pcm(content: bytes):
    """``(samples[n, 2], None)`` of a stereo 8 kHz 16-bit recording of any length, or ``(None, reason)``."""
    chunks = riff_chunks(content)
    if not chunks or b"fmt " not in chunks or chunks[b"fmt "][1] < 16 or b"data" not in chunks:
        return None, "container"
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, chunks[b"fmt "][0])
    if tag not in (1, 0xFFFE) or (channels, rate, bits) != (2, RATE, 16):
        return None, "format"
    at, size = chunks[b"data"]
    if size < 4:
        return None, "empty"
    if at + size > len(content):
        return None, "truncated"
    return np.frombuffer(content, "<i2", size // 4 * 2, at).reshape(-1, 2) / 32768.0, None


def _framed(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    if len(x) < n:
        x = np.pad(x, (0, n - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, n)[::hop]


def _per_recording(build, schema: str):
    """A mapInPandas body that decodes one recording at a time; rejects pass as rows.

    Results are handed on in pieces of about ``EMIT_ROWS`` rows, or of ``EMIT_RECORDINGS`` recordings, however long or short the recordings are.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        ready, size = [], 0
        for batch in batches:
            for call_id, content in zip(batch["call_id"], batch["content"]):
                samples, reason = decode_pcm(bytes(content)) if content is not None else (None, "empty")
                out = pd.DataFrame({"reason": [reason]}) if reason else build(samples)
                out.insert(0, "call_id", call_id)
                ready.append(out.reindex(columns=names))
                size += len(out)
                if size >= EMIT_ROWS or len(ready) >= EMIT_RECORDINGS:
                    yield pd.concat(ready, ignore_index=True)
                    ready, size = [], 0
        if ready:
            yield pd.concat(ready, ignore_index=True)

    return run


FRAME_SCHEMA = "call_id string, channel int, frame_idx bigint, t_s double, rms_db double, peak double, length_ms bigint, reason string"


def wav_frames(recordings: DataFrame, frame_ms: int = 20, hop_ms: int = 10) -> DataFrame:
    """RMS level per frame and channel; a refused recording gives one row with its reason."""
    n, hop = frame_ms * RATE // 1000, hop_ms * RATE // 1000

    def build(x):
        parts = []
        for ch in (0, 1):
            f = _framed(x[:, ch], n, hop)
            parts.append(pd.DataFrame({
                "channel": ch, "frame_idx": np.arange(len(f)), "t_s": hop * np.arange(len(f)) / RATE,
                "rms_db": 20 * np.log10(np.sqrt((f ** 2).mean(axis=1)) + 1e-9), "peak": np.abs(f).max(axis=1),
                "length_ms": len(x) * 1000 // RATE}))
        return pd.concat(parts, ignore_index=True).assign(reason=None)

    return recordings.select("call_id", "content").mapInPandas(_per_recording(build, FRAME_SCHEMA), FRAME_SCHEMA)


LEVEL_SCHEMA = ("call_id string, channel int, n bigint, sum_x double, sum_xx double, peak double, n_clip bigint, n_clip_strict bigint, "
                "n_zero bigint, sum_xy double, reason string")


def level_partials(recordings: DataFrame, part_s: int = 60) -> DataFrame:
    """Sums per channel and minute of audio; :func:`level_stats` adds them up."""

    def build(x):
        rows = []
        for s in range(0, len(x), part_s * RATE):
            p = x[s:s + part_s * RATE]
            xy = float((p[:, 0] * p[:, 1]).sum())
            for ch in (0, 1):
                v, a = p[:, ch], np.abs(p[:, ch])
                rows.append((ch, len(v), v.sum(), (v ** 2).sum(), a.max(), (a >= .99).sum(), (a >= .999).sum(), (v == 0).sum(), xy))
        cols = ["channel", "n", "sum_x", "sum_xx", "peak", "n_clip", "n_clip_strict", "n_zero", "sum_xy"]
        return pd.DataFrame(rows, columns=cols).assign(reason=None)

    return recordings.select("call_id", "content").mapInPandas(_per_recording(build, LEVEL_SCHEMA), LEVEL_SCHEMA)


def level_stats(partials: DataFrame) -> DataFrame:
    """Level, peak, clipping, offset and zero share per channel, and the correlation of the two channels."""
    p = partials.where("reason is null")
    n = F.sum("n")
    g = p.groupBy("call_id", "channel").agg(
        n.alias("n"), (20 * F.log10(F.sqrt(F.sum("sum_xx") / n) + 1e-9)).alias("rms_db"), F.max("peak").alias("peak"),
        (F.sum("n_clip") / n).alias("clip_fraction"), (F.sum("n_clip_strict") / n).alias("clip_fraction_strict"),
        (F.sum("sum_x") / n).alias("dc_offset"), (F.sum("n_zero") / n).alias("zero_fraction"))
    s = lambda ch, c: F.sum(F.when(F.col("channel") == ch, F.col(c)))
    m = s(0, "n")
    cov = s(0, "sum_xy") / m - s(0, "sum_x") * s(1, "sum_x") / (m * m)
    var = lambda ch: s(ch, "sum_xx") / m - s(ch, "sum_x") * s(ch, "sum_x") / (m * m)
    c = p.groupBy("call_id").agg(F.coalesce(cov / F.nullif(F.sqrt(F.greatest(var(0) * var(1), F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("channel_correlation"))
    return g.join(c, "call_id")


SPECTRUM_SCHEMA = "call_id string, channel int, bin int, hz double, power double, n_frames bigint, reason string"


SPECTRA_SCHEMA = "call_id string, channel int, power array<double>, n_frames bigint, reason string"


def spectra(recordings: DataFrame, n_fft: int = 512, hop: int = 256) -> DataFrame:
    """The same as :func:`spectrum`, one row per channel with the powers of all its bins."""

    def build(x):
        win, parts = np.hanning(n_fft + 1)[:-1], []
        for ch in (0, 1):
            f = _framed(x[:, ch], n_fft, hop)
            power = np.zeros(n_fft // 2 + 1)
            for s in range(0, len(f), 4096):
                power += (np.abs(np.fft.rfft(f[s:s + 4096] * win, axis=1)) ** 2).sum(axis=0)
            parts.append({"channel": ch, "power": power / len(f), "n_frames": len(f)})
        return pd.DataFrame(parts).assign(reason=None)

    decoded = _per_recording(build, SPECTRA_SCHEMA)

    def run(batches):
        for out in decoded(batches):
            power = out["power"].astype(object)
            yield out.assign(power=power.where(power.notna(), None))  # a reject has no list

    return recordings.select("call_id", "content").mapInPandas(run, SPECTRA_SCHEMA)


def spectrum(recordings: DataFrame, n_fft: int = 512, hop: int = 256) -> DataFrame:
    """Mean power per frequency bin and channel."""

    def build(x):
        win = np.hanning(n_fft + 1)[:-1]
        parts = []
        for ch in (0, 1):
            f = _framed(x[:, ch], n_fft, hop)
            power = np.zeros(n_fft // 2 + 1)
            for s in range(0, len(f), 4096):
                power += (np.abs(np.fft.rfft(f[s:s + 4096] * win, axis=1)) ** 2).sum(axis=0)
            parts.append(pd.DataFrame({"channel": ch, "bin": np.arange(len(power)), "hz": np.arange(len(power)) * RATE / n_fft,
                                       "power": power / len(f), "n_frames": len(f)}))
        return pd.concat(parts, ignore_index=True).assign(reason=None)

    return recordings.select("call_id", "content").mapInPandas(_per_recording(build, SPECTRUM_SCHEMA), SPECTRUM_SCHEMA)


SPEECH_SCHEMA = ("call_id string, power array<double>, n_frames bigint, speech_rms_db double, noise_floor_db double, snr_db double, reason string")


def caller_speech(recordings: DataFrame, regions: DataFrame, n_fft: int = 512, hop: int = 256, frame_ms: int = 20, hop_ms: int = 10) -> DataFrame:
    """Per call the caller's mean spectrum over speech, speech level, noise floor (10th percentile of the frame levels) and their distance.

    ``regions(call_id, start_ms, end_ms)`` are the caller's speech; without any, or where no frame starts in one, everything counts. They meet
    the frames in the decoder, so a recording is read once and no frame is written. A call's regions are disjoint, so its length bounds them.
    """
    mine = regions.groupBy(F.col("call_id").cast("string").alias("call_id")).agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms"))).alias("r"))
    d = recordings.select(F.col("call_id").cast("string").alias("call_id"), "content").join(mine, "call_id", "left").select(
        "call_id", "content", F.transform("r", lambda x: x["start_ms"].cast("double")).alias("starts"), F.transform("r", lambda x: x["end_ms"].cast("double")).alias("ends"))
    names = [c.split()[0] for c in SPEECH_SCHEMA.split(", ")]
    level = lambda v: 20 * np.log10(np.sqrt((v ** 2).mean(axis=-1)) + 1e-9)

    def inside(t, starts, ends):
        at = np.searchsorted(starts, t, "right") - 1
        return (at >= 0) & (t < ends[np.maximum(at, 0)]) if len(starts) else np.zeros(len(t), bool)

    def build(x, starts, ends):
        win, power, n = np.hanning(n_fft + 1)[:-1], np.zeros(n_fft // 2 + 1), 0
        f = _framed(x, n_fft, hop)
        keep = inside(np.arange(len(f)) * hop * 1000.0 / RATE, starts, ends)
        keep = np.flatnonzero(keep if keep.any() else ~keep)
        for s in range(0, len(keep), 4096):
            power += (np.abs(np.fft.rfft(f[keep[s:s + 4096]] * win, axis=1)) ** 2).sum(axis=0)
            n += len(keep[s:s + 4096])
        spoken = inside(np.arange(len(x)) * 1000.0 / RATE, starts, ends)
        frames = _framed(x, frame_ms * RATE // 1000, hop_ms * RATE // 1000)
        levels = np.concatenate([level(frames[s:s + 65536]) for s in range(0, len(frames), 65536)])
        rms, floor = float(level(x[spoken] if spoken.any() else x)), float(np.percentile(levels, 10))
        return power / n, n, rms, floor, rms - floor, None

    def run(batches):
        for batch in batches:
            rows = []
            for call_id, content, starts, ends in zip(batch["call_id"], batch["content"], batch["starts"], batch["ends"]):
                samples, reason = decode_pcm(bytes(content)) if content is not None else (None, "empty")
                some = starts is not None
                rows.append((call_id, *((None,) * 5 + (reason,) if reason else build(samples[:, 0], np.asarray(starts if some else [], float), np.asarray(ends if some else [], float)))))
                if len(rows) >= EMIT_RECORDINGS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return d.mapInPandas(run, SPEECH_SCHEMA)


def caller_speech_stats(speech: DataFrame, n_fft: int = 512) -> DataFrame:
    """Roll-off, centroid and high-band ratio of :func:`caller_speech`, beside its levels."""
    bins = speech.where("reason is null").select("call_id", F.lit(0).alias("channel"), F.posexplode("power").alias("bin", "power"), F.lit(None).cast("string").alias("reason"))
    stats = spectral_stats(bins.withColumn("hz", F.col("bin") * (RATE / n_fft)))
    return speech.where("reason is null").select("call_id", "n_frames", "speech_rms_db", "noise_floor_db", "snr_db").join(stats.drop("channel"), "call_id")


def spectral_stats(spec: DataFrame) -> DataFrame:
    """95% roll-off, centroid and high-band ratio of a spectrum table (a few hundred bins per channel)."""
    keys = ["call_id", "channel"]
    s = spec.where("reason is null")
    w = W.partitionBy(*keys)
    c = s.withColumns({"cum": F.sum("power").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "tot": F.sum("power").over(w)})
    band = lambda lo, hi: F.sum(F.when((F.col("hz") >= lo) & (F.col("hz") < hi), F.col("power")).otherwise(0.0))
    hf = 10 * F.log10(band(3400, 4000) / F.greatest(band(300, 3400), F.lit(1e-12)) + 1e-12)
    return c.groupBy(*keys).agg(
        F.min(F.when(F.col("cum") / F.greatest("tot", F.lit(1e-12)) >= 0.95, F.col("hz"))).alias("rolloff95_hz"),
        (F.sum(F.col("hz") * F.col("power")) / F.greatest(F.sum("power"), F.lit(1e-12))).alias("centroid_hz"), hf.alias("hf_ratio_db"))


def spectral_distance(a: DataFrame, b: DataFrame, keys=("call_id", "channel")) -> DataFrame:
    """Root mean square difference of two log spectra in dB, of tables with a row per bin or, where there is no ``bin``, with all powers of a channel in one row."""
    db = lambda c: 10 * F.log10(F.col(c) + 1e-14)
    if "bin" not in a.columns:
        j = a.select(*keys, F.col("power").alias("pa")).join(b.select(*keys, F.col("power").alias("pb")), list(keys))
        off = lambda x, y: F.pow(10 * F.log10(x + 1e-14) - 10 * F.log10(y + 1e-14), 2)
        square = F.aggregate(F.zip_with("pa", "pb", off), F.lit(0.0), lambda s, x: s + x)
        return j.select(*keys, square.alias("square"), F.size("pa").alias("bins")).groupBy(*keys).agg(F.sqrt(F.sum("square") / F.sum("bins")).alias("distance_db"))
    j = a.select(*keys, "bin", F.col("power").alias("pa")).join(b.select(*keys, "bin", F.col("power").alias("pb")), [*keys, "bin"])
    d = db("pa") - db("pb")
    return j.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("distance_db"))


def band_edge(spec: DataFrame, drop_db: float = 20.0, keys=("call_id", "channel"), n_fft: int = 512) -> DataFrame:
    """Highest frequency within ``drop_db`` of the spectrum's peak; rows per bin, or all powers of a channel (of ``n_fft`` points) in one row."""
    if "bin" not in spec.columns:
        s = spec.where("reason is null").select(*keys, F.transform("power", lambda x: 10 * F.log10(x + 1e-14)).alias("db"))
        for k in keys:
            s = s.where(F.col(k).isNotNull())
        s = s.withColumn("top", F.max(F.array_max("db")).over(W.partitionBy(*keys)))
        near = F.transform("db", lambda x, i: F.when(x >= F.col("top") - drop_db, i))
        return s.groupBy(*keys).agg((F.max(F.array_max(near)) * (RATE / n_fft)).alias("band_edge_hz"))
    db = 10 * F.log10(F.col("power") + 1e-14)
    s = spec.where("reason is null").withColumn("db", db)
    top = s.groupBy(*keys).agg(F.max("db").alias("top"))
    return s.join(top, list(keys)).groupBy(*keys).agg(F.max(F.when(F.col("db") >= F.col("top") - drop_db, F.col("hz"))).alias("band_edge_hz"))


DESCRIPTOR_SCHEMA = ("call_id string, channel int, frame_idx bigint, zcr double, centroid double, bandwidth double, rolloff double, "
                     "flatness double, reason string")


def frame_descriptors(recordings: DataFrame, n_fft: int = 512, hop: int = 256) -> DataFrame:
    """Zero crossings, centroid, bandwidth, 85% roll-off and flatness per frame."""

    def build(x):
        win, hz = np.hanning(n_fft + 1)[:-1], np.arange(n_fft // 2 + 1) * RATE / n_fft
        parts = []
        for ch in (0, 1):
            f = _framed(x[:, ch], n_fft, hop)
            for s in range(0, len(f), 4096):
                g = f[s:s + 4096]
                mag = np.abs(np.fft.rfft(g * win, axis=1))
                tot = np.maximum(mag.sum(axis=1), 1e-12)
                cen = (mag * hz).sum(axis=1) / tot
                bw = np.sqrt((mag * (hz - cen[:, None]) ** 2).sum(axis=1) / tot)
                roll = hz[(np.cumsum(mag, axis=1) >= 0.85 * mag.sum(axis=1)[:, None]).argmax(axis=1)]
                p = np.maximum(mag ** 2, 1e-10)
                sign = np.signbit(g)
                parts.append(pd.DataFrame({
                    "channel": ch, "frame_idx": s + np.arange(len(g)), "zcr": (sign[:, 1:] != sign[:, :-1]).sum(axis=1) / n_fft,
                    "centroid": cen, "bandwidth": bw, "rolloff": roll,
                    "flatness": np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1)}))
        return pd.concat(parts, ignore_index=True).assign(reason=None)

    return recordings.select("call_id", "content").mapInPandas(_per_recording(build, DESCRIPTOR_SCHEMA), DESCRIPTOR_SCHEMA)


def descriptor_stats(frames: DataFrame) -> DataFrame:
    cols = ["zcr", "centroid", "bandwidth", "rolloff", "flatness"]
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return frames.where("reason is null").groupBy("call_id", "channel").agg(*aggs)


def encode_recording(samples: np.ndarray) -> bytes:
    """Stereo samples in [-1, 1] as a recording, for fixtures."""
    data = (np.clip(samples, -1, 32767 / 32768) * 32768).astype("<i2").tobytes()
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 2, RATE, RATE * 4, 4, 16, b"data", len(data))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data
