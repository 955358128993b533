"""Files, logs, streams, guards and fits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.operators import models as O
from talkgrid.operators import plugins as G
from talkgrid.operators import text as T
from talkgrid.plans.tables import Tables
from talkgrid.sources import audio as S
from talkgrid.sources import corpus as C
from talkgrid.sources import logs as L
from talkgrid.streaming import log as SL
from talkgrid.streaming.verdict import running_verdict


def test_manifest_turns_words_and_rubric_files(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("anon_id,label,split,duration_s\ncall_01,human,train,10.5\ncall_02,synthetic,val,20\ncall_03,human,val,30\n")
    bad = spark.createDataFrame([("call_03",)], "call_id string")
    c = C.scan_calls(spark, str(tmp_path / "manifest.csv"), bad)
    assert {(r.call_id, r.y, r.duration_ms) for r in c.collect()} == {("call_01", 0, 10500), ("call_02", 1, 20000)}
    assert all(r.violations == 0 for r in C.validate_calls(c).collect())
    d = tmp_path / "turns"
    d.mkdir()
    (d / "call_01.json").write_text(json.dumps({"turns": [{"channel": 0, "start": 12.4, "end": 15.1}, {"channel": 2, "start": 1, "end": 2}, {"channel": 1, "start": 5, "end": 5}]}))
    good, quarantined = C.split_turns(C.scan_turns(spark, str(d)))
    assert [(r.call_id, r.start_ms, r.end_ms) for r in good.collect()] == [("call_01", 12400, 15100)]
    assert {r.reason for r in quarantined.collect()} == {"channel", "order"}
    a = tmp_path / "asr"
    a.mkdir()
    words = [{"text": "hola", "start": 1.0, "end": 1.2, "type": "word", "logprob": -0.1}, {"text": " ", "start": 1.2, "end": 1.3, "type": "spacing", "logprob": 0.0}]
    (a / "call_01_ch1.json").write_text(json.dumps({"words": words}))
    assert [(r.call_id, r.channel, r.text) for r in C.scan_words(spark, str(a)).collect()] == [("call_01", 1, "hola")]
    r = tmp_path / "rubric"
    r.mkdir()
    (r / "call_01_model-x_y_abc.json").write_text(json.dumps({"scores": {"iniciativa": {"score": 1.4, "evidencia": "e"}}}))
    got = C.scan_rubric(spark, str(r)).first()
    assert (got.call_id, got.model, got.prompt, got.score) == ("call_01", "model-x_y", "abc", 1.0)


def test_recordings_and_their_rejects(spark, tmp_path):
    x = np.zeros((8000, 2))
    x[2000:4000, 0] = 0.5
    ok = S.encode_recording(x)
    (tmp_path / "good.wav").write_bytes(ok)
    (tmp_path / "cut.wav").write_bytes(ok[:-100])
    (tmp_path / "junk.wav").write_bytes(b"not a recording")
    (tmp_path / "wide.wav").write_bytes(ok[:22] + b"\x01" + ok[23:])
    f = S.wav_frames(S.scan_recordings(spark, str(tmp_path)))
    reasons = {r.call_id: r.reason for r in f.where("reason is not null").collect()}
    assert set(reasons) == {"cut", "junk", "wide"} and reasons["junk"] == "container" and reasons["cut"] == "truncated"
    g = f.where("call_id = 'good' and channel = 0").orderBy("frame_idx").collect()
    assert len(g) == 99 and g[30].rms_db == pytest.approx(20 * np.log10(.5), abs=1e-6) and g[0].rms_db == pytest.approx(-180)
    spec = S.spectrum(S.scan_recordings(spark, str(tmp_path)).where("call_id = 'good'"))
    assert S.band_edge(spec).where("channel = 0").first().band_edge_hz < 100


def test_payload_fields(spark):
    rows = [(1, json.dumps({"wav_base64": "data:audio/wav;base64,aGk="})), (2, "aGk="), (3, json.dumps({"x": "y"})), (4, json.dumps({"blob": "aGkh" * 30})), (5, "%%%")]
    got = {r.id: (bytes(r.content) if r.content is not None else None, r.reason) for r in S.decode_payloads(spark.createDataFrame(rows, "id int, body string")).collect()}
    assert got[1] == (b"hi", None) and got[2] == (b"hi", None) and got[3][1] == "empty" and got[4][0] == b"hi!" * 30 and got[5][1] == "not_base64"


def test_log_sinks_and_manifest_layout(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", "seen", "ok", 1), ("a", "train", "seen", "ok", 2), ("b", "val", "seen", "failed", 1)],
                                 "sample_id string, split string, family string, status string, created_at int")
    L.write_manifest(rows, str(tmp_path / "m"))
    assert [(r.sample_id, r.created_at) for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [("a", 2)]
    L.log_experiment(spark, str(tmp_path / "x"), "run", auc=.98765, n=3)
    L.log_experiment(spark, str(tmp_path / "x"), "again")
    got = {r.title: r.params for r in spark.read.parquet(str(tmp_path / "x")).collect()}
    assert got == {"run": {"auc": "0.9877", "n": "3"}, "again": {}}
    ev = spark.createDataFrame([('{"call_id":"c","is_synthetic":true,"confidence":0.5}',), ('{"call_id":"c","is_synthetic":"maybe","confidence":0.5}',)], "body string")
    L.detection_sink(ev, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).first().problem == "type"


def test_stale_feature_tables(spark):
    c = spark.createDataFrame([(1, "train", 0), (2, "val", 1)], "call_id int, split string, y int")
    assert C.feature_table_problems(c, c, {"v": 1}, {"v": 1}).count() == 0
    moved = c.withColumn("split", F.lit("train"))
    assert {r.problem for r in C.feature_table_problems(moved, c, {"v": 1}, {"v": 2}).collect()} == {"missing_or_changed", "unknown_or_changed", "stale_config"}


def test_annotated_transcript(spark):
    w = spark.createDataFrame([(1, 0, 0, "hola", 0.0, .5, 0.0), (1, 0, 1, "bueno", .6, .9, 0.0), (1, 1, 0, "sí", 1.0, 1.2, 0.0), (1, 0, 2, "o", 5.0, 5.1, 0.0), (1, 0, 3, "sea.", 5.2, 5.4, -.2)],
                              "call_id int, channel int, pos int, text string, start_s double, end_s double, logprob double")
    a = T.annotate(w).orderBy("line").collect()
    assert [r.text for r in a] == ["[CALLER  0:00.00] hola bueno", "[AGENT   0:01.00] sí", "[CALLER  0:05.00] o sea."]
    assert [r.silence_s for r in a] == [None, None, pytest.approx(3.8)]
    f = T.transcript_features(w.where("channel = 0")).first()
    assert f.disfluency_rate == pytest.approx(2 / 4) and f.mean_sentence_len == 4 and f.logprob_low_frac == .25


# ------------------------------------------------------------------------------ streams

LOG = "id bigint, at timestamp, verdict string, latency_ms double, ok boolean"


def run(spark, df, tmp_path, name):
    q = (df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def files(spark, tmp_path, schema, *batches):
    d = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(d))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(d))


def test_live_log_drops_repeats(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    a = [(i, t0 + timedelta(minutes=i), "human", 1.0, True) for i in range(5)]
    s = files(spark, tmp_path, LOG, a, [(3, t0 + timedelta(minutes=20), "human", 2.0, True), (9, t0 + timedelta(minutes=21), "human", 1.0, True)])
    q = SL.append_log(SL.live_log(s), str(tmp_path / "log"), str(tmp_path / "log-c"), once=True)
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [0, 1, 2, 3, 4, 9]


def test_running_verdict_reorders_and_settles(spark, tmp_path):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    row = lambda call, k, s, minute: (call, k, (k - 1) * 5.0, (k - 1) * 5.0 + 4, s, t0 + timedelta(minutes=minute))
    schema = "call_id bigint, chunk bigint, start_s double, end_s double, score double, at timestamp"
    s = files(spark, tmp_path, schema, [row(1, 2, 3.0, 1), row(2, 1, -1.0, 1)], [row(1, 1, 2.0, 2), row(1, 1, 2.0, 2)], [row(1, 3, -1.0, 3)], [row(3, 1, 0.0, 90)], [row(4, 1, 0.0, 180)])
    got = run(spark, running_verdict(s, "10 minutes"), tmp_path, "v")
    one = got.where("call_id = 1 and not settled").orderBy("chunk").collect()
    assert [(r.chunk, r.caller_speech_s) for r in one] == [(1, 4.0), (2, 8.0), (3, 12.0)]
    assert [r.p for r in one] == pytest.approx([1 / (1 + np.exp(-m)) for m in (2.0, 2.5, 4 / 3)], abs=1e-4)
    assert [r.first_confident for r in one] == [True, False, False]
    end = got.where("settled").collect()
    assert {r.call_id for r in end} >= {1, 2} and [r.chunk for r in end if r.call_id == 1] == [3]


def test_quarantine_is_rerun_safe(spark, tmp_path):
    w = SL.quarantine_writer(str(tmp_path / "g"), str(tmp_path / "q"))
    b = spark.createDataFrame([('{"call_id":"c","is_synthetic":true,"confidence":0.5}',), ("x",)], "body string")
    w(b, 4)
    w(b, 4)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1 and spark.read.parquet(str(tmp_path / "q")).count() == 1


# ------------------------------------------------------------------------------ fits

@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    n = 400
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 2)) + y[:, None] * [1.5, 0]
    rows = [(i, int(y[i]), "val" if i % 4 == 0 else "train", float(x[i, 0]), None if i % 5 == 0 else float(x[i, 1]), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "call_id bigint, y int, split string, a double, b double, flat double").cache()


def test_preparation_uses_training_rows_only(table):
    tr = table.where("split = 'train'")
    m = O.prepare(tr, ["a", "b", "flat"], min_observed=20)
    assert m.names == ["a", "b"] and m.flagged == [1]
    b = np.array([r.b for r in tr.where("b is not null").collect()])
    assert m.impute[1] == pytest.approx(np.median(b))
    z = tr.select(F.posexplode(m.terms()).alias("i", "z")).groupBy("i").agg(F.avg("z"), F.stddev_pop("z")).collect()
    assert all(abs(r[1]) < .05 and r[2] == pytest.approx(1, abs=.05) for r in z)


def test_logistic_matches_its_optimum(table):
    tr = table.where("split = 'train'")
    m = O.fit_logistic(tr, ["a", "b"], c=1.0, balanced=False)
    rows = tr.select("y", m.terms().alias("z"), m.logit().alias("s")).collect()
    z, y = np.array([r.z for r in rows]), np.array([r.y for r in rows])
    p = 1 / (1 + np.exp(-np.array([r.s for r in rows])))
    grad = z.T @ (p - y) + np.array(m.coef)  # stationary point of C * loss + |w|^2 / 2
    assert np.abs(grad).max() < .05 and abs((p - y).sum()) < .05
    auc = {r.split: r.auc for r in O.frozen_evaluation(table, m).collect()}
    assert auc["val"] > .75


def test_served_recipe_is_calibrated(table):
    m = O.fit_behaviour(table.where("split = 'train'"), ["a", "b", "flat"], seed=3)
    assert m.slope > 0 and "flat" not in m.names
    r = table.where("split = 'train'").select(F.avg(m.probability()), F.avg("y")).first()
    assert r[0] == pytest.approx(r[1], abs=.05)


def test_permuted_labels_carry_nothing(table):
    tr = table.where("split = 'train'")
    p = O.permuted_labels(tr, 4)
    assert p.count() == tr.count() and p.agg(F.sum("y")).first() == tr.agg(F.sum("y")).first()
    assert p.join(tr.select("call_id", F.col("y").alias("y0")), "call_id").where("y <> y0").count() > 50


def test_temperature_and_platt(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=3000) * 2
    y = rng.random(3000) < 1 / (1 + np.exp(-s / 2))
    df = spark.createDataFrame([(i, int(b), float(a)) for i, (a, b) in enumerate(zip(s, y))], "call_id bigint, y int, score double")
    assert O.fit_temperature(df)["temperature"] == pytest.approx(2, rel=.2)
    assert O.fit_platt(df)["a"] == pytest.approx(.5, rel=.2)
    assert O.choose_calibration(df)["a"] == pytest.approx(.5, rel=.2)


def test_failing_layer_abstains(spark):
    calls = spark.createDataFrame([(1, 2.0), (2, 0.0)], "call_id bigint, x double")
    r = {x.call_id: x for x in G.layer("k", lambda row: (1 / row["x"], 1.0))(calls).collect()}
    assert (r[1].probability, r[1].abstained) == (.5, False) and r[2].abstained and "ZeroDivision" in r[2].reason


def test_hot_call_at_scale_of_the_fixture(spark, sf_dir):
    """A third of all turns in one call changes no other call's result."""
    from talkgrid.operators import events as E
    t = Tables(spark, sf_dir)
    hot = t.turns().withColumn("call_id", F.when(F.col("start_ms") % 3 == 0, 999_999).otherwise(F.col("call_id")))
    calls = hot.select("call_id").distinct().withColumn("duration_ms", F.lit(2_592_000).cast("bigint"))
    both = E.behaviour_features(hot, calls)
    alone = E.behaviour_features(hot.where("call_id <> 999999"), calls.where("call_id <> 999999"))
    assert both.where("call_id <> 999999").exceptAll(alone).count() == 0
    assert both.where("call_id = 999999").count() == 1


def test_spectra_and_descriptors_of_tones(spark):
    t = np.arange(8000) / 8000
    low, high = .5 * np.sin(2 * np.pi * 500 * t), .5 * np.sin(2 * np.pi * 3000 * t)
    df = spark.createDataFrame([("a", bytearray(S.encode_recording(np.stack([low, high], axis=1))))], "call_id string, content binary")
    sp = S.spectrum(df).cache()
    st = {r.channel: r for r in S.spectral_stats(sp).collect()}
    assert st[0].centroid_hz == pytest.approx(500, abs=10) and st[1].centroid_hz == pytest.approx(3000, abs=10)
    assert st[0].rolloff95_hz == pytest.approx(500, abs=20) and st[0].hf_ratio_db < -40
    edge = {r.channel: r.band_edge_hz for r in S.band_edge(sp).collect()}
    assert edge[0] == pytest.approx(500, abs=40) and edge[1] == pytest.approx(3000, abs=40)
    same = S.spectral_distance(sp, sp).collect()
    assert all(r.distance_db == 0 for r in same)
    d = {r.channel: r for r in S.descriptor_stats(S.frame_descriptors(df)).collect()}
    assert d[0].zcr_mean == pytest.approx(2 * 500 / 8000, rel=.05) and d[1].zcr_mean == pytest.approx(2 * 3000 / 8000, rel=.05)
    assert d[0].centroid_mean == pytest.approx(500, abs=15) and d[0].flatness_mean < .01
    lv = {r.channel: r for r in S.level_stats(S.level_partials(df)).collect()}
    assert lv[0].rms_db == pytest.approx(20 * np.log10(.5 / np.sqrt(2)), abs=.01) and abs(lv[0].channel_correlation) < .01


def test_results_of_many_short_recordings_leave_in_small_pieces(spark, monkeypatch):
    import pandas as pd

    from talkgrid.sources import audio

    made, rec = [], spark.createDataFrame([("a", b"")], "call_id string, content binary")
    regions = spark.createDataFrame([("a", 0, 30)], "call_id string, start_ms int, end_ms int")
    monkeypatch.setattr(type(rec), "mapInPandas", lambda self, run, schema: made.append(run))
    audio.wav_frames(rec)
    audio.frame_descriptors(rec)
    audio.caller_speech(rec, regions)
    x = np.linspace(-.5, .5, 640)
    good = audio.encode_recording(np.stack([x, x / 2], axis=1))
    batch = pd.DataFrame({"call_id": [str(i) for i in range(1000)], "content": [good if i % 2 else b"none" for i in range(1000)], "starts": None, "ends": None})
    for run in made:
        pieces = [p.call_id.nunique() for p in run([batch, batch[:0]])]
        assert sum(pieces) == 1000 and max(pieces) <= 256


def test_spectra_in_one_row_give_what_bins_give(spark):
    from talkgrid.sources import audio as S
    draw = np.random.default_rng(4)
    wav = lambda n: bytes(S.encode_recording(draw.uniform(-0.5, 0.5, (n, 2))))
    d = spark.createDataFrame([("1", wav(900)), ("2", wav(2000)), ("2", wav(700)), ("3", b"no recording"), ("4", wav(1)), (None, wav(800))], "call_id string, content binary")
    after = lambda t: t.withColumn("call_id", (F.col("call_id").cast("bigint") - 1).cast("string"))
    found = []
    for t in (S.spectrum(d), S.spectra(d)):
        t = t.where("reason is null")
        found.append({(r.call_id, r.channel): (round(r.distance_db, 9), r.band_edge_hz) for r in S.spectral_distance(t, after(t)).join(S.band_edge(t), ["call_id", "channel"]).collect()})
    assert found[0] == found[1] and ("1", 0) in found[0]
    assert S.spectra(d).count() < 16
