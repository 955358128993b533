"""Nothing is refused, dropped or broken by length, infinities, gaps or the type of an id."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.functions.ordered import cumulative, numbered, quantiles, scan
from talkgrid.operators import fusion as U, intervals as I, joins as J, metrics as M, models as O, plugins as G, vectors as V
from talkgrid.sources.audio import decode_pcm


def test_infinite_and_missing_values_rank(spark):
    inf, nan = float("inf"), float("nan")
    d = spark.createDataFrame([(1, x) for x in (0.1, inf, -inf, 0.3, nan, None, 0.9, -1e308, 5e-324)], "k int, v double")
    assert quantiles(d, ["k"], "v", {"m": 0.5, "lo": 0.0, "hi": 1.0}).first()[1:] == (0.1, -inf, inf)
    rows = cumulative(d, ["k"], "v", {"n": F.count(F.lit(1))}).orderBy("v").collect()
    assert [(r.v, r.cum_n) for r in rows] == [(v, i) for i, v in enumerate((-inf, -1e308, 5e-324, 0.1, 0.3, 0.9, inf))]
    s = spark.createDataFrame([(0, -inf), (0, 0.2), (1, 0.7), (1, inf), (1, nan)], "y int, score double").withColumn("k", F.lit(1))
    assert M.evaluate(s, ["k"]).first().auc == 1.0


def test_long_calls_keep_all_chunks(spark):
    r = spark.createDataFrame([(1, 0, i * 5000, i * 5000 + 4000) for i in range(500)], "call_id bigint, channel int, start_ms bigint, end_ms bigint")
    c = I.chunk_regions(r, ["call_id"])
    assert c.count() == 500 and [x.chunk for x in c.orderBy("start_ms").collect()] == list(range(1, 501))
    assert I.chunk_regions(r, ["call_id"], max_chunks=60).count() == 60


def test_shrinking_gaps_all_pair(spark):
    # alternating sides, every gap smaller than the one before: one pair a round
    values, at, gap = [], 0.0, 40.0
    for i in range(8):
        values.append((i, at))
        at, gap = at + gap, gap * 0.8
    rows = spark.createDataFrame(values, "call_id bigint, v double")
    got = J.matched_pairs(rows.where("call_id % 2 = 0"), rows.where("call_id % 2 = 1"), "v", 100.0)
    assert got.count() == 4


def recording(samples, rate=8000, channels=2, extra=b""):
    data = np.asarray(samples, "<i2").tobytes()
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVE" + fmt + extra + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def test_recordings_of_any_length():
    x = np.zeros((8000 * 601, 2), np.int16)
    x[5] = (16384, -16384)
    got, reason = decode_pcm(recording(x, extra=struct.pack("<4sI", b"LIST", 3) + b"abc\0"))
    assert reason is None and got.shape == x.shape and got[5].tolist() == [0.5, -0.5]
    assert decode_pcm(recording(x[:4], rate=16000))[1] == "format" and decode_pcm(recording(x[:4], channels=1))[1] == "format"
    assert decode_pcm(recording(x[:0]))[1] == "empty" and decode_pcm(recording(x[:9])[:-3])[1] == "truncated"
    assert decode_pcm(b"")[1] == decode_pcm(b"RIFF....WAVEdata")[1] == decode_pcm(b"x" * 100)[1] == "container"


def test_string_ids(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] = x[3]
    rows = [(f"call_{i:03x}", i % 2, "val" if i < 10 else "train", x[i].tolist()) for i in range(40)]
    calls = spark.createDataFrame(rows, "call_id string, y int, split string, vec array<double>")
    for r in V.nearest_train_neighbour(calls).collect():
        i = int(r.call_id[5:], 16)
        assert r.neighbour == max((f"call_{j:03x}" for j in range(10, 40) if j % 2 == i % 2), key=lambda c: x[i] @ x[int(c[5:], 16)])
    assert V.near_duplicates(calls.withColumn("split", F.when(F.col("call_id") == "call_003", "val").otherwise("train"))).first().train_id == "call_007"
    c = {r.call_id: r.cluster for r in V.connected_components(calls, V.similarity_edges(calls, 0.999)).collect()}
    assert c["call_007"] == "call_003" and c["call_001"] == "call_001"
    s = G.layer("acoustic", lambda row: (0.25, 1.0))(calls.select("call_id"))
    assert {(r.call_id, r.probability) for r in s.collect()} == {(r[0], 0.25) for r in rows}


def test_a_stream_accounts_for_every_chunk(spark, tmp_path):
    from talkgrid.streaming.verdict import running_verdict
    schema = "call_id string, chunk bigint, start_s double, end_s double, score double, at timestamp"
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("call_a", c, 9.0 * c, 9.0 * c + 2, 2.0, at(c)) for c in (1, 3, 4, 4)] + [("call_b", c, 0.0, 2.0, -1.0, at(c)) for c in (2, 1)] + [("clock", 1, 0.0, 1.0, 0.0, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    v = running_verdict(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes")
    q = v.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "off")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(v.schema).parquet(str(tmp_path / "out")).where("call_id <> 'clock'").collect()
    a = sorted((r.settled, r.chunk, r.gap, r.missing) for r in got if r.call_id == "call_a")
    assert a == [(False, 1, False, 0), (False, 3, True, 0), (False, 4, True, 0), (True, 4, False, 1)]
    b = sorted((r.settled, r.chunk, r.gap, r.missing) for r in got if r.call_id == "call_b")
    assert b == [(False, 1, False, 0), (False, 2, False, 0), (True, 2, False, 0)]
    assert next(r.p for r in got if r.call_id == "call_a" and r.settled) == pytest.approx(1 / (1 + math.exp(-2)), abs=1e-4)


@pytest.mark.parametrize("block", [4096, 16])
def test_packing_of_a_call_with_a_third_of_all_segments(spark, monkeypatch, block):
    """A call of 1,500 segments among 100 short ones; small blocks make it cross many borders."""
    import random
    monkeypatch.setattr(I, "PACK_BLOCK", block)
    rng = random.Random(6)
    calls = {0: [rng.randrange(0, 9000) for _ in range(1500)], 1: [0, 0, 25_000, 1, 0, 19_999, 1], 2: [30_000, 30_000], 3: [20_000, 0, 1]}
    calls |= {i: [rng.randrange(100, 25_000) for _ in range(rng.randrange(1, 40))] for i in range(4, 100)}
    rows, want = [], {}
    for c, lengths in calls.items():
        at = pack = acc = 0
        for n, d in enumerate(lengths):
            rows.append((c, at, at + d))
            if n and acc > 0 and acc + d > 20_000:
                pack, acc = pack + 1, 0
            acc += d
            want[c, at] = pack
            at += d + 500
    df = spark.createDataFrame(rows, "call_id bigint, start_ms bigint, end_ms bigint").repartition(8)
    got = {(r.call_id, r.start_ms): r.pack for r in I.pack_segments(df).collect()}
    assert got == want


def test_old_days_go_and_kept_files_stay(spark, tmp_path):
    import datetime as dt
    import os

    from talkgrid.operators.calllog import prune_partitions
    path = str(tmp_path / "log")
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, 6 * (i % 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, at timestamp").withColumn("date", F.to_date("at"))
    df.write.partitionBy("date").parquet(path)
    before = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    gone = prune_partitions(spark, path, "2024-01-10 12:00:00", 5)
    assert gone == [f"2024-01-0{d}" for d in (1, 2, 3, 4)]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i, at in rows if at >= dt.datetime(2024, 1, 5, 12)]
    after = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    assert set(after) == {d for d in before if d >= "date=2024-01-05"} and all(after[d] == before[d] for d in after if d > "date=2024-01-05")
    assert prune_partitions(spark, path, "2024-01-10 12:00:00", 5) == []
    assert prune_partitions(spark, path, "2024-01-11 00:00:00", 5) == ["2024-01-05"]
    assert prune_partitions(spark, path, "2024-03-01 00:00:00", 5) and True


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_ordinary_and_hot_keys(spark):
    values = [(k, i * 7 % n) for k, n in ((1, 3), (2, 40), (3, 1)) for i in range(n)] + [(None, 1), (2, None)]
    d = spark.createDataFrame(values, "k int, v int")
    by_blocks = scan(d.withColumn("one", F.lit(1)), ["k"], F.col("v").cast("bigint"), ["v"], {"i": ("sum", "one")})
    want = {(r.k, r.v): r.i for r in by_blocks.collect()}
    # the row without value counts before the others of its key
    assert want == {(k, v): v + 1 + (k == 2) for k, v in values if k is not None and v is not None}
    for hot in (5, 1000):  # the key of 40 rows is numbered by blocks, then by the window
        got = {(r.k, r.v): r.i for r in numbered(d, ["k"], F.col("v").cast("bigint"), ["v"], "i", hot).collect()}
        assert got == want


def layers_of(spark, n):
    rows = [(c, k, 0.1 * (c % 9) + 0.05, 0.5, c % 4 == 0 and k == "behaviour", True) for c in range(n) for k in ("acoustic", "behaviour", "semantic")]
    return spark.createDataFrame(rows, "call_id bigint, key string, probability double, quality double, abstained boolean, scored boolean")


def test_layers_are_shuffled_once_for_all_configurations(spark):
    layers, configs = layers_of(spark, 40), U.valid_configs(spark, [{"config_id": "a"}, {"config_id": "b", "use_verifiers": False}])
    v = U.combine(layers, configs)
    shares = U.layer_shares(layers, configs, v)
    for plan in (physical(v), physical(shares)):
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "config_id" in x]
    used = {(r.call_id, r.config_id): r.verifiers_consulted for r in v.collect()}
    weight = {"acoustic": 0.5, "behaviour": 0.5, "semantic": 0.15}
    got = {(r.call_id, r.config_id, r.key): (r.role, r.weight, r.share) for r in shares.collect()}
    assert len(got) == 240 and set(used.values()) == {True, False}
    for (c, f, k), (role, w, share) in got.items():
        real = {x: 0.0 if (x == "behaviour" and c % 4 == 0) or (x == "semantic" and not used[c, f]) else weight[x] for x in weight}
        assert role == ("verifier" if k == "semantic" else "primary") and w == weight[k]
        assert share == pytest.approx(real[k] / sum(real.values()))


def test_bins_are_written_once_without_a_table_of_them(spark):
    r = spark.createDataFrame([(1, 0, 999), (1, 999, 1001), (1, 500, 2500), (1, 7000, 7001), (2, 1000, 2000)], "call_id int, start_ms bigint, end_ms bigint")
    b = I.rasterize(r, ["call_id"], 1000)
    assert sorted(map(tuple, b.collect())) == [(1, 0), (1, 1), (1, 2), (1, 7), (2, 1)]
    assert "Aggregate" not in physical(b).split("Generate explode")[0]
    assert b.rdd.getNumPartitions() >= I.BIN_TASKS


def test_forest_rows_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(O, "TREE_ROWS", 10)
    d = spark.range(200).coalesce(1).selectExpr("id as call_id", "cast(id % 2 as int) as y", "cast(id % 2 + id / 1000 as double) as x", "'train' as split")
    v, table = O._tree_input(d, ["x"])
    assert max(len(p) for p in table.rdd.glom().collect()) <= 10 + 1 and table.count() == 200
    assert O._tree_input(d.limit(10), ["x"])[1].count() == 10
    got = O.tree_scores(d, d, ["x"], trees=5).collect()
    assert len(got) == 200 and all((r.score > 0) == (r.y == 1) for r in got)
