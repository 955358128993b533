"""Aggregation, fusion, running verdicts and metrics on small, hand-checked inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.functions.ordered import first_k, quantiles, scan, value_block
from talkgrid.operators import fusion as U
from talkgrid.operators import joins as J
from talkgrid.operators import metrics as M
from talkgrid.operators import prefix as X
from talkgrid.operators.resampling import bootstrap_auc_difference
from talkgrid.operators import sampling as P
from talkgrid.operators import scoring as A
from talkgrid.operators import vectors as V

LAYER = "call_id bigint, key string, probability double, quality double, abstained boolean, scored boolean"


# ------------------------------------------------------------------------------ ordered aggregates

def test_value_blocks_keep_the_order(spark):
    rng = random.Random(3)
    v = sorted([rng.uniform(-5, 5) for _ in range(500)] + [0.0, 1.0, 2.0, -1.0, 4.0, 0.5, 1e-300, -1e9, 1e9, 2 ** 40 - 0.5])
    b = [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").select("i", value_block(F.col("v")).alias("b")).orderBy("i").collect()]
    assert b == sorted(b) and len(set(b)) > 300


def test_scan_equals_running_aggregates_for_a_hot_key(spark):
    rng = random.Random(1)
    data = [(0 if rng.random() < .6 else rng.randrange(1, 4), i, rng.randrange(-9, 9)) for i in range(800)]
    df = spark.createDataFrame(data, "k int, t int, x int").withColumn("y", F.when(F.col("x") > 5, F.col("x")))
    s = scan(df, ["k"], F.floor(F.col("t") / 37), ["t"], {"a": ("sum", "x"), "m": ("max", "x"), "l": ("last", "y"), "n": ("total", "x"), "b": ("sum<", "x")})
    got = {(r.k, r.t): r for r in s.collect()}
    for k in {d[0] for d in data}:
        acc, top, last, before = 0, None, None, 0
        for _, t, x in sorted(d for d in data if d[0] == k):
            before, acc = acc, acc + x
            top = x if top is None else max(top, x)
            last = x if x > 5 else last
            r = got[(k, t)]
            assert (r.a, r.m, r.l, r.b) == (acc, top, last, before)
            assert r.n == sum(d[2] for d in data if d[0] == k)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {g: np.round(rng.normal(size=n), 2) for g, n in (("a", 1), ("b", 2), ("c", 301))}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    for r in quantiles(df, ["g"], "v", {"p10": .1, "p50": .5, "p95": .95}).collect():
        assert [r.p10, r.p50, r.p95] == pytest.approx(list(np.percentile(groups[r.g], [10, 50, 95])))


def test_first_k_over_salts(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"))
    got = first_k(df, ["g"], [F.desc("id")], 4)
    assert sorted((r.g, r["rank"], r.id) for r in got.collect()) == sorted((g, k + 1, 999 - (999 - g) % 3 - 3 * k) for g in range(3) for k in range(4))


# ------------------------------------------------------------------------------ chunk scores

def test_aggregations(spark):
    s = [2.0, -1.0, .5, 3.0, -2.0, 0.25, 4.0, -3.0, 1.0, 1.5, 7.0]
    df = spark.createDataFrame([(1, x, i + 1.0) for i, x in enumerate(s)], "call_id int, score double, duration_s double")
    r = A.call_scores(df, sorted(A.AGGREGATIONS)).first()
    v = np.array(s)
    p = (1 / (1 + np.exp(-v))).mean()
    w = np.arange(1, len(s) + 1)
    assert r["mean"] == pytest.approx(v.mean()) and r["median"] == np.median(v) and (r["min"], r["max"]) == (v.min(), v.max())
    assert r.top25_mean == pytest.approx(np.sort(v)[-3:].mean()) and r.trimmed_mean == pytest.approx(np.sort(v)[1:-1].mean())
    assert r.mean_prob == pytest.approx(math.log(p / (1 - p))) and r.duration_weighted == pytest.approx((v * w).sum() / w.sum())
    with pytest.raises(ValueError):
        A.call_scores(df, ["mode"])


def chunk_rows(spark, scores, gap=20.0, length=4.0):
    return spark.createDataFrame([(1, i + 1, i * (gap + length), i * (gap + length) + length, s) for i, s in enumerate(scores)],
                                 "call_id int, chunk bigint, start_s double, end_s double, score double")


@pytest.mark.parametrize("how", ["mean", "max", "min", "mean_prob", "duration_weighted", "median", "top25_mean", "trimmed_mean"])
def test_running_value_is_the_aggregate_of_the_prefix(spark, how):
    scores = [2.0, -1.0, .5, 3.0, -2.0]
    c = chunk_rows(spark, scores).withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    steps = X.progression(c, how).orderBy("chunk").collect()
    assert [s.caller_speech_s for s in steps] == [4, 8, 12, 16, 20] and [s.call_time_s for s in steps] == [4, 28, 52, 76, 100]
    for k, s in enumerate(steps, 1):
        v = A.call_scores(c.where(F.col("chunk") <= k), [how]).first()[how]
        assert s.p == pytest.approx(1 / (1 + math.exp(-v)), abs=1e-4)


@pytest.mark.parametrize("how", ["median", "top25_mean", "trimmed_mean"])
def test_order_statistics_of_a_long_call(spark, how):
    import random
    random.seed(4)
    scores = [round(random.gauss(0, 2), 1) for _ in range(5000)]
    p = {s.chunk: s.p for s in X.progression(chunk_rows(spark, scores), how).collect()}
    assert len(p) == 5000
    for k in (1, 2, 9, 10, 11, 61, 999, 5000):
        s = sorted(scores[:k])
        m, cut = max(1, math.ceil(k / 4)), k // 10
        v = {"median": (s[(k - 1) // 2] + s[k // 2]) / 2, "top25_mean": sum(s[-m:]) / m, "trimmed_mean": sum(s[cut:k - cut]) / (k - 2 * cut)}[how]
        assert p[k] == pytest.approx(1 / (1 + math.exp(-v)), abs=1.01e-4)


def test_order_statistics_of_a_call_with_a_third_of_all_chunks(spark):
    """One call of 3,000 chunks among 600 of 10, with ties, missing scores and infinities; nothing groups a call in Python."""
    rng = random.Random(11)
    calls = {0: [rng.choice([None, rng.gauss(0, 1), 0.25]) for _ in range(3000)]}
    calls |= {i: [round(rng.gauss(0, 1), 1) for _ in range(10)] for i in range(1, 600)}
    calls[600], calls[601] = [None, None, 1.0], [float("nan"), -2.0, 3.0, None, 5.0]
    rows = [(c, i + 1, i * 4.0, i * 4.0 + 4, x) for c, s in calls.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "call_id int, chunk bigint, start_s double, end_s double, score double").repartition(8)
    got = X.progression(df, "median")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    p = {(r.call_id, r.chunk): r.p for r in got.collect()}
    assert len(p) == len(rows)
    for call in (0, 1, 599, 600, 601):
        for k in sorted({1, 2, 3, 7, 50, 1024, 1025, 2999, 3000}):
            if k <= len(calls[call]):
                s = sorted(x for x in calls[call][:k] if x is not None and x == x)
                want = 1 / (1 + math.exp(-(s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)) if s else None
                assert p[call, k] == (pytest.approx(want, abs=1.01e-4) if s else None)


@pytest.mark.parametrize("how", ["median", "top25_mean", "trimmed_mean"])
def test_order_statistics_of_short_calls_need_no_rounds(spark, monkeypatch, how):
    """More distinct scores than one round tells apart: short calls are sorted in place, and only the long one is searched."""
    rng = random.Random(5)
    calls = {i: [rng.choice([None, float("nan"), rng.gauss(0, 2), 1.5]) for _ in range(40)] for i in range(20)}
    calls[20] = [rng.gauss(0, 2) for _ in range(X.SHORT_CALL + 1)]
    searched = []
    whole = X.running_positions
    monkeypatch.setattr(X, "running_positions", lambda df, *a: searched.extend(r.call_id for r in df.select("call_id").distinct().collect()) or whole(df, *a))
    rows = [(c, i + 1, i * 4.0, i * 4.0 + 4, x) for c, s in calls.items() for i, x in enumerate(s)]
    schema = "call_id int, chunk bigint, start_s double, end_s double, score double"
    got = {(r.call_id, r.chunk): r.p for r in X.progression(spark.createDataFrame(rows, schema), how).collect()}
    assert searched == [20] and len(got) == len(rows)
    for call, scores in calls.items():
        for k in range(1, len(scores) + 1):
            s = sorted(x for x in scores[:k] if x is not None and x == x)
            n = len(s)
            m, cut = max(1, math.ceil(n / 4)), n // 10
            v = n and {"median": (s[(n - 1) // 2] + s[n // 2]) / 2, "top25_mean": sum(s[-m:]) / m, "trimmed_mean": sum(s[cut:n - cut]) / (n - 2 * cut)}[how]
            assert got[call, k] == (pytest.approx(1 / (1 + math.exp(-v)), abs=1.01e-4) if n else None)
    searched.clear()
    X.progression(spark.createDataFrame([r for r in rows if r[0] < 20], schema), how).collect()
    assert not searched


def test_decided_at(spark):
    assert X.decided_at(chunk_rows(spark, [-1.0, 3.0, 2.0], gap=0)).first().decided_at_s == 8.0
    rng = random.Random(8)
    data, want = [], {}
    for call in range(80):
        s = [float(rng.randrange(-4, 5)) for _ in range(rng.randrange(1, 9))]
        run = [sum(s[:k + 1]) >= 0 for k in range(len(s))]
        k = len(s) - 1
        while k > 0 and run[k - 1] == run[-1]:
            k -= 1
        want[call] = (k + 1) * 4.0
        data += [(call, i + 1, i * 4.0, i * 4.0 + 4, x) for i, x in enumerate(s)]
    df = spark.createDataFrame(data, "call_id int, chunk bigint, start_s double, end_s double, score double")
    assert {r.call_id: r.decided_at_s for r in X.decided_at(df).collect()} == want


def test_never_confident_is_null_not_zero(spark):
    c = chunk_rows(spark, [.1, -.1])
    calls = spark.createDataFrame([(1, "human", 60.0), (2, "human", 60.0)], "call_id int, label string, duration_s double")
    m = {r.call_id: r for r in X.detection_metrics(X.progression(c), calls).collect()}
    assert m[1].never_confident and m[1].confident_at_s is None and m[1].lead_s is None and m[1].agrees is None
    assert m[2].n_chunks == 0 and m[2].first_at_s is None and not m[2].never_confident


# ------------------------------------------------------------------------------ fusion

def verdict(spark, layers, **cfg):
    df = spark.createDataFrame([(1, k, p, q, a, s) for k, p, q, a, s in layers], LAYER)
    return U.combine(df, U.valid_configs(spark, [cfg | {"config_id": "c"}])).first()


def test_even_split_and_gate(spark):
    v = verdict(spark, [("acoustic", 1.0, 1.0, False, True), ("behaviour", 0.0, 1.0, False, True)])
    assert v.p == 0.5 and v.decisive and v.is_synthetic and not v.settled
    three = [("acoustic", .95, 1.0, False, True), ("behaviour", .9, 1.0, False, True), ("semantic", 0.0, 1.0, False, True)]
    v = verdict(spark, three)
    assert v.settled and not v.verifiers_consulted and v.p == pytest.approx(.925) and v.n_layers_used == 2
    v = verdict(spark, three, use_verifiers=False)
    assert v.p == pytest.approx((.5 * .95 + .5 * .9) / 1.15, abs=1e-6) and v.n_layers_used == 3
    v = verdict(spark, [("acoustic", .7, 1.0, False, True), ("behaviour", .5, 1.0, False, True), ("semantic", 1.0, 1.0, False, True)])
    assert v.verifiers_consulted and v.p == pytest.approx((.35 + .25 + .15) / 1.15, abs=1e-6)


def test_abstention_policies_and_no_votes(spark):
    pair = [("acoustic", .9, 1.0, False, True), ("behaviour", .1, 0.0, True, True)]
    assert verdict(spark, pair).p == pytest.approx(.9)
    assert verdict(spark, pair, on_abstain="neutral").p == pytest.approx(.7)
    assert verdict(spark, pair, on_abstain="neutral", use_quality=True).p == pytest.approx(.9)
    v = verdict(spark, [("acoustic", .9, 0.0, True, True), ("behaviour", .1, 0.0, True, True)])
    assert (v.p, v.is_synthetic, v.confidence, v.decisive) == (.5, False, .5, False)
    v = verdict(spark, [("acoustic", .9, 1.0, False, True), ("semantic", .9, 1.0, False, False)], weights={"acoustic": 0.0})
    assert not v.decisive
    v = verdict(spark, [("acoustic", .8, 1.0, False, True), ("behaviour", .6, 1.0, False, True)], mode="logit_mean", confidence_mode="synthetic")
    z = (math.log(4) + math.log(1.5)) / 2
    assert v.p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and v.confidence == pytest.approx(v.p, abs=1e-4)


@pytest.mark.parametrize("bad,why", [({"mode": "sum"}, "mode"), ({"threshold": 1.0}, "threshold"), ({"weights": {"acoustic": -1.0}}, "weights"),
                                     ({"roles": {"semantic": "judge"}}, "roles"), ({"verify_threshold": .4}, "verify_threshold"), ({"on_abstain": "drop"}, "on_abstain")])
def test_invalid_configurations_name_their_reason(spark, bad, why):
    assert U.complete_configs(spark, U.config_rows(spark, [bad])).first().invalid == why


# ------------------------------------------------------------------------------ metrics

def scored(spark, y, s):
    return spark.createDataFrame([("g", a, float(b)) for a, b in zip(y, s)], "g string, y int, score double")


def test_confusion_and_ties(spark):
    r = M.confusion(scored(spark, [0, 0, 1, 1], [.1, .8, .2, .9]), ["g"], threshold=.5).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1)
    tied = M.evaluate(scored(spark, [0, 0, 1, 1], [.5] * 4), ["g"]).first()
    assert tied.eer == .5 and tied.auc == .5 and tied.eer_interpolated == .5
    one = M.evaluate(scored(spark, [1, 1], [.5, .6]), ["g"]).first()
    assert one.auc is None and one.eer is None


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.normal(size=200) + y, 1)
    r = M.evaluate(scored(spark, y.tolist(), s.tolist()), ["g"]).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + .5 * (a == b) for a in pos for b in neg])
    p = np.clip(1 / (1 + np.exp(-s)), 1e-6, 1 - 1e-6)
    best = max(((np.mean((s >= t) == (y == 1)), -t) for t in np.unique(np.r_[s, 0.0])))
    assert r.auc == pytest.approx(auc) and r.brier == pytest.approx(np.mean((p - y) ** 2))
    assert (r.best_accuracy, r.best_threshold) == (pytest.approx(best[0]), pytest.approx(-best[1]))
    assert r.accuracy == pytest.approx(np.mean((s >= 0) == (y == 1)))
    mw = M.mann_whitney(scored(spark, y.tolist(), s.tolist()).withColumnRenamed("score", "value"), ["g"]).first()
    assert mw.u == pytest.approx(auc * len(pos) * len(neg)) and 0 < mw.p_value < 1e-6


def test_bootstrap_contract(spark):
    rng = np.random.default_rng(6)
    d = [(i, int(i % 2), float(rng.normal() + i % 2), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(d, "call_id int, y int, a double, b double")
    r, again = (bootstrap_auc_difference(df, "call_id", "a", "b", repeats=30, seed=1).first() for _ in range(2))
    assert r == again and r.lo < r.delta_auc < r.hi and r.replicates == 30
    w = P.poisson_weights(df.select("call_id"), "call_id", 50, 1).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=.05) and w[1] == pytest.approx(1, abs=.1)


# ------------------------------------------------------------------------------ samples, pairs, clusters

def test_stratified_fraction(spark):
    df = spark.range(100).select(F.col("id").alias("call_id"), F.when(F.col("id") < 3, "a").otherwise("b").alias("label"))
    a = P.stratified_fraction(df, "label", "call_id", .2, 1)
    n = {r.label: r["count"] for r in a.groupBy("label").count().collect()}
    assert n == {"a": 2, "b": 19}
    ids = lambda d: sorted(r.call_id for r in d.collect())
    assert ids(a) == ids(P.stratified_fraction(df.repartition(7), "label", "call_id", .2, 1)) != ids(P.stratified_fraction(df, "label", "call_id", .2, 2))


def test_plan_seeds_and_draws(spark):
    c = spark.createDataFrame([("call_0a", "train"), ("call_0b", "val")], "call_id string, split string")
    p = P.augmentation_plan(c)
    assert sorted(r.sample_id for r in p.collect()) == ["call_0a__seen0", "call_0a__seen1", "call_0b__seen0", "call_0b__unseen0"]
    import hashlib
    for r in p.collect():
        h = hashlib.sha256(f"{r.call_id}|{r.family}|{r.variant}".encode()).digest()
        assert int(r.seed) == int.from_bytes(h[:8], "big")
    d = P.draw_line_parameters(p)
    assert d.collect() == d.collect() and all(180 <= r.high_pass_hz <= 380 and set(r.codecs.split("+")) <= set(P.CODEC_FAMILIES[r.family]) for r in d.collect())


def test_matched_pairs_use_each_row_once(spark):
    rng = random.Random(9)
    a = [(i, round(rng.uniform(0, 60), 1)) for i in range(70)] + [(i, 30.0) for i in range(100, 140)]
    b = [(i + 1000, round(rng.uniform(0, 60), 1)) for i in range(60)] + [(i + 1000, 30.0) for i in range(100, 125)]
    mk = lambda d: spark.createDataFrame(d, "call_id int, v double")
    got = J.matched_pairs(mk(a), mk(b), "v", 1.0).collect()
    va, vb = dict(a), dict(b)
    assert len({r.a_id for r in got}) == len(got) == len({r.b_id for r in got})
    assert all(abs(va[r.a_id] - vb[r.b_id]) <= 1.0 and r.d == pytest.approx(abs(va[r.a_id] - vb[r.b_id])) for r in got)
    free_a = [v for i, v in a if i not in {r.a_id for r in got}]
    free_b = [v for i, v in b if i not in {r.b_id for r in got}]
    assert not [1 for x in free_a for y in free_b if abs(x - y) <= 1.0]  # no pair is left
    assert sum(r.d == 0 for r in got) >= 25


def test_one_to_one_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "call_id int, v string")
    b = spark.createDataFrame([(1, "z")], "call_id int, w string")
    with pytest.raises(Exception, match="duplicate key on the left side"):
        J.one_to_one(a, b, ["call_id"]).collect()


def unit_vectors(spark, n=90, dim=6, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v[n // 2:] = v[: n - n // 2] + rng.normal(scale=.02, size=(n - n // 2, dim))
    if copies:
        v = np.r_[v, np.repeat(v[:1], copies, axis=0)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, int(i % 2), "val" if i % 3 == 0 else "train", [float(x) for x in r]) for i, r in enumerate(v)]
    return v, rows, spark.createDataFrame(rows, "call_id bigint, y int, split string, vec array<double>")


def test_near_duplicates_miss_nothing(spark):
    v, rows, df = unit_vectors(spark, copies=20)
    got = {r.val_id: r for r in V.near_duplicates(df, .995, rows=7).collect()}
    s = v @ v.T
    hits = sum(int(s[i, j] > .995) for i, _, a, _ in rows if a == "val" for j, _, b, _ in rows if b == "train")
    assert sum(r.n_pairs for r in got.values()) == hits
    for i, r in got.items():
        assert r.similarity == pytest.approx(max(s[i, j] for j, _, b, _ in rows if b == "train"))


def clustered(n, dim=8, centres=30, noise=0.03, seed=6):
    draw = np.random.default_rng(seed)
    c = draw.normal(size=(centres, dim))
    v = c[draw.integers(0, centres, n)] + noise * draw.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("copies", [False, True])
def test_nearest_neighbours_by_cells_equal_brute_force(spark, copies):
    v = clustered(600)
    if copies:
        v[100:300] = v[100]
    rows = [(i, int(i % 3 == 0), "val" if i % 4 == 0 else "train", x.tolist()) for i, x in enumerate(v)]
    rows.append((601, 2, "val", rows[0][3]))  # a class without training calls
    df = spark.createDataFrame(rows, "call_id bigint, y int, split string, vec array<double>")
    got = {r.call_id: (r.neighbour, r.similarity) for r in V.nearest_train_neighbour(df, rows=40).collect()}
    train = df.where("split = 'train'")
    among = {r.call_id: (r.neighbour, r.similarity) for r in V.nearest_of_class(train, train, rows=40).collect()}
    y = np.array([r[1] for r in rows[:600]])
    val = np.array([r[2] == "val" for r in rows[:600]])
    for found, asked in ((got, np.flatnonzero(val)), (among, np.flatnonzero(~val))):
        assert set(found) == set(asked.tolist())
        for i in asked.tolist():
            ok = np.flatnonzero((y == y[i]) & ~val & (np.arange(600) != i))
            s = v[ok] @ v[i]
            assert found[i][1] == pytest.approx(s.max(), abs=1e-12) and v[found[i][0]] @ v[i] == pytest.approx(s.max(), abs=1e-12)
            if copies and 100 <= i < 300:
                assert found[i][0] == ok[np.isclose(s, 1, atol=1e-12)].min()


def test_cells_leave_out_what_is_too_far(spark):
    v = clustered(900)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "call_id bigint, vec array<double>")
    pivots = V.pivots_of(df)
    assert len(pivots) == 30
    celled = V.in_cells(df, pivots)
    ranges = V.cell_ranges(celled, pivots)
    b = V._named_blocks(celled, 64)
    near = V._blocks_within(b, b, V.cells_within(ranges, ranges, math.sqrt(2 - 2 * .99)))
    assert V.compared_share(b, b, near) < 0.3
    cell = {r.call_id: r.cell for r in celled.select("call_id", "cell").collect()}
    met = set(V.cells_within(ranges, ranges, math.sqrt(2 - 2 * .99)))
    s = v @ v.T
    assert all((cell[i], cell[j]) in met for i, j in zip(*np.nonzero(s >= .99)))


def test_pairs_of_tiles_do_not_grow_with_the_square_of_the_rows(spark, monkeypatch):
    """However small the least size of a tile is, a table has few of them, and the results of one tile and of many agree."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 8))
    v[1400:] = v[:100]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, int(i % 2), "val" if i % 4 == 0 else "train", x.tolist()) for i, x in enumerate(v)], "call_id bigint, y int, split string, vec array<double>").cache()
    met, join = [], V.block_pairs

    def counted(left, right, keys, near, kernel, schema):
        if near is None:
            near = left.select(*keys, F.col("blk").alias("lb")).distinct().join(right.select(*keys, F.col("blk").alias("rb")).distinct(), keys)
        met.append(near.count())
        return join(left, right, keys, near, kernel, schema)

    monkeypatch.setattr(V, "block_pairs", counted)
    for run in (lambda rows: V.nearest_train_neighbour(df, rows), lambda rows: V.near_duplicates(df, .9, rows), lambda rows: V.pair_similarity_counts(df, rows=rows),
                lambda rows: V.connected_components(df, V.similarity_edges(df, .9, rows))):
        few, many = ({tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run(rows).collect()} for rows in (2000, 4))
        assert few == many
    assert max(met) <= 2 * (2 * V.SIDES) ** 2


def test_pair_counts_and_components(spark):
    v, rows, df = unit_vectors(spark, n=40, copies=6)
    c = V.pair_similarity_counts(df, rows=9)
    n = {r.pair: r.n for r in c.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    ones = sum(r[1] for r in rows)
    zeros = len(rows) - ones
    assert n == {"0|0": zeros * (zeros - 1) // 2, "1|1": ones * (ones - 1) // 2, "0|1": ones * zeros}
    comp = V.connected_components(df, V.similarity_edges(df, .98, rows=9))
    near = v @ v.T >= .98
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    assert {r.call_id: r.cluster for r in comp.collect()} == dict(enumerate(label))


def test_ranking_equals_the_curve(spark):
    from talkgrid.operators.metrics import evaluate, ranking
    odd = [("a", None, 1), ("a", float("nan"), 0), ("a", 0.5, None), (None, 0.5, 1), ("one", 0.25, 1), ("a", float("inf"), 1), ("a", float("-inf"), 0), ("a", -0.0, 1), ("a", 0.0, 0)]
    rows = [("a", (i * 37 % 101) / 8 - 6, i % 3 % 2) for i in range(400)] + [("b", float(i % 5), i % 2) for i in range(90)] + odd
    d = spark.createDataFrame(rows, "g string, score double, y int").repartition(5)
    want = {r.g: r for r in evaluate(d, ["g"]).select("g", "n", "accuracy", "auc").collect()}
    got = {r.g: r for r in ranking(d, ["g"]).collect()}
    assert got.keys() == want.keys() == {"a", "b", "one"}
    for g, w in want.items():
        assert (got[g].n, got[g].accuracy) == (w.n, pytest.approx(w.accuracy)) and got[g].auc == (None if w.auc is None else pytest.approx(w.auc))
    tree = ranking(d, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in tree  # one pass: the table meets no second copy of itself


def test_long_and_short_keys_give_one_result(spark):
    from talkgrid.functions.ordered import cumulative, per_key
    rows = [(i % 7 if i % 7 < 6 else None, None if i % 11 == 0 else float(i * 13 % 29), 1.5) for i in range(500)] + [(50, None, 1.0), (51, float("nan"), 1.0)] + [(60, float(i), 1.0) for i in range(3)]
    d = spark.createDataFrame(rows, "k int, v double, w double")
    measures, out = {"n": F.count(F.lit(1)), "w": F.sum("w")}, {"low": F.sum(F.col("cum_n") * F.col("v")), "t": F.max("tot_n"), "w": F.sum("cum_w")}
    want = sorted(map(tuple, cumulative(d, ["k"], "v", measures).groupBy("k").agg(*[c.alias(n) for n, c in out.items()]).collect()))
    for hot in (1, 50, 1 << 16):
        assert sorted(map(tuple, per_key(d, ["k"], "v", measures, out, hot).collect())) == want


def test_rubric_stats_need_one_pass(spark):
    from talkgrid.operators.text import rubric_stats
    r = spark.createDataFrame([(f"c{i}", d, s) for i in range(12) for d, s in (("x", (i * 5 % 7) / 6), ("y", None if i == 3 else 0.5), (None, 0.5))] + [("gone", "x", 1.0)], "call_id string, dimension string, score double")
    c = spark.createDataFrame([(f"c{i}", i % 2, "val" if i > 4 else "train") for i in range(12)], "call_id string, y int, split string")
    got = {x.dimension: x for x in rubric_stats(r, c).collect()}
    value = lambda i: (i * 5 % 7) / 6
    pairs = [(value(a), value(b)) for a in range(5, 12) for b in range(5, 12) if a % 2 and not b % 2]
    assert got["x"].auc == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) and got["y"].auc == 0.5 and got[None].auc is None
    assert got["x"].human_mean == pytest.approx(sum(map(value, range(0, 12, 2))) / 6) and got["y"].undecided_share == 1.0 and got[None].synthetic_mean == 0.5
    assert rubric_stats(r, c)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
