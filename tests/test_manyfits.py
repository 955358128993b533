"""Fits in common passes against single ones and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.operators import models as O
from talkgrid.operators.manyfits import Fit, fit_many, folds_of_repeats, out_of_fold_many, score_many

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(9)
    n = 700
    a, b = draw.normal(size=n), np.exp(draw.normal(size=n))
    c = np.where(draw.random(n) < 0.2, np.nan, np.round(draw.normal(size=n), 1))
    y = (draw.random(n) < 1 / (1 + np.exp(-(a - 0.5 * b)))).astype(int)
    return [(int(i), float(a[i]), float(b[i]), None if math.isnan(c[i]) else float(c[i]), int(y[i]), "val" if i % 4 == 0 else "train") for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "call_id bigint, a double, b double, c double, y int, split string").repartition(5)


def by_numpy(rows, columns, c=1.0, balanced=True, clip=None):
    x = np.array([[np.nan if r[1 + NAMES.index(n)] is None else r[1 + NAMES.index(n)] for n in columns] for r in rows])
    y = np.array([r[4] for r in rows], float)
    missing = np.isnan(x)
    impute = np.nanmedian(x, 0)
    flagged = np.flatnonzero(missing.any(0))
    raw = np.concatenate((np.where(missing, impute, x), missing[:, flagged]), 1)
    mean, scale = raw.mean(0), raw.std(0)
    z = (raw - mean) / np.where(scale > 0, scale, 1)
    if clip:
        z = np.clip(z, -clip, clip)
    z = np.concatenate((np.ones((len(z), 1)), z), 1)
    n1 = y.sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1))) if balanced else np.ones(len(y))
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1 / c)
    ridge[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta)
    return impute, mean, scale, beta


def same(m, want):
    impute, mean, scale, beta = want
    assert m.impute == pytest.approx(impute, abs=1e-15) and m.mean == pytest.approx(mean, abs=1e-12) and m.scale == pytest.approx(scale, abs=1e-12)
    assert [m.intercept, *m.coef] == pytest.approx(beta, abs=1e-8)


@pytest.mark.parametrize("balanced,clip,c", [(True, None, 1.0), (False, 1.5, 0.1)])
def test_all_fits_equal_single_ones(table, rows, balanced, clip, c):
    fits = {"all": (NAMES, lambda r: True), "train": (["c", "a"], lambda r: r[5] == "train"), "few": (["b"], lambda r: r[0] < 40)}
    conditions = {"all": F.lit(True), "train": F.col("split") == "train", "few": F.col("call_id") < 40}
    got = fit_many(table, [Fit(k, tuple(v[0]), conditions[k]) for k, v in fits.items()], c=c, balanced=balanced, clip=clip)
    for k, (columns, keep) in fits.items():
        same(got[k], by_numpy([r for r in rows if keep(r)], columns, c, balanced, clip))
    one = O.fit_logistic(table.where("split = 'train'"), ["c", "a"], c=c, balanced=balanced, clip=clip)
    assert [one.intercept, *one.coef] == pytest.approx([got["train"].intercept, *got["train"].coef], abs=1e-6)
    # the model scores alike in both ways
    both = score_many(table, got).join(table.select("call_id", got["all"].logit(False).alias("s")), "call_id").where("fit = 'all'")
    assert both.where(F.abs(F.col("score") - F.col("s")) > 1e-9).count() == 0


def test_awkward_fits(spark, table):
    d = table.withColumns({"flat": F.lit(2.0), "rare": F.when(F.col("call_id") < 3, F.col("a")), "huge": F.col("a") * 1e300, "w": F.col("b")})
    m = fit_many(d, [Fit("x", ("flat", "rare", "a"), F.lit(True))], min_observed=20)["x"]
    assert m.names == ["a"]
    assert all(math.isfinite(v) for v in fit_many(d, [Fit("x", ("flat", "huge", "a"), F.lit(True))])["x"].coef[:1])
    with pytest.raises(ValueError):
        fit_many(d, [Fit("none", ("a",), F.lit(False))])
    with pytest.raises(ValueError):
        fit_many(d, [Fit("none", ("rare",), F.lit(True))], min_observed=20)
    # perfectly separable: regularisation keeps it finite
    s = spark.createDataFrame([(i, float(i), int(i > 5)) for i in range(12)], "call_id bigint, a double, y int")
    assert 0 < fit_many(s, [Fit("s", ("a",), F.lit(True))])["s"].coef[0] < 50
    # row weights: doubling a row's weight is having it twice
    twice = fit_many(table.unionByName(table.where("call_id < 100")), [Fit("t", ("a", "b"), F.lit(True))], balanced=False)["t"]
    heavy = O.fit_logistic(table, ["a", "b"], weight=F.when(F.col("call_id") < 100, 2.0).otherwise(1.0))
    assert heavy.coef[0] / heavy.scale[0] == pytest.approx(twice.coef[0] / twice.scale[0], rel=0.05)


def test_folds_and_out_of_fold_scores(table, rows):
    seeds = [100, 101]
    f = {r.call_id: r.folds for r in folds_of_repeats(table, 5, seeds).collect()}
    for i, s in enumerate(seeds):
        assert {r.call_id: r.fold for r in O.stratified_folds(table, 5, s).collect()} == {c: v[i] for c, v in f.items()}
    oof = out_of_fold_many(table, {"x": ["a"], "y/z": NAMES}, 5, seeds)
    assert oof.groupBy("set", "repeat").count().select("count").distinct().collect() == [(700,)]
    r = oof.where("set = 'y/z' and repeat = 1 and fold = 3").collect()
    impute, mean, scale, beta = by_numpy([x for x in rows if f[x[0]][1] != 3], NAMES)
    for x in r[:20]:
        v = np.array([x.a, x.b, np.nan if x.c is None else x.c])
        raw = np.concatenate((np.where(np.isnan(v), impute, v), [float(np.isnan(v[2]))]))
        assert x.score == pytest.approx(beta[0] + ((raw - mean) / scale) @ beta[1:], abs=1e-7)


def test_runs_of_shuffled_labels(table):
    want = {r.call_id: r.y for r in O.permuted_labels(table, 1001).collect()}
    got = {r.call_id: r.y_1 for r in O.permuted_runs(table, [1000, 1001]).collect()}
    assert got == want
    m = O.permutation_control(table, ["a", "b"], runs=3).collect()
    assert len(m) == 3 and all(0.2 < r.auc < 0.8 for r in m)
    assert {r.experiment for r in O.tiny_training(table, ["a", "b"], repeats=2).collect()} == {"tiny_0", "tiny_1", "reversed"}


def test_rows_are_scored_by_the_models_they_pick(table):
    got = fit_many(table, [Fit("a", ("a", "c"), F.lit(True)), Fit("b", ("b",), F.lit(True))])
    picked = score_many(table, got, F.when(F.col("call_id") % 3 == 0, F.array(F.lit(1))).when(F.col("call_id") % 3 == 1, F.array(F.lit(1), F.lit(0))).otherwise(F.array().cast("array<int>")))
    every = {(r.call_id, r.fit): r.score for r in score_many(table, got).collect()}
    found = {(r.call_id, r.fit): r.score for r in picked.collect()}
    assert found == {(i, f): s for (i, f), s in every.items() if i % 3 < 2 and (f == "b" or i % 3 == 1)}


def test_fits_of_infinite_values_do_not_touch_the_others(spark, table):
    d = table.withColumn("a", F.when(F.col("call_id") == 0, float("inf")).otherwise(F.col("a")))
    fit = Fit("rest", ("a", "b"), F.col("call_id") > 0)
    want = fit_many(table, [fit])["rest"]
    got = fit_many(d, [fit, Fit("all", ("b",), F.lit(True))])["rest"]
    assert got.coef == pytest.approx(want.coef, abs=1e-9) and got.scale == pytest.approx(want.scale, abs=1e-12)


def test_repeated_ids_keep_a_fold_per_row(spark):
    d = spark.createDataFrame([(i // 2, i % 3 % 2) for i in range(60)], "call_id bigint, y int")
    f = {r.call_id: r.folds for r in folds_of_repeats(d, 3, [1, 2]).collect()}
    assert all(len(v) == 4 and v[:2] == sorted(v[:2]) and v[2:] == sorted(v[2:]) for v in f.values()) and len(f) == 30
