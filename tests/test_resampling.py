"""Bootstrap in one pass, rank matrices and calibration against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.operators import metrics as M
from talkgrid.operators import models as O
from talkgrid.operators.resampling import auc_of_resamples, bootstrap_auc_difference, drawn_weights


def plain_auc(s, y, w):
    p, n = w * (y == 1), w * (y == 0)
    total = sum(p[i] * ((s < s[i]) * n).sum() + p[i] * ((s == s[i]) * n).sum() / 2 for i in np.flatnonzero(p))
    return total / (p.sum() * n.sum()) if p.sum() and n.sum() else None


@pytest.mark.parametrize("hot", [False, True])
def test_auc_of_every_resample(spark, hot):
    rng = random.Random(3)
    rows = [(w, 0.25 if hot and i % 3 else round(rng.gauss(0, 1), 1), rng.randrange(2), rng.getrandbits(63)) for w in "ab" for i in range(400)]
    rows += [("a", float("nan"), 1, 1), ("a", None, 0, 2), ("b", 1.0, None, 3), ("c", 1.0, 1, 4), ("c", -0.0, 1, 5)]
    df = spark.createDataFrame(rows, "which string, score double, y int, h bigint").repartition(8)
    got = {(r.which, r.replicate): r.auc for r in auc_of_resamples(df, 20, slice_rows=37).collect()}
    assert len(got) == 63 and got["c", 20] is None
    for w in "ab":
        mine = [r for r in rows if r[0] == w and r[1] is not None and r[1] == r[1] and r[2] is not None]
        s, y, weights = np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), drawn_weights(np.array([r[3] for r in mine]), 20)
        for k in (0, 7, 20):
            assert got[w, k] == pytest.approx(plain_auc(s, y, weights[:, k]), abs=1e-12)


def test_weights_are_poisson():
    w = drawn_weights(np.arange(4000) * 7919, 50)
    assert w.shape == (4000, 51) and (w[:, 50] == 1).all() and abs(w[:, :50].mean() - 1) < 0.01 and abs(w[:, :50].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and (drawn_weights(np.arange(4000) * 7919, 50) == w).all()


def test_interval_covers_the_difference(spark):
    draw = np.random.default_rng(5)
    y = draw.integers(0, 2, 600)
    a, b = y + draw.normal(size=600), y + 3 * draw.normal(size=600)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(600)], "id bigint, y int, a double, b double")
    r = bootstrap_auc_difference(df, "id", "a", "b").first()
    want = plain_auc(a, y, np.ones(600)) - plain_auc(b, y, np.ones(600))
    assert r.replicates == 1000 and r.delta_auc == pytest.approx(want, abs=1e-12) and r.lo < want < r.hi and 0.03 < r.hi - r.lo < 0.2


def test_rank_matrix_over_shared_rows(spark):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(300, 5)), 1)
    x[draw.random((300, 5)) < 0.2] = np.nan
    x[:, 4] = 3.0
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, " + ", ".join(f"{n} double" for n in names))
    got = {(r.a, r.b): r.r for r in M.spearman_matrix(df, "id", names).collect()}
    assert list(got) == list(itertools.combinations(names, 2))
    ranks = np.full(x.shape, np.nan)
    for j in range(5):
        known = np.flatnonzero(~np.isnan(x[:, j]))
        v = x[known, j]
        ranks[known, j] = [(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v]
    for i, j in itertools.combinations(range(5), 2):
        both = ~np.isnan(ranks[:, i]) & ~np.isnan(ranks[:, j])
        want = None if j == 4 else np.corrcoef(ranks[both, i], ranks[both, j])[0, 1]
        assert got[names[i], names[j]] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_platt_by_newton(spark):
    draw = np.random.default_rng(2)
    s = draw.normal(size=800)
    y = (draw.random(800) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    for c in (None, 0.01):
        a, b = 0.0, 0.0
        for _ in range(60):
            q = 1 / (1 + np.exp(-(a * s + b)))
            g = np.array([((q - y) * s).sum() + (a / c if c else 0), (q - y).sum()])
            h = np.array([[(q * (1 - q) * s * s).sum() + (1 / c if c else 0), (q * (1 - q) * s).sum()], [(q * (1 - q) * s).sum(), (q * (1 - q)).sum()]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        got = O.fit_platt(df, c=c)
        assert (got["a"], got["b"]) == pytest.approx((a, b), abs=1e-8)
    apart = spark.createDataFrame([(float(i), int(i > 3)) for i in range(8)], "score double, y int")
    assert O.fit_platt(apart)["a"] > 5 and 0 < O.fit_platt(apart, c=1.0)["a"] < 5
    assert O.fit_platt(apart.withColumn("score", F.lit(1.0)))["a"] == 0.0
    with pytest.raises(ValueError):
        O.fit_platt(apart.limit(0))
