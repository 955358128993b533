"""Many regularised logistic fits on one table, in common passes.

A fit is a choice of columns, of training rows and of labels: a fold of a repeat, a table without one column, a run with shuffled labels. What every fit
learns (support, medians, flags for missing values, means, scales, coefficients) comes from its own training rows only, yet all fits advance together: a pass over the table adds up, per task, what each fit needs
next, and one aggregation sums that over the tasks. Medians are found digit by digit over the ordered bits of the values, so they are exact; coefficients by
Newton steps, whose gradient and Hessian are such sums. What comes to the driver grows with the fits and the squares of their columns, never with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint_dir
from .models import CLIP, LinearModel, kept

#: Numbers that one task may hold for the digits of all medians of a pass.
DIGIT_CELLS = 1 << 19
#: Rows whose numbers for all fits are made at once.
GRID_ROWS = 4096
#: Values beyond this, and infinities, are summed fit by fit: a product with 0 must be 0, and squares must be doubles.
WILD = 1e100
#: Most columns, flags and intercept for which the Hessians of all fits are one product.
GRID_TERMS = 32


@dataclass(frozen=True)
class Fit:
    """One fit: ``rows`` says (boolean) which rows train it, ``y`` which column holds its labels (0, 1 or null: no row of its)."""
    name: str
    columns: tuple[str, ...]
    rows: Column
    y: str = "y"


class _Table:
    """The columns of all fits as arrays: ``x`` values (null is NaN), ``m`` which fits a row trains, ``t`` the labels of each label column."""

    def __init__(self, df: DataFrame, fits: Sequence[Fit]):
        self.fits = list(fits)
        self.names = list(dict.fromkeys(c for f in fits for c in f.columns))
        self.labels = list(dict.fromkeys(f.y for f in fits))
        self.at = [np.array([self.names.index(c) for c in f.columns], int) for f in fits]
        self.label_at = [self.labels.index(f.y) for f in fits]
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.names])
        t = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.labels])
        m = F.array(*[F.coalesce(f.rows & F.col(f.y).isNotNull(), F.lit(False)) for f in fits])
        self.data = df.select(x.alias("x"), m.alias("m"), t.alias("t"))

    def sums(self, part: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray], over: Iterable[int], by: str = "sum") -> dict[int, np.ndarray]:
        """``part(x, rows, labels, fit)``, an array of one length per fit, added up (or ``max``) over all batches and tasks."""
        over, label_at = list(over), self.label_at
        together = np.add if by == "sum" else np.maximum

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x, m, t = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in b.columns)
                for k in over:
                    rows = np.flatnonzero(m[:, k])
                    if len(rows):
                        got = part(x, rows, t[rows, label_at[k]], k)
                        total[k] = got if k not in total else together(total[k], got)
            if total:
                ends = np.concatenate(([0], np.cumsum([len(v) for v in total.values()])))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(list(total.values()))))], names=["fit", "v"])

        parts = self.data.mapInArrow(run, "fit int, v array<double>").select("fit", array_to_vector("v").alias("v"))
        merged = Summarizer.sum(F.col("v")) if by == "sum" else Summarizer.max(F.col("v"))
        return {r.fit: r.s.toArray() for r in parts.groupBy("fit").agg(merged.alias("s")).collect()}

    def grid(self, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """``part(x, m, labels)``, a row per fit made for all fits at once (``m`` says which rows train a fit, ``labels`` has a column per fit), added up over all batches and tasks."""
        label_at = self.label_at

        def run(batches):
            total = None
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x, m, t = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in b.columns)
                for i in range(0, n, GRID_ROWS):
                    got = part(x[i:i + GRID_ROWS], m[i:i + GRID_ROWS], t[i:i + GRID_ROWS, label_at])
                    total = got if total is None else total + got
            if total is not None:
                ends = np.arange(len(total) + 1) * total.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total.ravel()))], names=["fit", "v"])

        parts = self.data.mapInArrow(run, "fit int, v array<double>").select("fit", array_to_vector("v").alias("v"))
        return {r.fit: r.s.toArray() for r in parts.groupBy("fit").agg(Summarizer.sum(F.col("v")).alias("s")).collect()}


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; zeros of either sign are one value."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _medians(t: _Table, known: list[np.ndarray], fits: list[int], together: bool = False) -> list[np.ndarray]:
    """Medians per fit and column, both middle values found digit by digit; 0 where nothing is known."""
    d, at = len(t.names), t.at
    bits = 16
    while bits > 4 and len(fits) * d * 2 << bits > DIGIT_CELLS:
        bits //= 2
    found = np.zeros((len(t.fits), d, 2), object)
    left = np.zeros((len(t.fits), d, 2), np.int64)
    for k in fits:
        for j, n in zip(t.at[k], known[k]):
            left[k, j] = (max(int(n) - 1, 0) // 2, int(n) // 2)
    for shift in range(64 - bits, -1, -bits):
        prefix = {k: np.array([[int(v) for v in row] for row in found[k]], np.uint64) for k in fits}
        size = 1 << bits

        def part(x, rows, labels, k, shift=shift, prefix=prefix):
            out = np.zeros((d, 2, size))
            for j in at[k]:
                v = x[rows, j]
                key = _ordered(v[~np.isnan(v)])
                digit = (key >> np.uint64(shift)) & np.uint64(size - 1)
                head = key >> np.uint64(shift + bits) if shift + bits < 64 else np.zeros(len(key), np.uint64)
                out[j, 0] = np.bincount(digit[head == prefix[k][j, 0]].astype(np.int64), minlength=size)
                out[j, 1] = out[j, 0] if prefix[k][j, 0] == prefix[k][j, 1] else np.bincount(digit[head == prefix[k][j, 1]].astype(np.int64), minlength=size)
            return out.ravel()

        def all_fits(x, m, labels, shift=shift, prefix=prefix):
            out = np.zeros((len(m[0]), d, 2, size))
            for j in range(d):
                known_ = ~np.isnan(x[:, j])
                key, rows = _ordered(x[known_, j]), m[known_]
                digit = ((key >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64)
                head = key >> np.uint64(shift + bits) if shift + bits < 64 else np.zeros(len(key), np.uint64)
                asks: dict[int, list[tuple[int, int]]] = {}
                for k in prefix:
                    for e in (0, 1) if j in at[k] else ():
                        asks.setdefault(int(prefix[k][j, e]), []).append((k, e))
                for p, who in asks.items():
                    here = np.flatnonzero(head == np.uint64(p))
                    if len(here):
                        here = here[np.argsort(digit[here], kind="stable")]
                        cut = np.flatnonzero(np.concatenate(([True], digit[here[1:]] != digit[here[:-1]])))
                        counts = np.add.reduceat(rows[here], cut, axis=0, dtype=np.int32)
                        fit, end = np.array(who).T
                        out[fit[:, None], j, end[:, None], digit[here[cut]][None, :]] = counts[:, fit].T
            return out.reshape(len(out), -1)

        for k, counts in (t.grid(all_fits) if together else t.sums(part, fits)).items():
            below = np.cumsum(np.rint(counts).astype(np.int64).reshape(d, 2, size), axis=2)
            for j in t.at[k]:
                for s in (0, 1):
                    digit = int(np.searchsorted(below[j, s], left[k, j, s], "right"))
                    digit = min(digit, size - 1)
                    left[k, j, s] -= int(below[j, s, digit - 1]) if digit else 0
                    found[k, j, s] = (int(found[k, j, s]) << bits) + digit
    out = []
    for k in range(len(t.fits)):
        ends = [(_value(int(found[k, j, 0])), _value(int(found[k, j, 1]))) if k in fits and n else (0.0, 0.0) for j, n in zip(t.at[k], known[k])]
        out.append(np.array([a if a == b else a + (b - a) * 0.5 for a, b in ends]))
    return out


def _inputs(x: np.ndarray, rows: np.ndarray, at: np.ndarray, shell: dict, clip: float | None) -> np.ndarray:
    """Rows of a fit as standardised terms, the flags of missing values behind the imputed columns."""
    v = x[np.ix_(rows, at)]
    missing = np.isnan(v)
    raw = np.where(missing, shell["impute"], v)
    if len(shell["flagged"]):
        raw = np.concatenate((raw, missing[:, shell["flagged"]].astype(float)), 1)
    if "mean" not in shell:
        return raw
    z = (raw - shell["mean"]) / shell["scale"]
    return np.clip(z, -clip, clip) if clip else z


def _moments_by_fit(t: _Table, shells: list[dict], counted: dict[int, np.ndarray], fits: list[int]) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """Means of every fit's terms, and the sums of squares around them."""
    at = t.at
    mean = t.sums(lambda x, rows, y, k: _inputs(x, rows, at[k], shells[k], None).sum(0), fits)
    centre = [mean[k] / counted[k][0] for k in fits]
    return centre, t.sums(lambda x, rows, y, k: ((_inputs(x, rows, at[k], shells[k], None) - centre[k]) ** 2).sum(0), fits)


def _moments(t: _Table, shells: list[dict], counted: dict[int, np.ndarray], fits: list[int]) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """The same from sums that all fits share the making of; what a missing value counts as follows from how often it misses."""
    d, zero = len(t.names), np.zeros(len(t.names))

    def sums(x, m, y, around):
        away = np.where(np.isnan(x), 0.0, x - around)
        return m.T.astype(float) @ np.concatenate((away, away ** 2), 1)

    got = t.grid(lambda x, m, y: sums(x, m, y, zero))
    mean = [np.concatenate(((got[k][t.at[k]] + s["impute"] * (counted[k][0] - counted[k][2 + t.at[k]])), (counted[k][0] - counted[k][2 + t.at[k]])[s["flagged"]])) / counted[k][0] for k, s in enumerate(shells)]
    near = zero.copy()  # a place near all means, so that no digits cancel
    for k in fits:
        near[t.at[k]] = mean[k][:len(t.at[k])]
    got = t.grid(lambda x, m, y: sums(x, m, y, near))
    spread = {}
    for k, s in enumerate(shells):
        j, n = t.at[k], counted[k][0]
        have, p = counted[k][2 + j], len(t.at[k])
        off = mean[k][:p] - near[j]
        plain = got[k][d + j] - 2 * off * got[k][j] + have * off ** 2 + (n - have) * (s["impute"] - mean[k][:p]) ** 2
        share = mean[k][p:]
        spread[k] = np.concatenate((np.maximum(plain, 0.0), (n - have)[s["flagged"]] * (1 - share) ** 2 + have[s["flagged"]] * share ** 2))
    return mean, spread


def fit_many(df: DataFrame, fits: Sequence[Fit], c: float = 1.0, balanced: bool = True, min_observed: int = 0, clip: float | None = None, steps: int = 60,
             weight: str | None = None) -> dict[str, LinearModel]:
    """One fitted model per fit, by name: standardised logistic regression with inverse regularisation ``c``, as ``models.fit_logistic`` has it.

    ``balanced`` gives both classes of a fit the same total weight; ``weight`` names a column of row weights instead. A fit without rows, or whose columns are
    known in fewer than ``min_observed`` rows or constant (where that is asked for), raises.
    """
    fits = [Fit(f.name, (*f.columns,), f.rows, f.y) for f in fits]
    if weight:
        fits = [Fit(f.name, (*f.columns, weight), f.rows, f.y) for f in fits]
    t = _Table(df, fits)
    own = weight and t.names.index(weight)
    every, at = list(range(len(fits))), t.at  # what a task needs of the table
    d = len(t.names)

    def first_look(x, m, y):
        known, rows, n = ~np.isnan(x), m.astype(float), m.shape[1]
        wild = np.full((n, 1), float((np.abs(np.where(known, x, 0.0)) > WILD).sum()))
        return np.concatenate((rows.sum(0)[:, None], (m & (y == 1)).sum(0)[:, None], rows.T @ known, wild), 1)

    with kept(t.data):
        counted = t.grid(first_look)
        for k in every:
            if k in counted and counted[k][0] > 0:
                counted[k] = np.rint(counted[k])
            else:
                raise ValueError(f"no training rows for {fits[k].name!r}")
        together = not any(counted[k][2 + d] for k in every)
        if weight:
            for k in every:
                t.at[k] = t.at[k][t.at[k] != own]
        if min_observed:
            ends = t.sums(lambda x, rows, y, k: np.concatenate([np.where(np.isnan(s * x[rows]), -np.inf, s * x[rows]).max(0) for s in (1, -1)]), every, "max")
            for k in every:
                several = ends[k][:d] > -ends[k][d:]
                t.at[k] = np.array([j for j in t.at[k] if counted[k][2 + j] >= min_observed and several[j]], int)
                if not len(t.at[k]):
                    raise ValueError("no supported column in training")
        known = [counted[k][2 + t.at[k]] for k in every]
        shells = [{"impute": m, "flagged": np.flatnonzero(n < counted[k][0])} for k, (m, n) in enumerate(zip(_medians(t, known, every, together), known))]
        centre, spread = _moments(t, shells, counted, every) if together else _moments_by_fit(t, shells, counted, every)
        for k in every:
            scale = np.sqrt(np.nan_to_num(spread[k] / counted[k][0], nan=np.inf, posinf=np.inf))  # a spread beyond doubles leaves nothing of the column
            shells[k] |= {"mean": centre[k], "scale": np.where(scale > 0, scale, 1.0)}
        weights = []
        for k in every:
            n, pos = counted[k][:2]
            classes = int(pos > 0) + int(n - pos > 0)
            weights.append((n / (classes * max(n - pos, 1)), n / (classes * max(pos, 1))) if balanced else (1.0, 1.0))
        alike = together and not weight and not clip and 1 + 2 * d <= GRID_TERMS and all(np.isfinite(s["scale"]).all() and np.isfinite(s["mean"]).all() for s in shells)
        beta = _newton(t, shells, weights, own if weight else None, every, c, clip, steps, alike)
    out = {}
    for k in every:
        s = shells[k]
        names = [t.names[j] for j in t.at[k]]
        out[fits[k].name] = LinearModel(names, s["impute"].tolist(), s["flagged"].tolist(), s["mean"].tolist(), s["scale"].tolist(), beta[k][1:].tolist(), float(beta[k][0]), clip=clip)
    return out


def _newton(t: _Table, shells: list[dict], weights: list[tuple[float, float]], own: int | None, fits: list[int], c: float, clip: float | None, steps: int, alike: bool = False) -> list[np.ndarray]:
    """Intercept and coefficients of every fit; the intercept is not regularised. A step that makes the loss larger is halved.

    Where no term is clipped the terms of every fit are linear in the same columns and flags, so the sums of all fits (``alike``) are a few matrix products.
    """
    at, size = t.at, [len(s["mean"]) + 1 for s in shells]
    beta = [np.zeros(m) for m in size]
    best = [b.copy() for b in beta]
    loss_at = [np.inf] * len(beta)
    step = [np.zeros(m) for m in size]
    open_ = set(fits)
    if alike:
        shared = _shared_terms(t, shells)
    for _ in range(steps):
        if not open_:
            break
        now = {k: beta[k] for k in open_}

        def part(x, rows, y, k, now=now):
            z = np.concatenate((np.ones((len(rows), 1)), _inputs(x, rows, at[k], shells[k], clip)), 1)
            w = np.where(y == 1, weights[k][1], weights[k][0]) if own is None else np.nan_to_num(x[rows, own])
            margin = z @ now[k]
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            loss = (w * (np.logaddexp(0, margin) - y * margin)).sum()
            return np.concatenate(([loss], z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()))

        for k, got in (_alike(t, shared, weights, now) if alike else t.sums(part, sorted(open_))).items():
            ridge = np.full(size[k], 1 / c)
            ridge[0] = 0
            loss = got[0] + (ridge * beta[k] ** 2).sum() / 2
            if loss > loss_at[k] * (1 + 1e-12) + 1e-12 and np.abs(step[k]).max() > 1e-12:
                step[k] = step[k] / 2
                beta[k] = best[k] + step[k]
                continue
            best[k], loss_at[k] = beta[k].copy(), loss
            slope = got[1:size[k] + 1] + ridge * beta[k]
            bend = got[size[k] + 1:].reshape(size[k], size[k]) + np.diag(ridge)
            step[k] = -np.linalg.lstsq(bend, slope, rcond=None)[0]
            if np.abs(step[k]).max() < 1e-10:
                open_.discard(k)
            beta[k] = best[k] + step[k]
    return best


def _shared_terms(t: _Table, shells: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``middle`` and ``width`` of every column, and per fit the matrix that makes its terms of ``[1, (x - middle) / width or 0, missing]``."""
    d = len(t.names)
    middle, width = np.zeros(d), np.ones(d)
    for k, s in enumerate(shells):
        p = len(t.at[k])
        middle[t.at[k]], width[t.at[k]] = s["mean"][:p], s["scale"][:p]
    out = []
    for k, s in enumerate(shells):
        p = len(t.at[k])
        turn = np.zeros((1 + 2 * d, 1 + len(s["mean"])))
        turn[0, 0] = 1
        turn[0, 1:] = -s["mean"] / s["scale"]
        for i, j in enumerate(t.at[k].tolist()):
            turn[0, 1 + i] += middle[j] / s["scale"][i]
            turn[1 + j, 1 + i] = width[j] / s["scale"][i]
            turn[1 + d + j, 1 + i] = (s["impute"][i] - middle[j]) / s["scale"][i]
        for i, f in enumerate(s["flagged"].tolist()):
            turn[1 + d + t.at[k][f], 1 + p + i] = 1 / s["scale"][p + i]
        out.append(turn)
    return middle, width, out


def _alike(t: _Table, shared: tuple[np.ndarray, np.ndarray, list[np.ndarray]], weights: list[tuple[float, float]], now: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Loss, slope and bend of the open fits, one after the other as ``_newton`` reads them."""
    middle, width, turns = shared
    keys = sorted(now)
    coef = np.stack([turns[k] @ now[k] for k in keys], 1)
    less, more = (np.array([weights[k][i] for k in keys]) for i in (0, 1))
    i, j = np.triu_indices(len(coef))

    def part(x, m, y):
        missing = np.isnan(x)
        u = np.concatenate((np.ones((len(x), 1)), np.where(missing, 0.0, (x - middle) / width), missing), 1)
        y = np.nan_to_num(y[:, keys])
        w = np.where(y == 1, more, less) * m[:, keys]
        margin = u @ coef
        e = np.exp(-np.abs(margin))
        p = np.where(margin >= 0, 1.0, e) / (1 + e)
        loss = (w * (np.maximum(margin, 0) + np.log1p(e) - y * margin)).sum(0)
        return np.concatenate((loss[:, None], (w * (p - y)).T @ u, (w * p * (1 - p)).T @ (u[:, i] * u[:, j])), 1)

    out = {}
    for at, got in t.grid(part).items():
        k, n = keys[at], len(coef)
        bend = np.zeros((n, n))
        bend[i, j] = bend[j, i] = got[1 + n:]
        out[k] = np.concatenate((got[:1], turns[k].T @ got[1:1 + n], (turns[k].T @ bend @ turns[k]).ravel()))
    return out


def score_many(df: DataFrame, models: dict[str, LinearModel], pick: Column | None = None, number: str | None = None) -> DataFrame:
    """``df`` once per model with ``fit`` and ``score`` (log-odds); scores of all models come from one pass. 

    ``pick`` lists, by number, the models a row is scored by; ``number`` names a column for that number.
    """
    keys = list(models)
    names = list(dict.fromkeys(c for m in models.values() for c in m.names))
    parts = [(np.array([names.index(c) for c in m.names], int), {"impute": np.array(m.impute), "flagged": np.array(m.flagged, int), "mean": np.array(m.mean), "scale": np.array(m.scale)},
              np.array([m.intercept, *m.coef]), m.clip) for m in models.values()]
    columns, own = df.columns, pick is not None
    d = df if not own else df.withColumn("__p", F.transform(pick, lambda i: i.cast("int")))
    d = d.withColumn("__x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]))

    out = [*d.columns[:-1], "__s"]

    def run(batches):
        for b in batches:
            n = b.num_rows
            if n:
                x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if own:
                    p = b.column(b.num_columns - 2)
                    ends, wanted = np.concatenate(([0], np.cumsum(p.value_lengths().to_numpy()))), p.flatten().to_numpy()
                else:
                    ends, wanted = np.arange(n + 1) * len(keys), np.tile(np.arange(len(keys)), n)
                row, s = np.repeat(np.arange(n), np.diff(ends)), np.empty(len(wanted))
                by = np.argsort(wanted, kind="stable")
                cuts = np.searchsorted(wanted[by], np.arange(len(keys) + 1))
                for i, (at, shell, beta, clip) in enumerate(parts):
                    here = by[cuts[i]:cuts[i + 1]]
                    s[here] = beta[0] + _inputs(x, row[here], at, shell, clip) @ beta[1:]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=out)

    scored = d.mapInArrow(run, d.drop("__x").withColumn("__s", F.array(F.lit(0.0))).schema)
    scored = scored.select(*d.columns[:-1], F.posexplode("__s").alias("__i", "score"))
    scored = scored.withColumn("__i", F.get("__p", F.col("__i"))) if own else scored
    return scored.select(*columns, "score", F.get(F.array(*map(F.lit, keys)), F.col("__i")).alias("fit"), *([F.col("__i").alias(number)] if number else []))


def folds_of_repeats(df: DataFrame, k: int, seeds: Sequence[int], id_col: str = "call_id", y: str = "y") -> DataFrame:
    """``(id, folds)``: the stratified fold of every row in every repeat, equal to ``stratified_folds`` with each seed; one ordered pass for all."""
    from ..functions.ordered import scan
    d = df.select(id_col, y).withColumn("__r", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    d = d.withColumns({"__h": F.xxhash64(F.col(id_col), F.col("__r")), "__one": F.lit(1)})
    r = scan(d, ["__r", y], F.shiftright("__h", 48), ["__h", id_col], {"__rank": ("sum", "__one")})
    order = F.array_position(F.array(*[F.lit(int(s)) for s in seeds]), F.col("__r"))
    fold = (F.col("__rank") % k).cast("int")
    copies = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().agg(F.max("count")).first()[0]
    if copies == 1 and len(set(seeds)) == len(seeds):
        return r.groupBy(id_col).agg(*[F.max(F.when(F.col("__r") == int(s), fold)).alias(f"f{i}") for i, s in enumerate(seeds)]).select(
            id_col, F.array(*[f"f{i}" for i in range(len(seeds))]).alias("folds"))
    both = (order * k + fold).cast("int")  # repeat and fold in one number
    return r.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(both)), lambda x: x % k).alias("folds"))


def _plus(n: int) -> Callable[[Column], Column]:
    return lambda i: i + n


def out_of_fold_many(df: DataFrame, columns: dict[str, Sequence[str]], k: int, seeds: Sequence[int], id_col: str = "call_id", **options) -> DataFrame:
    """Every row scored, per column set and repeat, by the model that did not see its fold: ``df`` with ``set, repeat, fold, score``.

    All fits (sets x repeats x folds) advance together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(df.sparkSession)
    # settled once: the passes read it, and the scores after them
    joined = df.repartition(parts, id_col).join(folds_of_repeats(df, k, seeds, id_col), id_col).checkpoint()
    fits = [Fit(f"{name}/{r}/{f}", tuple(cols), F.get("folds", F.lit(r)) != f) for name, cols in columns.items() for r in range(len(seeds)) for f in range(k)]
    models = fit_many(joined, fits, **options)
    first = F.transform(F.slice("folds", 1, len(seeds)), lambda f, r: f + r * k)
    own = F.flatten(F.array(*[F.transform(first, _plus(s * k * len(seeds))) for s in range(len(columns))]))
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__fit"))
    s = score_many(joined, models, own, "__fit")
    every = [(name, r, f) for name in columns for r in range(len(seeds)) for f in range(k)]
    return s.withColumns({"repeat": of([r for _, r, _ in every]), "fold": of([f for *_, f in every]), "set": of([n for n, *_ in every])}).drop("fit", "folds", "__fit")
