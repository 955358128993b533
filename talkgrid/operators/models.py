"""Fitting on feature tables with MLlib, and scoring with exported coefficients.

What a fit learns before the optimiser runs (support, medians, means, scales) comes from the
training rows only. A fitted :class:`LinearModel` is plain numbers; scoring with it is one
column expression, so it needs no model object on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import cumulative, hash_rank, interpolated
from ..functions.scalar import calibrate, clamp, let, sigmoid
from .metrics import evaluate, ranking

CLIP = 6.0


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A table several fits read, kept while they do; a lost part is recomputed."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def result_rows(df: DataFrame) -> DataFrame:
    """A small result (metrics of a fit) settled now, before the tables behind it are let go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


# ------------------------------------------------------------------------------ linear models

@dataclass(frozen=True)
class LinearModel:
    names: list[str]
    impute: list[float]
    flagged: list[int]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    slope: float = 1.0
    offset: float = 0.0
    clip: float | None = CLIP
    notes: dict = field(default_factory=dict)

    def terms(self) -> Column:
        """Standardised inputs as one array: the imputed values, then a flag per column that was missing in training."""
        known = [F.nanvl(F.col(n).cast("double"), F.lit(None)) for n in self.names]
        numbers = lambda v: F.lit([float(x) for x in v])

        def standard(x):
            filled = F.zip_with(x, numbers(self.impute), lambda v, m: F.coalesce(v, m))
            raw = filled
            if self.flagged:
                raw = F.concat(filled, F.transform(F.lit([int(i) for i in self.flagged]), lambda i: F.get(x, i).isNull().cast("double")))
            z = F.zip_with(F.zip_with(raw, numbers(self.mean), lambda v, m: v - m), numbers(self.scale), lambda v, sd: v / sd)
            return F.transform(z, lambda v: clamp(v, -self.clip, self.clip)) if self.clip else z

        return let(F.array(*known), standard)

    def logit(self, calibrated: bool = True) -> Column:
        products = F.zip_with(self.terms(), F.lit([float(c) for c in self.coef]), lambda v, c: v * c)
        total = F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x)
        return total * self.slope + self.offset if calibrated else total

    def probability(self) -> Column:
        return sigmoid(self.logit())


ROWS_PER_TASK = 20_000
TREE_ROWS = 100_000


def sized(df: DataFrame, n: int) -> DataFrame:
    """No more tasks per optimiser step than ``n`` rows are worth; a large table keeps all of its own."""
    return df.repartition(n // ROWS_PER_TASK + 1)


def training_stats(train: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """Known count, distinct count and median of every column; one driver row per feature."""
    long = train.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], list(names), "feature", "value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    c = cumulative(long, ["feature"], "value", {"n": F.count(F.lit(1))})
    rows = c.groupBy("feature").agg(F.sum("n").alias("known"), F.count(F.lit(1)).alias("distinct"), interpolated(.5, "value").alias("median")).collect()
    got = {r["feature"]: r.asDict() for r in rows}
    return {n: got.get(n, {"known": 0, "distinct": 0, "median": 0.0}) for n in names}


def prepare(train: DataFrame, names: Sequence[str], min_observed: int = 0, clip: float | None = CLIP) -> LinearModel:
    """Everything but the coefficients: supported columns, medians, missing flags, means and scales."""
    n = train.count()
    stats = training_stats(train, names)
    keep = [c for c in names if not min_observed or (stats[c]["known"] >= min_observed and stats[c]["distinct"] > 1)]
    if not keep:
        raise ValueError("no supported column in training")
    impute = [float(stats[c]["median"] or 0.0) for c in keep]
    flagged = [i for i, c in enumerate(keep) if stats[c]["known"] < n]
    shell = LinearModel(list(keep), impute, flagged, [0.0] * (len(keep) + len(flagged)), [1.0] * (len(keep) + len(flagged)), [], 0.0, clip=None)
    long = train.select(F.posexplode(shell.terms()).alias("i", "x"))
    m = {r["i"]: r for r in long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    size = len(shell.mean)
    return replace(shell, mean=[float(m[i]["m"]) for i in range(size)], scale=[float(m[i]["s"]) or 1.0 for i in range(size)], clip=clip, notes={"rows": n})


def class_balance(df: DataFrame, y: str = "y") -> Column:
    """Weight that gives both classes the same total; two counts on the driver."""
    n = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    total = sum(n.values())
    w = F.lit(None).cast("double")
    for k, v in n.items():
        w = F.when(F.col(y) == k, F.lit(total / (len(n) * v))).otherwise(w)
    return w


def fit_logistic(train: DataFrame, names: Sequence[str], y: str = "y", c: float = 1.0, balanced: bool = True, min_observed: int = 0,
                 clip: float | None = None, weight: Column | None = None) -> LinearModel:
    """Standardised logistic regression with inverse regularisation ``c``: the one-fit case of ``manyfits.fit_many``."""
    from .manyfits import Fit, fit_many
    if weight is not None:
        train = train.withColumn("__weight", weight)
    fit = Fit("one", tuple(names), F.lit(True), y)
    return fit_many(train, [fit], c, balanced and weight is None, min_observed, clip, weight="__weight" if weight is not None else None)["one"]


def fit_behaviour(train: DataFrame, names: Sequence[str], c: float = 0.1, min_observed: int = 20, seed: int = 2026,
                  calibrated: bool = True) -> LinearModel:
    """The served recipe: supported columns, clipped z-scores, logistic, out-of-fold sigmoid calibration."""
    m = fit_logistic(train, names, c=c, balanced=False, min_observed=min_observed, clip=CLIP)
    if not calibrated:
        return m
    from .manyfits import out_of_fold_many
    oof = out_of_fold_many(train, {"all": m.names}, 5, [seed], c=c, balanced=False, clip=CLIP)
    cal = fit_platt(oof, "score", c=1.0)
    if cal["a"] <= 0:
        raise ValueError("calibration is not monotone: is there any signal?")
    return replace(m, slope=cal["a"], offset=cal["b"])


# ------------------------------------------------------------------------------ folds

def stratified_folds(df: DataFrame, k: int, seed: int, id_col: str = "call_id", y: str = "y") -> DataFrame:
    r = hash_rank(df, [y], id_col, seed)
    return r.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "group_n")


def grouped_folds(df: DataFrame, k: int, seed: int, group: str = "call_id") -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(k)).cast("int"))


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], LinearModel], k: int, seed: int, folds: DataFrame | None = None) -> DataFrame:
    """Every row scored by a model that did not see its fold."""
    with kept(folds if folds is not None else stratified_folds(df, k, seed)) as f:
        score = F.lit(None).cast("double")
        for i in range(k):
            score = F.when(F.col("fold") == i, fit(f.where(F.col("fold") != i)).logit(False)).otherwise(score)
    return (folds if folds is not None else stratified_folds(df, k, seed)).withColumn("score", score)


def repeated_cv(df: DataFrame, names: Sequence[str], k: int = 5, repeats: int = 10, c: float = 1.0) -> DataFrame:
    """Validation AUC of every fold of every repeat; the fits of all folds and repeats advance together."""
    from .manyfits import out_of_fold_many
    oof = out_of_fold_many(df.select(*dict.fromkeys(("call_id", "y", *names))), {"all": names}, k, [100 + r for r in range(repeats)], c=c)
    return ranking(oof, ["repeat", "fold"]).select("repeat", "fold", "n", "auc", "accuracy")


def cv_summary(cv: DataFrame) -> DataFrame:
    return cv.agg(F.count(F.lit(1)).alias("fits"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


# ------------------------------------------------------------------------------ calibration

def fit_platt(df: DataFrame, score: str = "score", y: str = "y", c: float | None = None, steps: int = 50) -> dict:
    """Slope and offset of ``sigmoid(a s + b)``; plain likelihood unless ``c`` regularises the slope.

    Newton's method on the table of distinct scores: a step is one aggregation of six sums. A step that makes the loss larger is halved.
    """
    counts = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    ridge = 0.0 if c is None else 1.0 / c
    at = best = (0.0, 0.0)
    step, loss = (0.0, 0.0), math.inf
    with kept(counts) as d:
        for _ in range(steps):
            m = F.col("s") * at[0] + at[1]
            q = sigmoid(m, None)
            e, h = F.col("n") * q - F.col("pos"), F.col("n") * q * (1 - q)
            now = F.col("n") * (F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))) - F.col("pos") * m
            r = d.agg(F.sum(now), F.sum(e * F.col("s")), F.sum(e), F.sum(h * F.col("s") * F.col("s")), F.sum(h * F.col("s")), F.sum(h)).first()
            if r[0] is None:
                raise ValueError("no scores to calibrate on")
            value = r[0] + ridge * at[0] ** 2 / 2
            if not value <= loss * (1 + 1e-12) + 1e-12:
                step = (step[0] / 2, step[1] / 2)
                if max(map(abs, step)) < 1e-12:
                    break
                at = (best[0] + step[0], best[1] + step[1])
                continue
            best, loss = at, value
            ga, gb, haa, hab, hbb = r[1] + ridge * at[0], r[2], r[3] + ridge, r[4], r[5]
            det = haa * hbb - hab * hab
            if det <= 1e-300:  # one score, or classes that a slope parts perfectly
                break
            step = (-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det)
            if max(map(abs, step)) < 1e-11:
                break
            at = (at[0] + step[0], at[1] + step[1])
    return {"method": "platt", "a": float(best[0]), "b": float(best[1])}


def temperature_grid(n: int = 400, lo: float = 0.05, hi: float = 50.0) -> list[float]:
    step = (math.log(hi) - math.log(lo)) / (n - 1)
    return [math.exp(math.log(lo) + i * step) for i in range(n)]


def temperature_losses(df: DataFrame, score: str = "score", y: str = "y", grid: Sequence[float] | None = None) -> DataFrame:
    """Mean log loss of every temperature; equal scores meet the grid once."""
    ts = df.sparkSession.createDataFrame([(float(t),) for t in (grid or temperature_grid())], "t double")
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y)).alias("pos"), F.count(F.lit(1)).alias("n"))
    p = clamp(sigmoid(F.col("s") / F.col("t")), 1e-7, 1 - 1e-7)
    loss = -(F.col("pos") * F.ln(p) + (F.col("n") - F.col("pos")) * F.ln(1 - p))
    return counts.join(F.broadcast(ts)).groupBy("t").agg((F.sum(loss) / F.sum("n")).alias("log_loss"))


def fit_temperature(df: DataFrame, score: str = "score", y: str = "y") -> dict:
    t = temperature_losses(df, score, y).agg(F.min_by("t", F.struct("log_loss", "t"))).first()[0]
    return {"method": "temperature", "a": 1.0 / t, "b": 0.0, "temperature": t}


def calibrated_out_of_fold(df: DataFrame, fitter: Callable[[DataFrame], dict], folds: int = 5) -> DataFrame:
    """``df(.., score, y, fold)`` with the probability of calibrators that did not see the row's fold."""
    p = F.lit(None).cast("double")
    for i in range(folds):
        cal = fitter(df.where(F.col("fold") != i))
        p = F.when(F.col("fold") == i, calibrate(F.col("score"), cal["a"], cal["b"], None)).otherwise(p)
    return df.withColumn("p", p)


def choose_calibration(df: DataFrame, folds: int = 5, slope_cap: float | None = 3.0, grouped: bool = False, seed: int = 0) -> dict:
    """Platt or temperature by out-of-fold log loss (a tie goes to temperature), refitted on everything."""
    from .metrics import probability_losses
    f = grouped_folds(df, folds, seed) if grouped else stratified_folds(df, folds, seed)
    with kept(f) as d:
        loss = {}
        for name, fitter in (("platt", fit_platt), ("temperature", fit_temperature)):
            oof = calibrated_out_of_fold(d, fitter, folds).withColumn("k", F.lit(1))
            loss[name] = probability_losses(oof, ["k"], eps=1e-6).first()["log_loss"]
        cal = fit_platt(d) if loss["platt"] < loss["temperature"] - 1e-4 else fit_temperature(d)
    if slope_cap is not None:
        cal["a"] = min(cal["a"], slope_cap)
    return cal | {"cv_log_loss": loss[cal["method"]]}


# ------------------------------------------------------------------------------ experiments

def scored_metrics(df: DataFrame, score: Column, name: str, by: Sequence[str] = ("split",)) -> DataFrame:
    m = evaluate(df.withColumn("score", score), list(by))
    return m.select(F.lit(name).alias("experiment"), *by, "n", "accuracy", "balanced_accuracy", "auc", "eer", "f1", "far", "frr", "brier")


def _collect(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_set_ladder(df: DataFrame, sets: dict[str, Sequence[str]], c: float = 0.1, balanced: bool = False, clip: float | None = CLIP,
                      split: str = "split") -> DataFrame:
    """The same fit on several column sets, all in common passes, judged on both splits."""
    from .manyfits import Fit, fit_many, score_many
    models = fit_many(df, [Fit(name, tuple(cols), F.col(split) == "train") for name, cols in sets.items()], c=c, balanced=balanced, clip=clip)
    return scored_sets(score_many(df, models), ["split"])


def scored_sets(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics of every fit of a ``score_many`` table."""
    m = evaluate(scored, ["fit", *by])
    return m.select(F.col("fit").alias("experiment"), *by, "n", "accuracy", "balanced_accuracy", "auc", "eer", "f1", "far", "frr", "brier")


# fixed values: the ladder's experiments as (name, column set, kind, inverse regularisation)
LADDER = [
    ("A_dummy", "dummy", "prior", 0.1), ("B_shortcut", "shortcut", "logistic", 0.1), ("B_shortcut_trees", "shortcut", "trees", 0.1),
    ("C_temporal", "temporal", "logistic", 0.1), ("D_reaction", "reaction", "logistic", 0.1), ("E_consistency", "consistency", "logistic", 0.1),
    ("E_less_regularized", "consistency", "logistic", 1.0), ("E_trees", "consistency", "trees", 0.1), ("E_no_counts", "no_counts", "logistic", 0.1),
    ("E_no_agent", "no_agent", "logistic", 0.1), ("R_reaction_only", "reaction_only", "logistic", 0.1), ("G_with_global", "with_global", "logistic", 0.1),
]


def behaviour_ladder(df: DataFrame, sets: dict[str, Sequence[str]], ladder=tuple(LADDER)) -> DataFrame:
    """Prior, linear and tree models from the shortcut columns up to all of them; the linear ones of one regularisation advance together."""
    from .manyfits import Fit, fit_many, score_many
    parts = []
    with kept(df) as d:
        train = d.where("split = 'train'")
        for c in sorted({c for _, _, kind, c in ladder if kind == "logistic"}):
            models = fit_many(train, [Fit(name, tuple(sets[cols]), F.lit(True)) for name, cols, kind, x in ladder if kind == "logistic" and x == c], c=c, balanced=False, clip=CLIP)
            parts.append(result_rows(scored_sets(score_many(d, models), ["split"])))
        for name, cols, kind, _ in ladder:
            if kind == "prior":
                parts.append(result_rows(scored_metrics(d, prior_score(train), name)))
            elif kind == "trees":
                parts.append(result_rows(scored_metrics(tree_scores(train, d, sets[cols]), F.col("score"), name)))
    return _collect(parts)


def prior_score(train: DataFrame, y: str = "y") -> Column:
    """Log-odds of the training prior for everyone."""
    p = min(max(train.agg(F.avg(y)).first()[0], 1e-6), 1 - 1e-6)
    return F.lit(math.log(p / (1 - p)))


def _tree_input(train, names):
    """The input vector, and the training table ``(__v, y)``. A large one is dealt to tasks of at most :data:`TREE_ROWS` rows: the forest keeps a draw per tree with every row."""
    shell = prepare(train, names, clip=None)
    plain = replace(shell, mean=[0.0] * len(shell.mean), scale=[1.0] * len(shell.scale))
    v = array_to_vector(plain.terms())
    d, n = train.select(v.alias("__v"), "y"), shell.notes["rows"]
    return v, d.repartition(max(-(-n // TREE_ROWS), int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if n > TREE_ROWS else d


def _odds(p: Column) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def tree_scores(train: DataFrame, df: DataFrame, names: Sequence[str], trees: int = 200, depth: int = 5, min_leaf: int = 8, seed: int = 2026) -> DataFrame:
    """Forest control: log-odds of the vote share in ``score``."""
    v, d = _tree_input(train, names)
    m = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="0.75", seed=seed, featuresCol="__v",
                               labelCol="y").fit(d)
    out = m.transform(df.withColumn("__v", v))
    return out.withColumn("score", _odds(vector_to_array("probability")[1])).select(*df.columns, "score")


def boosted_scores(train: DataFrame, df: DataFrame, names: Sequence[str], rounds: int = 150, depth: int = 2, rate: float = 0.05, seed: int = 42) -> DataFrame:
    v, d = _tree_input(train, names)
    m = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, featuresCol="__v", labelCol="y").fit(d)
    return m.transform(df.withColumn("__v", v)).withColumn("score", _odds(vector_to_array("probability")[1])).select(*df.columns, "score")


def shortcut_models(df: DataFrame, sets: dict[str, Sequence[str]], rounds: int = 150) -> DataFrame:
    """How far trivial columns get: a linear and a boosted model per column set."""
    parts = []
    with kept(df) as d:
        train = d.where("split = 'train'")
        for name, cols in sets.items():
            parts.append(result_rows(scored_metrics(d, fit_logistic(train, cols).logit(), f"{name}/logistic")))
            parts.append(result_rows(scored_metrics(boosted_scores(train, d, cols, rounds), F.col("score"), f"{name}/boosted")))
    return _collect(parts)


def neural_head_scores(train: DataFrame, df: DataFrame, emb: str = "emb", hidden: int = 256, rounds: int = 60, seed: int = 42) -> DataFrame:
    """Small neural head on chunk vectors: ``score`` is the log-odds. Sigmoid hidden units, full-batch optimiser."""
    dim = len(train.select(emb).first()[0])
    to = lambda d: d.withColumn("__v", array_to_vector(F.transform(emb, lambda x: x.cast("double"))))
    m = MultilayerPerceptronClassifier(layers=[dim, hidden, 2], maxIter=rounds, seed=seed, featuresCol="__v", labelCol="y").fit(to(train))
    return m.transform(to(df)).withColumn("score", _odds(vector_to_array("probability")[1])).select(*df.columns, "score")


def vector_logistic(train: DataFrame, emb: str = "emb", c: float = 1.0, weight: Column | None = None):
    """Standardised balanced logistic on a vector column; returns ``frame -> frame with score``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    to = lambda d: d.withColumn("__v", array_to_vector(F.transform(emb, lambda x: x.cast("double"))))
    w = weight if weight is not None else class_balance(train)
    d = to(train).withColumn("__w", w)
    total, n = d.agg(F.sum("__w"), F.count(F.lit(1))).first()
    m = Pipeline(stages=[StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True),
                         LogisticRegression(featuresCol="__z", labelCol="y", weightCol="__w", regParam=1.0 / (c * total), standardization=False,
                                            maxIter=100)]).fit(sized(d, n))

    def apply(df):
        return m.transform(to(df)).withColumn("score", vector_to_array("rawPrediction")[1]).select(*df.columns, "score")

    return apply


def call_metrics(chunks: DataFrame, name: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """Metrics of calls scored by the mean of their chunks."""
    calls = chunks.groupBy("call_id", "y", *by).agg(F.avg("score").alias("score"))
    return scored_metrics(calls, F.col("score"), name, by)


def layer_probe(embeddings: DataFrame, layers: Sequence[int]) -> DataFrame:
    """A linear probe per layer; each reads its own partition of the table."""
    parts = []
    for layer in layers:
        d = embeddings.where(F.col("layer") == layer)
        m = vector_logistic(d.where("split = 'train'"))
        parts.append(result_rows(call_metrics(m(d), str(layer)).withColumn("layer", F.lit(layer))))
    return _collect(parts)


def best_layer(probe: DataFrame) -> DataFrame:
    """Highest validation AUC, then lowest EER, then the lower layer, at four digits."""
    return probe.where("split = 'val'").orderBy(F.desc(F.bround("auc", 4)), F.bround("eer", 4), "layer").limit(1)


def family_ablation(df: DataFrame, names: Sequence[str], families: dict[str, Sequence[str]], single: bool = False, c: float = 0.1) -> DataFrame:
    """Every family of columns left out in turn, or alone."""
    pick = (lambda f: [n for n in names if n in f]) if single else (lambda f: [n for n in names if n not in f])
    return column_set_ladder(df, {k: pick(set(f)) for k, f in families.items() if pick(set(f))}, c=c)


def leave_one_out_auc(df: DataFrame, names: Sequence[str], k: int = 5, c: float = 0.1, seed: int = 2026) -> DataFrame:
    """Out-of-fold AUC lost without each column; (columns + 1) x k fits in common passes."""
    from .manyfits import out_of_fold_many
    sets = {left or "none": [n for n in names if n != left] for left in (None, *names)}
    oof = out_of_fold_many(df.where("split = 'train'"), {s: cols for s, cols in sets.items() if cols}, k, [seed], c=c, balanced=False, clip=CLIP)
    t = result_rows(evaluate(oof, ["set"]).select(F.col("set").alias("left_out"), "auc"))
    full = t.where("left_out = 'none'").select(F.col("auc").alias("full_auc"))
    return t.where("left_out <> 'none'").join(F.broadcast(full)).select("left_out", "auc", (F.col("full_auc") - F.col("auc")).alias("auc_lost"))


def permuted_labels(df: DataFrame, seed: int, id_col: str = "call_id", y: str = "y") -> DataFrame:
    """The same labels dealt to other rows: row order by one hash takes the label at that place in another."""
    d = df.withColumn("__k", F.lit(1))
    a = hash_rank(d.drop(y), ["__k"], id_col, seed).drop("group_n")
    b = hash_rank(d.select("__k", id_col, y), ["__k"], id_col, seed + 1).select("rank", y)
    return a.join(b, "rank").drop("rank", "__k")


def permuted_runs(df: DataFrame, seeds: Sequence[int], id_col: str = "call_id", y: str = "y") -> DataFrame:
    """``(id, y_0, y_1, ..)``: the labels of ``permuted_labels`` under every seed, by one ordered pass for all."""
    from ..functions.ordered import scan
    d = df.select(id_col, y).withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1)))).withColumn("__one", F.lit(1))
    seed = F.get(F.array(*[F.lit(int(s)) for s in seeds]), F.col("__run"))

    def ranked(more: int):
        h = d.withColumn("__h", F.xxhash64(F.col(id_col), seed + more))
        return scan(h, ["__run"], F.shiftright("__h", 48), ["__h", id_col], {"__rank": ("sum", "__one")})

    dealt = ranked(0).select("__run", "__rank", id_col).join(ranked(1).select("__run", "__rank", y), ["__run", "__rank"])
    return dealt.groupBy(id_col).agg(*[F.max(F.when(F.col("__run") == i, F.col(y))).alias(f"{y}_{i}") for i in range(len(seeds))])


def permutation_control(df: DataFrame, names: Sequence[str], runs: int = 5, c: float = 0.1) -> DataFrame:
    """Validation AUC of fits on shuffled training labels, all runs in common passes; chance if nothing leaks."""
    from .manyfits import Fit, fit_many, score_many
    train = df.where("split = 'train'")
    dealt = train.select("call_id", *names).join(permuted_runs(train, [1000 + r for r in range(runs)]), "call_id")
    models = fit_many(dealt, [Fit(f"permutation_{r}", tuple(names), F.lit(True), f"y_{r}") for r in range(runs)], c=c)
    return scored_sets(score_many(df.where("split = 'val'"), models), ["split"])


# ------------------------------------------------------------------------------ voices

def cluster_sweep(vectors: DataFrame, max_k: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Bisecting k-means by cosine for every k; the clusters of the best silhouette, and all silhouettes."""
    d = vectors.withColumn("features", array_to_vector("vec"))
    with kept(d) as v:
        scores, best = [], None
        for k in range(2, max_k + 1):
            m = BisectingKMeans(k=k, distanceMeasure="cosine", seed=seed).fit(v)
            p = m.transform(v)
            if p.select("prediction").distinct().count() < 2:
                continue
            s = ClusteringEvaluator(distanceMeasure="cosine").evaluate(p)
            scores.append((k, float(s)))
            if best is None or s > best[1]:
                best = (m, s)
    table = vectors.sparkSession.createDataFrame(scores, "k int, silhouette double")
    return best[0].transform(d).select("call_id", F.col("prediction").alias("cluster")), table


def leave_one_cluster_out(df: DataFrame, names_or_emb, clusters: DataFrame, y_class: int, min_calls: int = 5) -> DataFrame:
    """A cluster of one class held out everywhere at a time: how much of it a model without it still recognises.

    One fit per cluster of at least ``min_calls``, however many there are; only their names reach the driver.
    """
    j = df.join(clusters, "call_id", "left")
    parts = []
    with kept(j) as d:
        ids = [r["cluster"] for r in d.where(F.col("y") == y_class).groupBy("cluster").agg(F.count_distinct("call_id").alias("n"))
               .where((F.col("n") >= min_calls) & F.col("cluster").isNotNull()).orderBy("cluster").toLocalIterator()]
        for c in ids:
            held = (F.col("cluster") == c) & (F.col("y") == y_class)
            held = F.coalesce(held, F.lit(False))
            fit = vector_logistic(d.where((F.col("split") == "train") & ~held), names_or_emb)
            test = d.where(held | ((F.col("split") == "val") & (F.col("y") != y_class)))
            calls = fit(test).groupBy("call_id", "y").agg(F.avg("score").alias("score"))
            calls = calls.withColumn("cluster", F.lit(c))
            own = F.col("y") == y_class
            seen = calls.groupBy("cluster").agg(F.count_if(own).alias("n_held_out"),
                                                F.avg(F.when(own, ((F.col("score") >= 0) == F.lit(bool(y_class))).cast("double"))).alias("recognised"))
            parts.append(result_rows(seen.join(evaluate(calls, ["cluster"]).select("cluster", "auc", "accuracy"), "cluster")))
    if not parts:
        raise ValueError("no cluster has enough calls")
    return _collect(parts)


def recall_of_unseen(loo: DataFrame) -> DataFrame:
    return loo.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n_held_out").alias("calls"),
                   (F.sum(F.col("n_held_out") * F.col("recognised")) / F.sum("n_held_out")).alias("weighted_recall"),
                   F.min("recognised").alias("worst"), F.avg("auc").alias("mean_auc"))


# ------------------------------------------------------------------------------ training sets

def tiny_training(df: DataFrame, names: Sequence[str], per_class: int = 5, repeats: int = 10) -> DataFrame:
    """Fits on a handful of calls, and one on the validation side only; all in common passes."""
    from .manyfits import Fit, fit_many, score_many
    from .sampling import sample_per_class
    train = df.where("split = 'train'")
    drawn = None
    for r in range(repeats):
        s = sample_per_class(train, "y", "call_id", per_class, r).select("call_id", F.lit(r).alias("r"))
        drawn = s if drawn is None else drawn.unionByName(s)
    # a few ids a repeat
    held = drawn.groupBy("call_id").agg(F.collect_set("r").alias("drawn"))
    with kept(df.join(held, "call_id", "left")) as d:
        fits = [Fit(f"tiny_{r}", tuple(names), F.array_contains("drawn", r)) for r in range(repeats)] + [Fit("reversed", tuple(names), F.col("split") == "val")]
        scored = score_many(d, fit_many(d, fits)).drop("drawn")
        judged = (F.col("fit") == "reversed") == (F.col("split") == "train")
        return result_rows(scored_sets(scored.where(judged), ["split"]))


def domain_class_weight(df: DataFrame, domain: str = "domain", y: str = "y") -> DataFrame:
    """Adds ``weight``: every domain and class cell counts the same. One row per cell is joined back."""
    cells = df.groupBy(domain, y).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return df.join(cells, [domain, y])


def training_variants(train: DataFrame, evaluation: DataFrame, names: Sequence[str], original: str = "original") -> DataFrame:
    """Fits on the original calls, their line variants, both, and both balanced by domain; judged per domain."""
    clean = F.col("domain") == original
    sets = {"orig_only": train.where(clean), "channel_only": train.where(~clean), "mixed": train, "balanced": domain_class_weight(train)}
    parts = []
    with kept(evaluation) as ev:
        for name, d in sets.items():
            m = fit_logistic(d, names, weight=F.col("weight") if name == "balanced" else None)
            parts.append(result_rows(scored_metrics(ev, m.logit(), name, ["domain"])))
    return _collect(parts)


def augmented_training(clean: DataFrame, seen: DataFrame, evaluation: DataFrame, names: Sequence[str], condition: str = "condition") -> DataFrame:
    """Clean against clean plus seen conditions, judged per condition."""
    cols = ["call_id", "y", *names]
    parts = []
    with kept(evaluation) as ev:
        for name, d in (("clean", clean.select(*cols)), ("augmented", clean.select(*cols).unionByName(seen.select(*cols)))):
            parts.append(result_rows(scored_metrics(ev, fit_logistic(d, names).logit(), name, [condition])))
    return _collect(parts)


def nuisance_diagnostics(df: DataFrame, names: Sequence[str], agent: Sequence[str], c: float = 0.1) -> DataFrame:
    """How much the pattern of missing values, and the agent's side alone, give away."""
    flags = [F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in names]
    wide = df.select("call_id", "split", "y", *flags, *[F.col(a) for a in agent])
    return column_set_ladder(wide, {"missingness_only": [f"{n}_missing" for n in names], "agent_only": list(agent)}, c=c)


def frozen_evaluation(df: DataFrame, model: LinearModel, by: Sequence[str] = ("split",)) -> DataFrame:
    """An exported model on a feature table; nothing is fitted."""
    return scored_metrics(df, model.logit(), "frozen", by)
