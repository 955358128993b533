"""Classification, ranking and calibration metrics as distributed aggregates.

Everything that needs an order is computed on the table of *distinct scores* per group
(:func:`score_curve`), so tied scores cost one row and no group is sorted in one task.
``by`` names the grouping columns; ``y`` is 1 for the positive class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from ..functions.ordered import BLK, cumulative, interpolated, quantiles, scan, value_block
from ..functions.scalar import bool_int, clamp, safe_div, sigmoid

# fixed values: ten equal-width bin edges exactly as floating point spacing gives them
ECE_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


# ------------------------------------------------------------------------------ decisions

def confusion(df: DataFrame, by: Sequence[str], score: str = "score", threshold: float = 0.0,
              y: str = "y") -> DataFrame:
    pred, pos = F.col(score) >= threshold, F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"),
        F.count_if(pos & ~pred).alias("fn"), F.count_if(pos & pred).alias("tp"))


def decision_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> dict[str, Column]:
    """Rates of a confusion table; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in (tn, fp, fn, tp))
    recall, tnr = safe_div(tp, tp + fn, 0.0), safe_div(tn, tn + fp, 0.0)
    precision = safe_div(tp, tp + fp, 0.0)
    return {
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (recall + tnr) / 2,
        "precision": precision, "recall": recall,
        "f1": safe_div(2 * precision * recall, precision + recall, 0.0),
        "far": safe_div(fn, fn + tp, 0.0), "frr": safe_div(fp, fp + tn, 0.0)}


def decision_metrics(df, by, score="score", threshold=0.0, y="y") -> DataFrame:
    return confusion(df, by, score, threshold, y).withColumns(decision_columns())


# ------------------------------------------------------------------------------ curves

def score_curve(df: DataFrame, by: Sequence[str], score: str = "score", y: str = "y",
                weight: str | None = None) -> DataFrame:
    """One row per distinct score: ``pos``/``neg`` at it, ``tp``/``fp`` when deciding at it, class totals."""
    w = F.col(weight) if weight else F.lit(1)
    c = cumulative(df.where(F.col(y).isNotNull()), by, score,
                   {"pos": F.sum(F.when(F.col(y) == 1, w).otherwise(0)),
                    "neg": F.sum(F.when(F.col(y) == 1, 0).otherwise(w))})
    return c.withColumns({
        "tp": F.col("tot_pos") - F.col("cum_pos"), "fp": F.col("tot_neg") - F.col("cum_neg"),
        "fpr": safe_div(F.col("tot_neg") - F.col("cum_neg"), F.col("tot_neg")),
        "tpr": safe_div(F.col("tot_pos") - F.col("cum_pos"), F.col("tot_pos"))})


def auc_column() -> Column:
    """Aggregate over a score curve: rank AUC, ties counted half, NULL with one class."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("cum_neg") + F.col("neg") / 2))
    return safe_div(wins, F.max(F.col("tot_pos").cast("double") * F.col("tot_neg")))


def ap_column() -> Column:
    return F.sum(safe_div(F.col("pos"), F.col("tot_pos")) * safe_div(F.col("tp"), F.col("tp") + F.col("fp")))


def eer_nearest_column(score: str) -> Column:
    """Aggregate: struct(eer, threshold) at the first point, from the top score down, with the least rate difference."""
    far, frr = 1 - F.col("tpr"), F.col("fpr")
    return F.min_by(F.struct(((far + frr) / 2).alias("eer"), F.col(score).alias("threshold")),
                    F.struct(F.abs(far - frr).alias("gap"), (-F.col(score)).alias("down")))


def eer_interpolated_column(score: str) -> Column:
    """Aggregate: error rate where the two error curves cross, linear between neighbouring scores."""
    fpr, fnr = F.col("fpr"), 1 - F.col("tpr")
    fpr0 = safe_div(F.col("fp") - F.col("neg"), F.col("tot_neg"))
    fnr0 = 1 - safe_div(F.col("tp") - F.col("pos"), F.col("tot_pos"))
    d1, d0 = fpr - fnr, fpr0 - fnr0
    value = fpr0 + (-d0 / (d1 - d0)) * (fpr - fpr0)
    return F.max_by(F.when(d1 >= 0, value), F.when(d1 >= 0, F.col(score)))


def ranking(df: DataFrame, by: Sequence[str], score: str = "score", threshold: float = 0.0, y: str = "y",
            counts: dict[str, Column] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """``n``, ``accuracy`` and ``auc`` per group, as :func:`evaluate` has them, without a curve.

    Blocks of distinct scores are summed up first; what lies below a block joins its sums, never its rows, so the table is read and dealt once. ``extra``
    aggregates ``counts`` of a distinct score along the way; a group without a null key stays even where only its counts are known.
    """
    s, known = F.col(score).cast("double"), F.col(y).isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    d = df.where(F.col(score).isNotNull())
    if counts is None:
        d = d.where(known & ~F.isnan(s))
    ok = known & ~F.isnan(s)
    d = d.groupBy(*by, score).agg(F.count_if(ok & (F.col(y) == 1)).alias("pos"), F.count_if(ok & (F.col(y) != 1)).alias("neg"), *[c.alias(k) for k, c in (counts or {}).items()])
    below = F.sum("neg").over(W.partitionBy(*by, BLK).orderBy(score).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn(BLK, value_block(s)).withColumn("__below", F.coalesce(below, F.lit(0)))
    wins, hits = F.col("pos").cast("double") * (F.col("__below") + F.col("neg") / 2), F.when(F.col(score) >= threshold, F.col("pos")).otherwise(F.col("neg"))
    d = d.groupBy(*by, BLK).agg(F.sum(wins).alias("__wins"), F.sum(hits).alias("__hits"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[c.alias(k) for k, c in (extra or {}).items()])
    below = F.sum("neg").over(W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("__below", F.coalesce(below, F.lit(0)))
    pos, neg = F.sum("pos"), F.sum("neg")
    return d.groupBy(*by).agg((pos + neg).alias("n"), safe_div(F.sum("__hits"), pos + neg, 0.0).alias("accuracy"),
                              safe_div(F.sum(F.col("__wins") + F.col("pos").cast("double") * F.col("__below")), pos.cast("double") * neg).alias("auc"), *[F.sum(k).alias(k) for k in extra or {}])


def roc_auc(df, by, score="score", y="y", weight=None) -> DataFrame:
    return score_curve(df, by, score, y, weight).groupBy(*by).agg(auc_column().alias("auc"))


def roc_points(df, by, score="score", y="y") -> DataFrame:
    return score_curve(df, by, score, y).select(*by, F.col(score).alias("threshold"), "fpr", "tpr")


def pr_points(df, by, score="score", y="y") -> DataFrame:
    c = score_curve(df, by, score, y)
    return c.select(*by, F.col(score).alias("threshold"), F.col("tpr").alias("recall"),
                    safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


# ------------------------------------------------------------------------------ calibration

def ece10_bin(p: Column) -> Column:
    """Left-open, right-closed bin number; the first bin takes its lower edge too."""
    out = F.lit(0)
    for edge in ECE_EDGES[1:-1]:
        out = out + bool_int(p > edge)
    return out


def equal_bin(p: Column, bins: int = 8) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(df, by, p="p", y="y", bins: int = 10, left_closed: bool = False) -> DataFrame:
    b = equal_bin(F.col(p), bins) if left_closed else ece10_bin(F.col(p))
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("frequency"))


def ece(df, by, p="p", y="y", bins: int = 10, left_closed: bool = False) -> DataFrame:
    r = reliability(df, by, p, y, bins, left_closed)
    gap = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("frequency")))
    return r.groupBy(*by).agg(safe_div(gap, F.sum("n")).alias("ece"))


def probability_losses(df, by, p="p", y="y", eps: float = 1e-6) -> DataFrame:
    q, t = clamp(F.col(p), eps, 1 - eps), F.col(y)
    return df.groupBy(*by).agg(
        F.avg((q - t) * (q - t)).alias("brier"),
        F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss"))


def quantile_gap(df, by, p="p", y="y", bins: int = 5) -> DataFrame:
    """Mean absolute gap between predicted and observed rate over equal-count bins."""
    edges = quantiles(df, by, p, {f"e{i}": i / bins for i in range(1, bins)})
    c = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("hits")).join(edges, list(by))
    b = sum((bool_int(F.col(f"e{i}") < F.col(p)) for i in range(1, bins)), F.lit(0))
    g = c.groupBy(*by, b.alias("bin")).agg(F.sum(F.col(p) * F.col("n")).alias("sp"), F.sum("n").alias("n"),
                                          F.sum("hits").alias("hits"))
    return g.groupBy(*by).agg(F.avg(F.abs(F.col("sp") / F.col("n") - F.col("hits") / F.col("n"))).alias("mean_gap"))


# ------------------------------------------------------------------------------ everything at once

def evaluate(df: DataFrame, by: Sequence[str], score: str = "score", threshold: float = 0.0, y: str = "y",
             probability: str | Column | None = None) -> DataFrame:
    """All metrics per group in one aggregation over the score curve.

    ``score`` is a log-odds value unless ``probability`` gives the probability of a score.
    """
    c = score_curve(df, by, score, y)
    p = sigmoid(F.col(score), None) if probability is None else (
        F.col(probability) if isinstance(probability, str) else probability)
    c = c.withColumn("__p", clamp(p, 1e-6, 1 - 1e-6))
    q, pos, neg = F.col("__p"), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    above = F.col(score) >= threshold
    correct = F.col("tp") + F.col("tot_neg") - F.col("fp")
    bins = [F.sum(F.when(ece10_bin(q) == i, q * (pos + neg) - pos).otherwise(0.0)) for i in range(10)]
    agg = c.groupBy(*by).agg(
        n.alias("n"), F.sum(neg).alias("n_human"), F.sum(pos).alias("n_synthetic"),
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"), F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(neg)).alias("tn"), F.sum(F.when(above, 0).otherwise(pos)).alias("fn"),
        auc_column().alias("auc"), ap_column().alias("average_precision"),
        eer_nearest_column(score).alias("__eer"), eer_interpolated_column(score).alias("eer_interpolated"),
        (F.sum(pos * (1 - q) * (1 - q) + neg * q * q) / n).alias("brier"),
        (F.sum(-(pos * F.ln(q) + neg * F.ln(1 - q))) / n).alias("log_loss"),
        (sum(F.abs(b) for b in bins) / n).alias("ece"),
        F.max(F.struct(correct.alias("correct"), (-F.col(score)).alias("down"))).alias("__best"))
    agg = agg.withColumns(decision_columns())
    at_thr, best = F.col("tp") + F.col("tn"), F.col("__best.correct")
    best_score = -F.col("__best.down")
    use_thr = (at_thr > best) | ((at_thr == best) & (best_score > threshold))
    best_n = F.greatest(at_thr, best)
    return agg.withColumns({
        "eer": F.when(F.col("auc").isNotNull(), F.col("__eer.eer")),
        "eer_threshold": F.when(F.col("auc").isNotNull(), F.col("__eer.threshold")),
        "best_accuracy": best_n / F.col("n"),
        "best_threshold": F.when(use_thr, F.lit(float(threshold))).otherwise(best_score),
        "threshold_headroom": best_n / F.col("n") - F.col("accuracy")}).drop("__eer", "__best")


def evaluation_matrix(df: DataFrame, by=("domain", "model"), score="score", y="y", no_speech="no_speech") -> DataFrame:
    """Metrics per domain and model; a file without speech scores 0, which the endpoint would answer."""
    s = df.withColumn(score, F.when(F.col(no_speech), F.lit(0.0)).otherwise(F.col(score)))
    missing = df.groupBy(*by).agg(F.count_if(F.col(no_speech)).alias("files_without_speech"))
    return evaluate(s, list(by), score, 0.0, y).join(missing, list(by))


def worst_case(matrix: DataFrame, telephone: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """Worst metric of each model over all and over telephone domains."""
    return matrix.groupBy("model").agg(
        F.min(metric).alias("worst_all"),
        F.min(F.when(F.col("domain").isin(*telephone), F.col(metric))).alias("worst_telephone"))


def stress_matrix(df: DataFrame, condition="condition", clean="clean", score="score", y="y") -> DataFrame:
    """Metrics per condition next to the mean and worst over the stressed ones."""
    m = evaluate(df, [condition], score, 0.0, y).select(condition, "n", "accuracy", "auc")
    stressed = F.col(condition) != clean
    s = m.agg(F.avg(F.when(stressed, F.col("auc"))).alias("mean_auc_stressed"),
              F.avg(F.when(stressed, F.col("accuracy"))).alias("mean_accuracy_stressed"),
              F.min("auc").alias("worst_auc"),
              F.min_by(condition, F.struct("auc", condition)).alias("worst_condition"))
    return m.join(F.broadcast(s))  # one row by construction


# ------------------------------------------------------------------------------ feature scans

def long_features(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(ids), list(features), "feature", "value")


def single_feature_auc(long: DataFrame, by=("feature",), y="y", min_n: int = 4) -> DataFrame:
    c = score_curve(long.where(F.col("value").isNotNull() & ~F.isnan("value")), list(by), "value", y)
    n = F.max(F.col("tot_pos") + F.col("tot_neg"))
    return c.groupBy(*by).agg(n.alias("n"), F.when(n >= min_n, auc_column()).alias("auc"))


@F.pandas_udf(DoubleType())
def _two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(v / math.sqrt(2)), na_action="ignore")


def mann_whitney(long: DataFrame, by=("feature",), y="y") -> DataFrame:
    """U of the positive class and its normal approximation with ties and continuity corrected."""
    c = score_curve(long, list(by), "value", y)
    t = (F.col("pos") + F.col("neg")).cast("double")
    g = c.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * (F.col("cum_neg") + F.col("neg") / 2)).alias("u"),
        F.max(F.col("tot_pos").cast("double")).alias("n1"), F.max(F.col("tot_neg").cast("double")).alias("n0"),
        F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = safe_div(F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2) - 0.5, F.lit(0.0)), sd)
    return g.select(*by, "u", z.alias("z")).withColumn("p_value", _two_sided_p("z"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with the mean 1-based rank of their ties."""
    c = cumulative(df, by, value, {"n": F.count(F.lit(1))})
    return c.select(*by, value, (F.col("cum_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b)
             .agg(F.count(F.lit(1)).cast("double").alias("w")))
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = average_ranks(known, by, a).withColumnRenamed("rank", "ra")
    rb = average_ranks(known, by, b).withColumnRenamed("rank", "rb")
    j = pairs.join(ra, [*by, a]).join(rb, [*by, b])
    w, x, z = F.col("w"), F.col("ra"), F.col("rb")
    s = j.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * z).alias("sy"),
                           F.sum(w * x * z).alias("sxy"), F.sum(w * x * x).alias("sxx"), F.sum(w * z * z).alias("syy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    return s.select(*by, safe_div(cov, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("spearman"))


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson of every feature pair over the rows that know both: one matrix of products per task, summed.

    What comes to the driver grows with the square of the columns, never with the rows.
    """
    features, k = list(features), len(features)
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(float("nan"))) for f in features])
    means = df.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None))).alias(f"m{i}") for i, f in enumerate(features)]).first()
    centre = np.array([0.0 if m is None else m for m in means])

    def run(batches):
        total = np.zeros((4, k, k))
        for b in batches:
            if b.num_rows:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k) - centre
                known = (~np.isnan(v)).astype(float)
                v = np.nan_to_num(v, nan=0.0)
                total += np.stack((known.T @ known, v.T @ known, (v * v).T @ known, v.T @ v))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = df.select(x.alias("x")).mapInArrow(run, "v array<double>")
    n, s, ss, xy = parts.agg(Summarizer.sum(array_to_vector("v")).alias("s")).first().s.toArray().reshape(4, k, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - s * s.T / n
        r = cov / np.sqrt(np.maximum(ss - s * s / n, 0) * np.maximum(ss.T - s.T * s.T / n, 0))
    rows = [(features[i], features[j], float(r[i, j]) if np.isfinite(r[i, j]) else None) for i in range(k) for j in range(i + 1, k)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def rank_table(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    """Every feature replaced by its average rank."""
    long = long_features(df, [id_col], features)
    ranks = average_ranks(long, ["feature"], "value")
    j = long.join(ranks, ["feature", "value"])
    return j.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])


def spearman_matrix(df: DataFrame, id_col: str, features: Sequence[str]) -> DataFrame:
    return correlation_pairs(rank_table(df, id_col, features), features)


def id_leakage(df: DataFrame, id_value: Column, y: str = "y") -> DataFrame:
    """Does the id order carry the label? AUC of the id, and label runs against what chance gives."""
    d = df.select(id_value.alias("idv"), F.col(y).cast("int").alias("y"), F.lit("all").alias("scope"))
    s = scan(d, ["scope"], value_block(F.col("idv")), ["idv"], {"prev": ("last", "y")}, inclusive=False)
    runs = s.groupBy("scope").agg(
        F.sum(F.when(F.col("prev").isNull() | (F.col("prev") != F.col("y")), 1).otherwise(0)).alias("label_runs"),
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    a = roc_auc(d, ["scope"], "idv", "y").withColumnRenamed("auc", "id_auc")
    expected = 1 + 2.0 * F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1"))
    return runs.join(a, "scope").select("id_auc", "label_runs", expected.alias("expected_runs"))


def strata_by_train_quartile(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Quartile stratum (0-3) of every row, edges from the training rows only."""
    t = df.where(F.col(split) == "train").withColumn("__k", F.lit(1))
    edges = quantiles(t, ["__k"], value, {"q1": .25, "q2": .5, "q3": .75})
    b = sum((bool_int(F.col(value) >= F.col(q)) for q in ("q1", "q2", "q3")), F.lit(0))
    return (df.join(F.broadcast(edges.drop("__k")))  # one row of three edges
            .withColumn("stratum", b).drop("q1", "q2", "q3"))


def perturbation_report(original: DataFrame, changed: DataFrame, id_col="call_id", variant="variant",
                        threshold: float = 0.5) -> DataFrame:
    j = changed.join(original.select(id_col, F.col("p").alias("p0")), id_col)
    d = F.abs(F.col("p") - F.col("p0"))
    hit = lambda c: F.avg(((F.col(c) >= threshold) == (F.col("y") == 1)).cast("double"))
    return j.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_abs_change"), F.max(d).alias("max_abs_change"),
        F.count_if((F.col("p") >= threshold) != (F.col("p0") >= threshold)).alias("flips"),
        hit("p0").alias("accuracy_before"), hit("p").alias("accuracy_after"))


def error_free_lower_bound(df: DataFrame, by, correct: Column) -> DataFrame:
    """One-sided 95% lower bound of accuracy where a group has no error, else NULL."""
    n, errors = F.count(F.lit(1)), F.count_if(~correct)
    return df.groupBy(*by).agg(n.alias("n"), errors.alias("errors"),
                               F.when(errors == 0, F.pow(F.lit(0.05), 1 / n)).alias("lower_bound"))


def term_contributions(terms: DataFrame, by=("call_id",)) -> DataFrame:
    """Share of the absolute logit carried by missing-value flags. ``terms(.., value, is_flag)``."""
    flag = F.sum(F.when(F.col("is_flag"), F.abs("value")).otherwise(0.0))
    signed_flag = F.sum(F.when(F.col("is_flag"), F.col("value")).otherwise(0.0))
    signed_num = F.sum(F.when(F.col("is_flag"), 0.0).otherwise(F.col("value")))
    return terms.groupBy(*by).agg(
        (flag / F.greatest(F.sum(F.abs("value")), F.lit(1e-12))).alias("flag_share"),
        (F.abs(signed_flag) > F.abs(signed_num)).alias("flags_dominate"))


def missingness_support(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    return (df.groupBy(y).agg(*[F.count(f).alias(f) for f in features])
            .unpivot([y], list(features), "feature", "n_known"))


def claims_check(claims: DataFrame, computed: DataFrame, on: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Stated next to computed values; a claim nobody computed fails."""
    j = claims.join(computed, list(on), "left")
    ok = F.coalesce(F.abs(F.col("stated") - F.col("computed")) <= tolerance, F.lit(False))
    return j.withColumn("ok", ok)
