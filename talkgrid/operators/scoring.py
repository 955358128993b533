"""From chunk scores to call scores, and the grouped summaries of corpora and results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import cumulative, first_k, interpolated, per_key, quantiles
from ..functions.scalar import l2_normalized, logit, safe_div, sigmoid

# every aggregation reads the table of a call's distinct scores: ``n`` chunks and ``w`` seconds at each
PLAIN = {
    "mean": lambda v: F.sum(F.col(v) * F.col("n")) / F.sum("n"),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "mean_prob": lambda v: logit(F.sum(sigmoid(F.col(v), None) * F.col("n")) / F.sum("n")),
    "duration_weighted": lambda v: F.sum(F.col(v) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9)),
}


def _between(lo: Column, hi: Column) -> Column:
    """How many of a distinct value's copies fall at sorted positions ``[lo, hi)``."""
    return F.greatest(F.lit(0), F.least(F.col("cum_n") + F.col("n"), hi) - F.greatest(F.col("cum_n"), lo))


def _ranked_mean(value: str, lo: Column, hi: Column) -> Column:
    return F.sum(F.col(value) * _between(lo, hi)) / F.sum(_between(lo, hi))


RANKED = {
    "median": lambda v: interpolated(0.5, v),
    "top25_mean": lambda v: _ranked_mean(v, F.col("tot_n") - F.greatest(F.lit(1), F.ceil(F.col("tot_n") * 0.25)),
                                         F.col("tot_n")),
    "trimmed_mean": lambda v: _ranked_mean(v, F.floor(F.col("tot_n") * 0.1),
                                           F.col("tot_n") - F.floor(F.col("tot_n") * 0.1)),
}

#: aggregation registry: every name a call-level score can be asked for
AGGREGATIONS: dict[str, Callable] = PLAIN | RANKED
COMPARED = ["mean", "median", "max", "top25_mean", "trimmed_mean", "mean_prob", "duration_weighted"]


def call_scores(chunks: DataFrame, methods: Sequence[str] = ("mean",), keys: Sequence[str] = ("call_id",),
                score: str = "score", weight: str = "duration_s") -> DataFrame:
    """One column per aggregation of a call's chunk scores."""
    unknown = set(methods) - set(AGGREGATIONS)
    if unknown:
        raise ValueError(f"unknown aggregation {sorted(unknown)}")
    keys = list(keys)
    seconds = F.col(weight) if "duration_weighted" in methods else F.lit(0.0)
    measures = {"n": F.count(F.lit(1)), "w": F.sum(seconds)}
    d = chunks.withColumn("__s", F.col(score))
    out = {"n_chunks": F.sum("n")} | {m: AGGREGATIONS[m]("__s") for m in methods}
    if any(m in RANKED for m in methods):
        return per_key(d, keys, "__s", measures, out)
    d = d.groupBy(*keys, "__s").agg(*[m.alias(n) for n, m in measures.items()])
    return d.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


def complete_calls(calls: DataFrame, scores: DataFrame, fill: Sequence[str], on: str = "call_id") -> DataFrame:
    """Every call kept; one without chunks scores 0 over 0 chunks."""
    return calls.join(scores, on, "left").fillna(0, subset=list(fill))


def call_table(chunks: DataFrame, calls: DataFrame, page: int = 1024) -> DataFrame:
    """y, mean score, chunk count and ordered score list per call.

    The list comes in pages of ``page`` chunk numbers, one row each, so an ordinary call has
    one row and an endless one never becomes a single value.
    """
    g = chunks.groupBy("call_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"))
    lists = chunks.groupBy("call_id", F.floor((F.col("chunk") - 1) / page).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("chunk", "score"))).alias("s"))
    return calls.join(g, "call_id").join(lists, "call_id").select(
        "call_id", "page", "y", "split", "score", "n_chunks", F.col("s.score").alias("scores"))


def aggregation_compare(chunks: DataFrame, calls: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Metrics of every aggregation side by side."""
    from .metrics import evaluate
    s = complete_calls(calls, call_scores(chunks, COMPARED), COMPARED + ["n_chunks"])
    long = s.unpivot([*by, "y"], COMPARED, "method", "score")
    return evaluate(long, ["method", *by])


# ------------------------------------------------------------------------------ vectors

def mean_vector(df: DataFrame, keys: Sequence[str], emb: str = "emb", extra: dict[str, Column] | None = None) -> DataFrame:
    """Element-wise mean, L2 normalised, and ``extra`` aggregates: one aggregation, combined before the shuffle. The vectors of a key are equally long."""
    keys = list(keys)
    mean = Summarizer.mean(array_to_vector(F.col(emb).cast("array<double>")))
    out = df.where(F.col(emb).isNotNull()).groupBy(*keys).agg(mean.alias("__m"), *[c.alias(n) for n, c in (extra or {}).items()])
    return out.select(*keys, l2_normalized(vector_to_array("__m")).alias("vec"), *(extra or {}))


def longest_chunks_vector(df: DataFrame, k: int = 8, keys: Sequence[str] = ("call_id",)) -> DataFrame:
    top = first_k(df, list(keys), [F.col("duration_s").desc(), F.col("chunk")], k)
    return mean_vector(top, keys)


def few_chunks(chunks: DataFrame, seed: int = 0) -> DataFrame:
    """Call score from the first, one random, the first three and all chunks, one row per variant."""
    first = first_k(chunks, ["call_id"], [F.col("chunk")], 3)
    draw = F.xxhash64("call_id", "chunk", F.lit(seed))
    rnd = chunks.groupBy("call_id").agg(F.min_by("score", F.struct(draw, "chunk")).alias("score"), F.lit(1).alias("used"))
    parts = [("first", first.where("rank = 1")), ("first3", first), ("all", chunks)]
    out = rnd.select("call_id", F.lit("random").alias("variant"), "score", F.col("used").cast("bigint"))
    for name, d in parts:
        out = out.unionByName(d.groupBy("call_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("used"))
                              .withColumn("variant", F.lit(name)))
    return out


def single_chunks(chunks: DataFrame, calls: DataFrame, short_s: float = 2.0) -> DataFrame:
    """Every chunk judged on its own, all of them and only the short ones."""
    j = chunks.join(calls.select("call_id", "y", "split"), "call_id")
    return j.select("call_id", "y", "split", "score", F.explode(F.when(
        F.col("duration_s") < short_s, F.array(F.lit("single"), F.lit("single_short"))).otherwise(
        F.array(F.lit("single")))).alias("variant"))


# ------------------------------------------------------------------------------ grouped summaries

def group_counts(df: DataFrame, rows: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*rows).pivot(label, list(labels)).count().na.fill(0)


def group_count_rollup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.rollup(*cols).agg(F.count(F.lit(1)).alias("n"))


def class_medians(long: DataFrame, by: Sequence[str] = ("split", "feature", "label")) -> DataFrame:
    """Median, missing share and distinct values per feature and class."""
    by = list(by)
    c = cumulative(long, by, "value", {"n": F.count(F.lit(1))})
    known = c.groupBy(*by).agg(interpolated(0.5, "value").alias("median"), F.count(F.lit(1)).alias("n_distinct"))
    miss = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                 F.avg(F.col("value").isNull().cast("double")).alias("missing_share"))
    return miss.join(known, by, "left").fillna(0, subset=["n_distinct"])


def describe(long: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per feature."""
    by = list(by)
    m = long.groupBy(*by).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                              F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return m.join(quantiles(long, by, "value", {"q25": .25, "q50": .5, "q75": .75}), by, "left")


def typical_example(df: DataFrame, id_col: str, label: str, targets: dict[str, float]) -> DataFrame:
    """Per class the row nearest to its class medians; ``targets`` gives each column's scale."""
    long = df.unpivot([label], list(targets), "feature", "value")
    med = quantiles(long, [label, "feature"], "value", {"m": .5})
    wide = med.groupBy(label).agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"__m_{c}") for c in targets])
    d = sum((F.abs(F.col(c) - F.col(f"__m_{c}")) / scale for c, scale in targets.items()), F.lit(0.0))
    j = df.join(wide, label).withColumn("distance", d)
    return j.groupBy(label).agg(F.min_by(id_col, F.struct("distance", id_col)).alias(id_col),
                                F.min("distance").alias("distance"))


def source_summary(df: DataFrame, by=("source", "variant"), threshold: float = 0.0) -> DataFrame:
    """Share correct, median probability and score per source and variant."""
    by = list(by)
    ok = ((F.col("score") >= threshold) == (F.col("y") == 1)).cast("double")
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("correct"))
    med = quantiles(df, by, "score", {"median_score": .5})
    medp = quantiles(df.withColumn("__p", sigmoid(F.col("score"))), by, "__p", {"median_p": .5})
    return base.join(med, by).join(medp, by)


def augmentation_summary(manifest: DataFrame, by=("split", "family", "label")) -> DataFrame:
    """Samples, hours, failures and delay spread per part of the augmentation manifest, measured on the good rows."""
    by, ok = list(by), F.col("status") == "ok"
    good = lambda c: F.when(ok, F.col(c))
    a = manifest.groupBy(*by).agg(
        F.count_if(ok).alias("samples"), F.count_if(~ok).alias("failed"), (F.sum(good("duration_s")) / 3600).alias("hours"),
        F.min(good("delay_ms")).alias("delay_min"), F.max(good("delay_ms")).alias("delay_max"),
        F.avg(good("level_change_db")).alias("mean_level_change_db"))
    return a.join(quantiles(manifest.where(ok), by, "delay_ms", {"delay_median": .5}), by, "left")


def codec_frequencies(manifest: DataFrame, codecs: str = "codecs") -> DataFrame:
    return (manifest.select(F.explode(F.split(codecs, "[+]")).alias("codec"))
            .groupBy("codec").agg(F.count(F.lit(1)).alias("n")))


def processing_summary(df: DataFrame, by=("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("seconds").alias("mean_seconds"), F.avg("duration_s").alias("mean_duration"),
                               (F.sum("seconds") / F.sum("duration_s")).alias("real_time_factor"))


def chunk_budget(calls: DataFrame, chunks: DataFrame, by: str = "split") -> DataFrame:
    """Chunks, hours, median chunks per call and calls without any, per split."""
    per = chunks.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("duration_s").alias("chunk_s"))
    j = calls.select("call_id", by).join(per, "call_id", "left").fillna(0, subset=["n_chunks", "chunk_s"])
    med = quantiles(j, [by], "n_chunks", {"median_chunks": .5})
    return j.groupBy(by).agg(F.sum("n_chunks").alias("n_chunks"), (F.sum("chunk_s") / 3600).alias("chunk_hours"),
                             F.count_if(F.col("n_chunks") == 0).alias("calls_without_chunks")).join(med, by)


def model_comparison(results: DataFrame, ids: Sequence[str], metrics: Sequence[str],
                     shortcut: DataFrame | None = None) -> DataFrame:
    """Long table of metrics per model; the best shortcut row is added where given."""
    if shortcut is not None:
        best = shortcut.orderBy(F.desc("auc"), *ids).limit(1)
        results = results.select(*ids, *metrics).unionByName(best.select(*ids, *metrics))
    return results.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value")


def class_histogram(df: DataFrame, value: str, label: str, labels: Sequence[str], bins: int, lo: float, hi: float,
                    clip: bool = True) -> DataFrame:
    """Equal-width counts per class over one range; the top edge falls into the last bin."""
    v = F.least(F.greatest(F.col(value), F.lit(lo)), F.lit(hi)) if clip else F.col(value)
    b = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    d = df.where(F.col(value).between(lo, hi)) if not clip else df
    return d.withColumn("bin", b).groupBy("bin").pivot(label, list(labels)).count().na.fill(0)


def error_review(scored: DataFrame, turns: DataFrame, threshold: float = 0.5, page_ms: int = 3_600_000) -> DataFrame:
    """Misjudged calls with their turn timeline, one row per hour of call."""
    kind = F.when((F.col("p") >= threshold) & (F.col("y") == 0), "false_positive").when(
        (F.col("p") < threshold) & (F.col("y") == 1), "false_negative")
    wrong = scored.withColumn("kind", kind).where(F.col("kind").isNotNull())
    t = turns.join(wrong.select("call_id"), "call_id", "left_semi")
    line = t.groupBy("call_id", F.floor(F.col("start_ms") / page_ms).alias("page")).agg(
        F.sort_array(F.collect_set(F.struct("start_ms", "end_ms", "channel"))).alias("timeline"))
    return wrong.join(line, "call_id", "left")


def paired_shift(original: DataFrame, changed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Before/after row per call: ``(call_id, y, p, n_chunks)`` on both sides."""
    o = original.select("call_id", "y", F.col("p").alias("p_original"), F.col("n_chunks").alias("chunks_original"))
    c = changed.select("call_id", F.col("p").alias("p_changed"), F.col("n_chunks").alias("chunks_changed"))
    hit = lambda p: (F.col(p) >= threshold) == (F.col("y") == 1)
    return o.join(c, "call_id").withColumns({"delta_p": F.col("p_changed") - F.col("p_original"),
                                             "ok_original": hit("p_original"), "ok_changed": hit("p_changed")})


def shift_summary(pairs: DataFrame, by: Sequence[str] = (), least_shift: float = 0.05) -> DataFrame:
    """Accuracies, mean shift, lost verdicts, segmentation failures; ``go`` unless nothing moved at all."""
    shift = F.avg(F.abs("delta_p"))
    flips = F.count_if(F.col("ok_original") & ~F.col("ok_changed"))
    dead = F.count_if(F.col("chunks_changed") == 0)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ok_original").cast("double")).alias("accuracy_original"),
        F.avg(F.col("ok_changed").cast("double")).alias("accuracy_changed"),
        shift.alias("mean_abs_delta_p"), flips.alias("flips"), dead.alias("segmentation_failures"),
        (~((shift < least_shift) & (flips == 0) & (dead == 0))).alias("go"))
