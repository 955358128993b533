"""How much a layer's answer is worth, and which inputs are refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# fixed values: quality of the transcript layer by the path it took, seconds of speech that fill the acoustic layer
QUALITY_BY_PATH = {"f4+f5": 1.0, "f4": 0.5, "abstain": 0.0}
UNKNOWN_PATH_QUALITY = 0.5
FULL_SPEECH_S = 12.0
MIN_WORDS = 5


def acoustic_quality(speech_s: Column, n_chunks: Column | None = None) -> Column:
    q = F.least(F.lit(1.0), speech_s / FULL_SPEECH_S)
    return F.when(n_chunks == 0, 0.0).otherwise(q) if n_chunks is not None else q


def semantic_quality(path: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in QUALITY_BY_PATH.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, path), F.lit(UNKNOWN_PATH_QUALITY))


def semantic_path(n_words: Column, has_agent: Column, has_rubric: Column) -> Column:
    """Transcript and rubric, transcript alone, or nothing usable; with the reason."""
    way = lambda p, r: F.struct(F.lit(p).alias("path"), F.lit(r).alias("reason"))
    return (F.when(n_words.isNull(), way("abstain", "asr_error")).when(n_words < MIN_WORDS, way("abstain", "no_speech"))
            .when(~has_agent | ~has_rubric, way("f4", "degraded")).otherwise(way("f4+f5", "")))


def input_guard(features: Sequence[str], min_s: float, max_s: float, min_speech_s: float,
                duration: str = "duration_s", speech: str = "caller_speech_s") -> Column:
    """Why a call is refused, NULL when it is not."""
    broken = F.lit(False)
    for f in features:
        v = F.col(f).cast("double")
        broken = broken | F.isnan(v) | (F.abs(v) == float("inf"))
    return (F.when(F.col(duration) < min_s, "too_short").when(F.col(duration) > max_s, "too_long")
            .when(F.col(speech) < min_speech_s, "not_enough_speech").when(broken, "non_finite_feature"))


def feature_vector(order: Sequence[str], fill: dict[str, float]):
    """Assembler over a fixed column order, and the columns with what is missing filled in."""
    from pyspark.ml.feature import VectorAssembler
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(float(fill.get(c, 0.0)))).alias(c) for c in order]
    return cols, VectorAssembler(inputCols=list(order), outputCol="vector")
