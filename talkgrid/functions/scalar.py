"""Column expressions used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def sigmoid(z: Column, bound: float | None = 40.0) -> Column:
    return 1 / (1 + F.exp(-(clamp(z, -bound, bound) if bound else z)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def calibrate(score: Column, a: float = 1.0, b: float = 0.0, bound: float | None = 40.0) -> Column:
    """Platt-style probability; ``bound=None`` leaves the argument unclipped."""
    return sigmoid(score * a + b, bound)


def is_confident(p: Column, hi: float = 0.85, lo: float = 0.15) -> Column:
    return (p >= hi) | (p <= lo)


def is_synthetic(p: Column, threshold: float | Column = 0.5) -> Column:
    return p >= threshold


def confidence(p: Column, mode: str | Column = "verdict") -> Column:
    m = mode if isinstance(mode, Column) else F.lit(mode)
    return F.bround(F.when(m == "verdict", F.greatest(p, 1 - p)).otherwise(p), 4)


def safe_div(a: Column, b: Column, empty: float | None = None) -> Column:
    q = a / F.nullif(b, F.lit(0))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def bool_int(c: Column) -> Column:
    return c.cast("int")


def known_mean(c: Column) -> Column:
    """Mean of the known booleans, NULL when there is none."""
    return F.avg(c.cast("double"))


def mask_identifier(c: Column, keep: int = 4) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) >= keep, F.concat(F.lit("…"), F.right(digits, F.lit(keep)))).otherwise(F.lit("…"))


def level_gain(rms: Column, target_db: float = -26.0) -> Column:
    return F.lit(10 ** (target_db / 20)) / (rms + 1e-9)


def apply_gain(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda x: x * gain)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; inside a lambda it would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def zscore_array(samples: Column, floor: float = 1e-7) -> Column:
    n = F.size(samples).cast("double")
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n

    def scaled(m):
        var = F.aggregate(samples, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n
        return let(F.sqrt(var + floor), lambda sd: F.transform(samples, lambda x: (x - m) / sd))

    return let(mean, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return let(F.greatest(n, F.lit(1e-12)), lambda m: F.transform(v, lambda x: x.cast("double") / m))


def hash_uniform(*cols: Column) -> Column:
    """Uniform draw in [0, 1) fixed by its inputs."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)
