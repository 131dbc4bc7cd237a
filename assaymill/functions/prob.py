"""Probability vectors over a fixed list of class values.

Vectors are array columns. Functions that normalise a vector work on the
DataFrame and keep the maximum and the total in columns of their own: written as
one nested expression, every element would repeat them, and a vector unrolled
into its elements soon exceeds what one generated method may hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaymill.config import DEFAULTS

SIGMOID_CLIP = 60.0
MIN_TEMPERATURE = 1e-3
MIN_PROBABILITY = 1e-12


def elements(array: Column | str, k: int) -> list[Column]:
    array = F.col(array) if isinstance(array, str) else array
    return [array[i] for i in range(k)]


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _shifted(df: DataFrame, logits: str, temperature: Column | float) -> DataFrame:
    t = F.greatest(F.lit(temperature), F.lit(MIN_TEMPERATURE))
    df = df.withColumns({"_top": F.array_max(logits), "_t": t})
    return df.withColumn("_d", F.transform(logits, lambda z: (z - F.col("_top")) / F.col("_t")))


def _sum(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def softmax(df: DataFrame, logits: str, out: str, temperature: Column | float = 1.0) -> DataFrame:
    df = _shifted(df, logits, temperature).withColumn("_e", F.transform("_d", F.exp))
    df = df.withColumn("_s", _sum("_e"))
    return df.withColumn(out, F.transform("_e", lambda e: e / F.col("_s"))).drop("_top", "_t", "_d", "_e", "_s")


def log_softmax(df: DataFrame, logits: str, out: str, temperature: Column | float = 1.0) -> DataFrame:
    df = _shifted(df, logits, temperature)
    df = df.withColumn("_s", F.ln(F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + F.exp(x))))
    return df.withColumn(out, F.transform("_d", lambda d: d - F.col("_s"))).drop("_top", "_t", "_d", "_s")


def soft_label(
    df: DataFrame,
    value: str,
    out: str,
    centres: Sequence[float] = DEFAULTS.centres,
    sigma: float = DEFAULTS.soft_sigma,
) -> DataFrame:
    """Gaussian weights of a value over the class centres, summing to one."""
    grid = F.array(*[F.lit(c) for c in centres])
    score = F.transform(grid, lambda c: F.lit(-0.5) * F.pow((F.col(value) - c) / F.lit(sigma), F.lit(2.0)))
    return softmax(df.withColumn("_score", score), "_score", out).drop("_score")


def sigmoid(x: Column) -> Column:
    bounded = F.least(F.lit(SIGMOID_CLIP), F.greatest(F.lit(-SIGMOID_CLIP), x))
    return 1.0 / (1.0 + F.exp(-bounded))


def expected_value(p: str, values: Sequence[float]) -> Column:
    """Mean of the distribution; NULL where its mass is zero."""
    parts = elements(p, len(values))
    mass = total(parts)
    return F.when(mass > MIN_PROBABILITY, total([a * F.lit(v) for a, v in zip(parts, values)]) / mass)


def predictive_sigma(p: str, values: Sequence[float]) -> Column:
    mean = expected_value(p, values)
    second = expected_value(p, [v * v for v in values])
    return F.sqrt(F.greatest(second - mean * mean, F.lit(0.0)))


def nearest_centre(value: Column, centres: Sequence[float] = DEFAULTS.centres) -> Column:
    """Position of the closest centre, the lower one on a tie."""
    gaps = F.array(*[F.abs(value - F.lit(c)) for c in centres])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def probability_below(p: str, cut: Column, centres: Sequence[float] = DEFAULTS.centres) -> Column:
    parts = elements(p, len(centres))
    return total([F.when(F.lit(c) < cut, a).otherwise(0.0) for a, c in zip(parts, centres)])


def argmax(array: Column | str) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def decode(df: DataFrame, head: str, outputs: str, out: str, centres: Sequence[float] = ()) -> DataFrame:
    """Raw head output (an array) to one value on the label scale."""
    if head == "regression":
        return df.withColumn(out, F.col(outputs)[0])
    if head == "binary":
        hit = sigmoid(F.col(outputs)[0])
        return df.withColumn("_hit", hit).withColumn(
            out, (1.0 - F.col("_hit")) * F.lit(centres[0]) + F.col("_hit") * F.lit(centres[1])
        ).drop("_hit")
    if head in ("severity", "ordinal", "multitask"):
        shared = softmax(df, outputs, "_p")
        return shared.withColumn(out, expected_value("_p", centres)).drop("_p")
    raise ValueError(f"unknown head {head!r}")


# --- losses of one row, over log-probabilities from ``log_softmax`` ------------


def smooth_l1(t: Column, p: Column, beta: float = 1.0) -> Column:
    d = F.abs(p - t)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def soft_cross_entropy(log_p: str, target: str, k: int) -> Column:
    return -total([y * l for y, l in zip(elements(target, k), elements(log_p, k))])


def cross_entropy(log_p: str, index: Column, weight: Column | None = None) -> Column:
    loss = -F.col(log_p)[index]
    return loss if weight is None else loss * weight


def focal(log_p: str, index: Column, gamma: float = 2.0, weight: Column | None = None) -> Column:
    own = F.col(log_p)[index]
    loss = -F.pow(1.0 - F.exp(own), F.lit(gamma)) * own
    return loss if weight is None else loss * weight


def binary_cross_entropy(logit: Column, hit: Column, weight: Column | None = None) -> Column:
    loss = F.greatest(logit, F.lit(0.0)) - logit * hit + F.log1p(F.exp(-F.abs(logit)))
    return loss if weight is None else loss * weight


def multitask(soft_loss: Column, t: Column, p: Column, scalar_weight: float = 0.5, beta: float = 1.0) -> Column:
    return soft_loss + scalar_weight * smooth_l1(t, p, beta)
