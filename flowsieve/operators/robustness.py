"""Robustness of a linear scorer. The gradient has a closed form, so attacks are column expressions over the table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsieve.functions.columns import clip, total

# Perturbation sizes of the sweep.
EPSILONS = [0.001, 0.005, 0.01, 0.05, 0.1]


def linear_score(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    return total([x * F.lit(float(w)) for x, w in zip(features, weights)]) + F.lit(float(bias))


def linear_predict(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    return (linear_score(features, weights, bias) >= 0).cast("int")


def _sign(w: float) -> float:
    return (w > 0) - (w < 0)


def fgsm(features: Sequence[str], weights: Sequence[float], label: str, epsilon: float) -> list[Column]:
    """clip(x + eps * sign((p - y) w), 0, 1): p lies strictly between the labels, so the sign of p - y is that of 1/2 - y."""
    away = F.when(F.col(label) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [clip(F.col(c) + away * F.lit(epsilon * _sign(w)), 0, 1) for c, w in zip(features, weights)]


def pgd(features: Sequence[str], weights: Sequence[float], label: str, epsilon: float, alpha: float, steps: int) -> list[Column]:
    """``steps`` moves of ``alpha`` inside the eps ball. The direction never changes, so they end at min(steps * alpha, eps)."""
    return fgsm(features, weights, label, min(steps * alpha, epsilon))


def attack(df: DataFrame, features: Sequence[str], moved: Sequence[Column], suffix: str = "_adv") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": m for c, m in zip(features, moved)})


def epsilon_sweep(
    df: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float, label: str,
    epsilons: Sequence[float] = EPSILONS, alpha_share: float = 0.25, steps: int = 10,
) -> DataFrame:
    """(epsilon, fgsm_accuracy, pgd_accuracy, robustness_score), all from one pass over the table."""
    aggs = []
    for i, e in enumerate(epsilons):
        for name, moved in (("f", fgsm(features, weights, label, e)), ("p", pgd(features, weights, label, e, e * alpha_share, steps))):
            hit = linear_predict(moved, weights, bias) == F.col(label)
            aggs.append(F.avg(hit.cast("int")).alias(f"{name}{i}"))
    wide = df.agg(*aggs)
    cells = [F.struct(F.lit(float(e)).alias("epsilon"), F.col(f"f{i}").alias("fgsm_accuracy"), F.col(f"p{i}").alias("pgd_accuracy")) for i, e in enumerate(epsilons)]
    out = wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return out.withColumn("robustness_score", (F.col("fgsm_accuracy") + F.col("pgd_accuracy")) / 2)


def perturbation_summary(df: DataFrame, features: Sequence[str], moved: Sequence[Column], weights: Sequence[float], bias: float, label: str) -> DataFrame:
    """Clean and attacked accuracy, gap, success rate, and mean and largest L2 size of the change."""
    made = attack(df, features, moved)
    size = F.sqrt(total([F.pow(F.col(f"{c}_adv") - F.col(c), F.lit(2.0)) for c in features]))
    clean = linear_predict([F.col(c) for c in features], weights, bias) == F.col(label)
    adv = linear_predict([F.col(f"{c}_adv") for c in features], weights, bias) == F.col(label)
    row = made.agg(
        F.avg(clean.cast("int")).alias("clean_accuracy"), F.avg(adv.cast("int")).alias("adversarial_accuracy"),
        F.avg(size).alias("avg_perturbation"), F.max(size).alias("max_perturbation"),
    )
    return row.withColumns({
        "robustness_gap": F.col("clean_accuracy") - F.col("adversarial_accuracy"), "success_rate": 1.0 - F.col("adversarial_accuracy"),
    })


# the constants of XXH64
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_int(value: int, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of one more int column, for many rows: ``seed`` is the hash of the columns before it."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.uint64(value) * _P1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _uniform(seed: np.ndarray, part: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by their hashes."""
    return ((hash_int(part, seed) & np.uint64((1 << 52) - 1)).astype(float) + 0.5) / float(1 << 52)


ROWS_AT_ONCE = 2048  # the arrays of so many rows stay in a core's cache


def _count_votes(norm: float, copies: int):
    @F.pandas_udf(T.IntegerType())
    def count(hashes: pd.Series, scores: pd.Series) -> pd.Series:
        out = np.zeros(len(scores), np.int32)
        with np.errstate(over="ignore"):
            for at in range(0, len(scores), ROWS_AT_ONCE):
                here = slice(at, at + ROWS_AT_ONCE)
                seed, score = hashes.to_numpy(np.int64)[here].view(np.uint64), scores.to_numpy(float)[here]
                for i in range(1, copies + 1):
                    own = hash_int(i, seed)
                    noise = np.sqrt(-2.0 * np.log(_uniform(own, 1))) * np.cos(2 * math.pi * _uniform(own, 2))
                    # NaN is above all numbers, as in Spark's comparisons
                    out[here] += ~(score + norm * noise < 0)
        return pd.Series(out)

    return count


def noisy_votes(
    df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float], bias: float, epsilon: float, copies: int, out: str = "votes",
) -> DataFrame:
    """Adds ``out``: how many of ``copies`` noisy copies of a row the scorer puts in class 1.

    Gaussian noise on the features reaches a linear score as one Gaussian of
    size eps * |w|, so every copy is a number in the row and no row is repeated.
    The noise is a hash of the row key: a retry draws the same. A missing feature gives NULL.
    """
    norm = epsilon * math.sqrt(sum(w * w for w in weights))
    score = linear_score([F.col(c) for c in features], weights, bias)
    votes = _count_votes(norm, copies)(F.xxhash64(F.col(key)), F.coalesce(score, F.lit(0.0)))
    return df.withColumn(out, F.when(score.isNotNull(), votes))


def smoothed_accuracy(
    df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float], bias: float, label: str, epsilon: float = 0.01, copies: int = 100,
) -> DataFrame:
    """Accuracy of the majority vote over noisy copies of each row."""
    made = noisy_votes(df, key, features, weights, bias, epsilon, copies, "_votes")
    pred = (F.col("_votes") * 2 > copies).cast("int")
    return made.agg(F.avg((pred == F.col(label)).cast("int")).alias("smoothed_accuracy"), F.count(F.lit(1)).alias("n"))


def share_bound(votes: int, copies: int, error: float) -> float:
    """Exact binomial lower bound: the share at which ``votes`` or more of ``copies`` have probability ``error``."""
    if votes == 0:
        return 0.0
    logs = [math.lgamma(copies + 1) - math.lgamma(i + 1) - math.lgamma(copies - i + 1) for i in range(votes, copies + 1)]
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (copies - i) * math.log1p(-p)) for i, c in enumerate(logs, votes))
        low, high = (p, high) if tail < error else (low, p)
    return low


def certified_radius(
    df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float], bias: float, epsilon: float = 0.25, copies: int = 1000, error: float = 0.001,
) -> DataFrame:
    """Adds ``votes``, ``smoothed_pred`` and ``radius``: no change of the features shorter than the radius alters the majority, with
    probability 1 - ``error`` a row. Radius and prediction are NULL where the votes do not settle a majority.

    The radius depends on the vote count alone, so it is a table of ``copies`` + 1 numbers in the plan.
    """
    shares = [share_bound(v, copies, error / 2) for v in range(copies + 1)]  # the class is picked by the same votes: half the error each
    radii = [epsilon * NormalDist().inv_cdf(min(p, 1 - 1e-15)) if p > 0.5 else None for p in shares]
    made = noisy_votes(df, key, features, weights, bias, epsilon, copies)
    one = F.col("votes") * 2 > copies
    radius = F.get(F.array(*[F.lit(r).cast("double") for r in radii]), F.when(one, F.col("votes")).otherwise(copies - F.col("votes")))
    return made.withColumn("radius", radius).withColumn("smoothed_pred", F.when(F.col("radius").isNotNull(), one.cast("int")))


def fitted_weights(model: PipelineModel) -> tuple[list[float], float]:
    """(weights, bias) over the input columns of a logistic model, a standardising stage before it included."""
    linear = model.stages[-1]
    weights, bias = [float(w) for w in linear.coefficients], float(linear.intercept)
    for stage in model.stages[:-1]:
        if isinstance(stage, StandardScalerModel):
            unit = [1.0 / s if s > 0 else 0.0 for s in stage.std]
            weights = [w * u for w, u in zip(weights, unit)]
            bias -= sum(w * float(m) for w, m in zip(weights, stage.mean))
        elif not isinstance(stage, VectorAssembler):
            raise ValueError(f"cannot see through a {type(stage).__name__}")
    return [float(w) for w in weights], float(bias)
