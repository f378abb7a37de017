"""Combining predictions, risk levels and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.functions.columns import time_bucket
from flowsieve.operators.ordering import attach_row, column_quantiles, match_keys

# Lower limits of the risk levels, and the score from which traffic is blocked.
RISK_LEVELS = [("critical", 0.8), ("high", 0.6), ("medium", 0.3)]
BLOCK_FROM = 0.5
ALERT_LEVELS = ["high", "critical"]
CACHE_SECONDS = 300


def majority_vote(votes: DataFrame, row: str, cls: str = "cls") -> DataFrame:
    """Most frequent class per row over any number of models; the smallest class on ties."""
    counts = votes.groupBy(row, cls).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(row).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(cls).alias("c"))).alias("_b"))
    return best.select(row, F.col("_b.c").alias("pred"), (-F.col("_b.m")).alias("votes"))


def average_probabilities(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of probability arrays that sit side by side in a row."""
    weights = list(weights or [1.0] * len(columns))
    scale = sum(weights)

    def scaled(c: str, share: float) -> Column:
        return F.transform(F.col(c), lambda x: x * F.lit(share))

    acc = None
    for c, w in zip(columns, weights):
        part = scaled(c, w / scale)
        acc = part if acc is None else F.zip_with(acc, part, lambda a, b: a + b)
    return acc


def argmax(proba: str | Column) -> Column:
    """0-based position of the first maximum."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def average_long(probas: DataFrame, row: str, weight: str | None = None, proba: str = "proba") -> DataFrame:
    """Mean probability per class when each model is a row, with the winning class."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = probas.select(row, w.alias("_w"), F.posexplode(proba).alias("cls", "p"))
    mean = cells.groupBy(row, "cls").agg((F.sum(F.col("p") * F.col("_w")) / F.sum("_w")).alias("p"))
    best = mean.groupBy(row).agg(F.min(F.struct((-F.col("p")).alias("q"), "cls")).alias("_b"))
    return best.select(row, F.col("_b.cls").alias("pred"), (-F.col("_b.q")).alias("confidence"))


def agree_or_surer(pred_a: str, conf_a: str, pred_b: str, conf_b: str) -> tuple[Column, Column]:
    """(class, confidence): the shared class with the mean confidence, else the surer model's."""
    same = F.col(pred_a) == F.col(pred_b)
    a_wins = F.col(conf_a) >= F.col(conf_b)
    cls = F.when(same | a_wins, F.col(pred_a)).otherwise(F.col(pred_b))
    conf = F.when(same, (F.col(conf_a) + F.col(conf_b)) / 2).otherwise(F.greatest(conf_a, conf_b))
    return cls, conf


def confidence_gate(proba: str, threshold: float) -> Column:
    """Predicted class, -1 where the best probability is below ``threshold``."""
    return F.when(F.array_max(proba) >= threshold, argmax(proba)).otherwise(F.lit(-1))


def score_rows(df: DataFrame, proba: str = "proba") -> DataFrame:
    """Class, confidence and threat score (1 - p of class 0)."""
    return df.withColumns({
        "threat_class": argmax(proba), "confidence": F.array_max(proba),
        "threat_score": F.lit(1.0) - F.element_at(proba, 1),
    })


def focal_loss(y: str, p: str, gamma: float = 2.0, alpha: Sequence[float] | None = None) -> Column:
    """alpha_y (1 - p_y)^gamma (-ln p_y) of a binary score, p_y kept above 0."""
    hit = F.col(y) == 1
    py = F.greatest(F.when(hit, F.col(p)).otherwise(1.0 - F.col(p)), F.lit(1e-12))
    loss = F.pow(1.0 - py, F.lit(float(gamma))) * -F.log(py)
    if alpha is not None:
        loss = F.when(hit, F.lit(float(alpha[1]))).otherwise(F.lit(float(alpha[0]))) * loss
    return loss


def risk_level(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    out = None
    for name, low in RISK_LEVELS:
        out = F.when(s >= low, name) if out is None else out.when(s >= low, name)
    return out.otherwise("low")


def recommendation(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < BLOCK_FROM, "Monitor traffic").otherwise("Block connection")


def with_risk(df: DataFrame, score: str) -> DataFrame:
    return df.withColumns({"risk_level": risk_level(score), "recommendation": recommendation(score)})


def alert_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("risk_level").isin(*ALERT_LEVELS))


def flow_fingerprint(src: str, sport: str, dst: str, dport: str, packets: Column) -> Column:
    s = [F.col(c).cast("string") for c in (src, sport, dst, dport)]
    return F.md5(F.concat(s[0], F.lit(":"), s[1], F.lit("-"), s[2], F.lit(":"), s[3], F.lit("-"), packets.cast("string")))


def reuse_results(df: DataFrame, fingerprint: str, t: str, tie: str, seconds: int = CACHE_SECONDS) -> DataFrame:
    """Mark rows that can reuse the result of an earlier equal request.

    Time is cut into windows of ``seconds``; the first request of a fingerprint
    in a window is computed, later ones reuse it, so no result older than
    ``seconds`` is ever served. A busy fingerprint spreads over its windows.
    """
    b = df.withColumn("_w", time_bucket(t, seconds))
    first = b.groupBy(fingerprint, "_w").agg(F.min(F.struct(t, tie)).alias("_first"))
    joined = match_keys(b, first, [fingerprint, "_w"])
    return joined.withColumn("reused", F.col(tie) != F.col(f"_first.{tie}")).withColumn(
        "source_row", F.col(f"_first.{tie}")).drop("_w", "_first")


def traffic_mix(df: DataFrame, by: str, size: str, threat: str) -> DataFrame:
    """Count, share, threats and threat rate per traffic class."""
    w = Window.partitionBy()  # over one row per traffic class
    c = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(threat) != 0).alias("threats"), F.avg(size).alias("size_mean"),
        F.min(size).alias("size_min"), F.max(size).alias("size_max"),
    )
    return c.withColumns({"percent": F.col("n") * 100.0 / F.sum("n").over(w), "threat_rate": F.col("threats") / F.col("n")})


def size_summary(df: DataFrame, size: str) -> DataFrame:
    row = df.agg(F.avg(size).alias("mean"), F.min(size).alias("min"), F.max(size).alias("max"))
    return attach_row(row, column_quantiles(df, [size], [0.5])).select("mean", "min", "max", F.col(f"_s.{size}_p50").alias("median"))


def model_agreement(df: DataFrame, pred_a: str, pred_b: str) -> DataFrame:
    same = F.col(pred_a) == F.col(pred_b)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agreements"), F.avg(same.cast("int")).alias("agreement_rate"))


def model_summary(long: DataFrame, model: str, cls: str, confidence: str) -> DataFrame:
    """Predicted-class counts and mean confidence per model."""
    return long.groupBy(model, cls).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"))
