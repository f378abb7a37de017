"""Decision thresholds, read off score curves and cut-point sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.functions.columns import safe_divide
from flowsieve.operators.metrics import mcc_of, rate_columns, score_curve

# Targets and weights of the security objective.
TARGET_TPR, TARGET_FPR = 0.95, 0.02
TPR_WEIGHT, TNR_WEIGHT = 0.7, 0.3
CUTS = 100


def curve_metrics() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    r = rate_columns()
    return {
        "accuracy": safe_divide(tp + tn, tp + tn + fp + fn), "precision": safe_divide(tp, tp + fp), "recall": r["tpr"],
        "specificity": r["tnr"], "f1": safe_divide(2 * tp, 2 * tp + fp + fn), "fpr": r["fpr"], "fnr": r["fnr"],
        "mcc": mcc_of(tp, tn, fp, fn),
    }


def _curve(df: DataFrame, true: str, score: str) -> DataFrame:
    c = score_curve(df, true, score).select("threshold", "tp", "fp", "fn", "tn")
    return c.select("*", *[x.alias(n) for n, x in curve_metrics().items()])


def _best(curve: DataFrame, objective: str) -> DataFrame:
    """Row with the highest objective; the lowest threshold on ties."""
    picked = curve.agg(F.min(F.struct((-F.col(objective)).alias("_o"), *[F.col(c) for c in curve.columns])).alias("_b"))
    return picked.select(*[F.col(f"_b.{c}").alias(c) for c in curve.columns])


def best_f1(df: DataFrame, true: str = "y", score: str = "p") -> DataFrame:
    return _best(_curve(df, true, score), "f1")


def best_for_recall(df: DataFrame, target: float = TARGET_TPR, true: str = "y", score: str = "p") -> DataFrame:
    """Best precision among thresholds with recall >= target."""
    return _best(_curve(df, true, score).where(F.col("recall") >= target), "precision")


def best_for_precision(df: DataFrame, target: float = 0.95, true: str = "y", score: str = "p") -> DataFrame:
    """Best recall among thresholds with precision >= target."""
    return _best(_curve(df, true, score).where(F.col("precision") >= target), "recall")


def best_for_fpr(df: DataFrame, target: float = TARGET_FPR, true: str = "y", score: str = "p") -> DataFrame:
    """Best recall among thresholds with false-positive rate <= target."""
    return _best(_curve(df, true, score).where(F.col("fpr") <= target), "recall")


def cut_value(i: Column, cuts: int = CUTS) -> Column:
    return F.when(i == cuts, F.lit(1.0)).otherwise(i * F.lit(1.0 / cuts))


def threshold_sweep(df: DataFrame, true: str = "y", score: str = "p", cuts: int = CUTS) -> DataFrame:
    """Counts and metrics at the cut points 0, 1/cuts, ..., 1.

    Each row falls into the highest cut point it reaches; the table is read
    once and summed from the top, so rows are never repeated per threshold.
    """
    p = F.col(score)
    guess = F.least(F.greatest(F.floor(p * cuts), F.lit(0)), F.lit(cuts)).cast("int")
    up = F.when((guess < cuts) & (cut_value(guess + 1, cuts) <= p), guess + 1).otherwise(guess)
    reached = F.when(cut_value(up, cuts) > p, up - 1).otherwise(up)
    counts = df.groupBy(reached.cast("int").alias("i")).agg(
        F.count_if(F.col(true) == 1).alias("pos"), F.count_if(F.col(true) != 1).alias("neg")
    )
    spine = df.sparkSession.range(-1, cuts + 1).select(F.col("id").cast("int").alias("i"))
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    # both windows run over one row per cut point
    filled = spine.join(counts, "i", "left").fillna(0, subset=["pos", "neg"])
    summed = filled.select(
        "i", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"),
    ).where(F.col("i") >= 0)
    out = summed.select(
        cut_value(F.col("i"), cuts).alias("threshold"), "tp", "fp",
        (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"),
    )
    return out.select("*", *[x.alias(n) for n, x in curve_metrics().items()])


def security_score(target_tpr: float = TARGET_TPR, target_fpr: float = TARGET_FPR, penalty: bool = True) -> Column:
    s = TPR_WEIGHT * F.col("recall") + TNR_WEIGHT * F.col("specificity")
    if not penalty:
        return s
    half = lambda miss: F.when(miss, F.lit(0.5)).otherwise(F.lit(1.0))
    return s * half(F.col("recall") < target_tpr) * half(F.col("fpr") > target_fpr)


def sweep_with_score(df: DataFrame, objective: str | Column | Callable[[], Column] = "security", true: str = "y", score: str = "p") -> DataFrame:
    """Sweep table with ``score``. ``objective`` is a metric name, ``security``,
    ``security_plain`` or any Column over tp, fp, tn, fn."""
    if isinstance(objective, Column):
        value = objective
    elif callable(objective):
        value = objective()
    elif objective == "security":
        value = security_score()
    elif objective == "security_plain":
        value = security_score(penalty=False)
    else:
        value = F.col(objective)
    return threshold_sweep(df, true, score).withColumn("score", value)


def best_of_sweep(df: DataFrame, objective="security", true: str = "y", score: str = "p") -> DataFrame:
    """First threshold with the highest score; 0.5 when no score is above 0."""
    best = _best(sweep_with_score(df, objective, true, score), "score")
    return best.withColumn("threshold", F.when(F.col("score") > 0, F.col("threshold")).otherwise(F.lit(0.5)))


def metrics_at(df: DataFrame, threshold: float, true: str = "y", score: str = "p") -> DataFrame:
    hit, flagged = F.col(true) == 1, F.col(score) >= threshold
    counts = df.agg(
        F.count_if(hit & flagged).alias("tp"), F.count_if(~hit & flagged).alias("fp"),
        F.count_if(hit & ~flagged).alias("fn"), F.count_if(~hit & ~flagged).alias("tn"),
    )
    return counts.select(F.lit(float(threshold)).alias("threshold"), "*", *[x.alias(n) for n, x in curve_metrics().items()])


def apply_threshold(df: DataFrame, threshold: float, score: str = "p", out: str = "pred") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def find_threshold(df: DataFrame, objective: str = "security", target: float | None = None, true: str = "y", score: str = "p") -> DataFrame:
    """One row with the threshold that suits the named objective best."""
    if objective == "f1":
        return best_f1(df, true, score)
    if objective == "recall":
        return best_for_recall(df, TARGET_TPR if target is None else target, true, score)
    if objective == "precision":
        return best_for_precision(df, 0.95 if target is None else target, true, score)
    if objective == "fpr":
        return best_for_fpr(df, TARGET_FPR if target is None else target, true, score)
    if objective == "security":
        return best_of_sweep(df, "security", true, score)
    raise ValueError(f"unknown objective {objective}")
