"""Detection metrics. Rows collapse to counts first; every metric is an expression over those counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.functions.columns import EPS, equal_width_bin, safe_divide
from flowsieve.operators.ordering import attach_row, column_quantiles, match_keys, running_totals

# KPI targets and the weight of each KPI in the overall score.
KPI_TARGETS = {
    "detection_rate": 0.95, "false_positive_rate": 0.02, "f1_score": 0.90, "adversarial_detection_rate": 0.90,
    "cross_dataset_f1": 0.85, "average_latency_ms": 100.0, "throughput_fps": 1000.0,
}
KPI_WEIGHTS = {
    "detection_rate": 0.25, "false_positive_rate": 0.20, "adversarial_detection_rate": 0.20,
    "cross_dataset_f1": 0.15, "f1_score": 0.10, "latency_performance": 0.10,
}


def contingency(df: DataFrame, true: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(by..., true, pred, n): at most one row per pair of classes."""
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: tp, fp, fn, tn, precision, recall, f1, support (0 where undefined)."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("true").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    per = (
        cells.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*").groupBy(*by, "cls")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )
    everything = F.sum("support").over(Window.partitionBy(*by))  # over one row per class
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return per.select(
        *by, "cls", "support", "tp", (predicted - tp).alias("fp"), (support - tp).alias("fn"),
        (everything - predicted - support + tp).alias("tn"),
        safe_divide(tp, predicted).alias("precision"), safe_divide(tp, support).alias("recall"),
        safe_divide(2 * tp, predicted + support).alias("f1"),
    )


def basic_metrics(df: DataFrame, true: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy with macro and weighted precision, recall and F1."""
    rep = class_report(contingency(df, true, pred, by), by)
    s = F.sum("support")
    return rep.groupBy(*by).agg(
        (F.sum("tp") / s).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / s).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )


def binary_counts(df: DataFrame, true: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(true) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
    )


def mcc_of(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    return safe_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def rate_columns() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return {
        "tpr": safe_divide(tp, tp + fn), "tnr": safe_divide(tn, tn + fp),
        "fpr": safe_divide(fp, fp + tn), "fnr": safe_divide(fn, fn + tp),
    }


def confusion_rates(df: DataFrame, true: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    counts = binary_counts(df, true, pred, by)
    return counts.select("*", *[c.alias(n) for n, c in rate_columns().items()])


def confusion_shares(df: DataFrame, true: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion cells with the share of their true class."""
    cells = contingency(df, true, pred)
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))  # one row per class pair


def ids_metrics(df: DataFrame, true: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    counts = binary_counts(df, true, pred, by)
    r = rate_columns()
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        *by, r["tpr"].alias("detection_rate"), r["fpr"].alias("false_alarm_rate"), r["fnr"].alias("miss_rate"),
        safe_divide(tp, tp + fp).alias("attack_precision"), r["tnr"].alias("specificity"),
        mcc_of(tp, tn, fp, fn).alias("mcc"), F.sqrt(r["tpr"] * r["tnr"]).alias("g_mean"),
    )


def class_rates(df: DataFrame, true: str = "y", pred: str = "pred") -> DataFrame:
    rep = class_report(contingency(df, true, pred))
    return rep.select(
        "cls", "tp", "fp", "fn", "tn", F.col("recall").alias("detection_rate"),
        safe_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"),
    )


def score_curve(df: DataFrame, true: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, from the highest: counts at ``score >= threshold``.

    Rows collapse to distinct scores; the running sums over them are two-level.
    """
    counts = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(true) == 1).alias("pos"), F.count_if(F.col(true) != 1).alias("neg")
    )
    cum = running_totals(counts, by, "threshold", ["pos", "neg"], descending=True)
    return cum.withColumns({
        "tp": F.col("cum_pos"), "fp": F.col("cum_neg"),
        "fn": F.col("all_pos") - F.col("cum_pos"), "tn": F.col("all_neg") - F.col("cum_neg"),
    })


def roc_curve(df: DataFrame, true: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Threshold, fpr and tpr, one point per distinct score; the origin has threshold +inf."""
    c = score_curve(df, true, score, by)
    r = rate_columns()
    points = c.select(*by, "threshold", r["fpr"].alias("fpr"), r["tpr"].alias("tpr"))
    zero = F.lit(0.0)
    origin = c.select(*by).distinct() if by else df.sparkSession.range(1)
    return points.unionByName(origin.select(*by, F.lit(float("inf")).alias("threshold"), zero.alias("fpr"), zero.alias("tpr")))


def pr_curve(df: DataFrame, true: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    c = score_curve(df, true, score, by)
    return c.select(
        *by, "threshold", safe_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_divide(F.col("tp"), F.col("all_pos")).alias("recall"),
    )


def auc_scores(df: DataFrame, true: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties half) and average precision, 0 where one class is absent."""
    c = score_curve(df, true, score, by)
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    step = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return c.groupBy(*by).agg(
        safe_divide(area, pairs).alias("auc"), safe_divide(step, F.max("all_pos")).alias("average_precision")
    )


def one_vs_rest_scores(df: DataFrame, true: str = "y", proba: str = "proba") -> DataFrame:
    """Long form (cls, p, hit) of class probabilities."""
    return df.select(F.col(true), F.posexplode(proba).alias("cls", "p")).select(
        "cls", "p", (F.col("cls") == F.col(true)).cast("int").alias("hit")
    )


def multiclass_auc(df: DataFrame, true: str = "y", proba: str = "proba") -> DataFrame:
    """One-vs-rest AUC: macro mean and mean weighted by class size."""
    long = one_vs_rest_scores(df, true, proba)
    c = score_curve(long, "hit", "p", ["cls"])
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    per = c.groupBy("cls").agg(safe_divide(area, pairs).alias("auc"), F.max("all_pos").alias("support"))
    return per.agg(
        F.avg("auc").alias("auc_macro"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_weighted"),
        F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
    )


def robustness_metrics(df: DataFrame, true: str, clean: str, attacked: str, by: Sequence[str] = ()) -> DataFrame:
    ok, adv_ok = F.col(true) == F.col(clean), F.col(true) == F.col(attacked)
    rows = df.groupBy(*by).agg(
        F.avg(ok.cast("int")).alias("clean_accuracy"), F.avg(adv_ok.cast("int")).alias("adversarial_accuracy"),
        F.count_if(ok).alias("_ok"), F.count_if(ok & ~adv_ok).alias("_lost"),
    )
    clean_acc, adv_acc = F.col("clean_accuracy"), F.col("adversarial_accuracy")
    return rows.select(
        *by, "clean_accuracy", "adversarial_accuracy", safe_divide(adv_acc, clean_acc).alias("robustness_score"),
        safe_divide(F.col("_lost"), F.col("_ok")).alias("attack_success_rate"), (clean_acc - adv_acc).alias("robustness_gap"),
    )


def generalisation(df: DataFrame, dataset: str, source: str, target: str, true: str = "y", pred: str = "pred") -> DataFrame:
    """How a model carries over from one dataset to another."""
    m = basic_metrics(df, true, pred, [dataset])

    def of(name: str, metric: str) -> Column:
        return F.max(F.when(F.col(dataset) == name, F.col(metric)))

    row = m.agg(
        of(source, "accuracy").alias("source_accuracy"), of(target, "accuracy").alias("target_accuracy"),
        of(source, "f1_macro").alias("_sf"), of(target, "f1_macro").alias("_tf"),
        F.avg("f1_macro").alias("cross_dataset_f1"), F.var_pop("f1_macro").alias("dataset_variance"),
        F.stddev_pop("f1_macro").alias("_sd"),
    )
    s, t = F.col("source_accuracy"), F.col("target_accuracy")
    return row.select(
        "source_accuracy", "target_accuracy", (s - t).alias("accuracy_drop"), (F.col("_sf") - F.col("_tf")).alias("f1_drop"),
        safe_divide(t, s).alias("generalisation_ratio"), safe_divide(s - F.abs(s - t), s).alias("consistency"),
        "cross_dataset_f1", (F.lit(1.0) / (1.0 + F.col("_sd") / (F.col("cross_dataset_f1") + EPS))).alias("cv_score"),
        "dataset_variance",
    )


def latency_summary(df: DataFrame, seconds: str) -> DataFrame:
    """Latency in milliseconds."""
    q = column_quantiles(df, [seconds], [0.5, 0.95, 0.99])
    row = df.agg(F.avg(seconds).alias("m"), F.max(seconds).alias("hi"), F.min(seconds).alias("lo"))
    out = attach_row(row, q)
    ms = {"avg": F.col("m"), "median": F.col(f"_s.{seconds}_p50"), "p95": F.col(f"_s.{seconds}_p95"),
          "p99": F.col(f"_s.{seconds}_p99"), "max": F.col("hi"), "min": F.col("lo")}
    return out.select(*[(c * 1000).alias(f"{n}_latency_ms") for n, c in ms.items()])


def throughput_summary(df: DataFrame, samples: str, seconds: str) -> DataFrame:
    r = df.select(safe_divide(F.col(samples), F.col(seconds)).alias("rate"))
    q = column_quantiles(r, ["rate"], [0.5])
    row = r.agg(F.avg("rate").alias("avg_throughput"), F.max("rate").alias("max_throughput"), F.min("rate").alias("min_throughput"))
    return attach_row(row, q).select("*", F.col("_s.rate_p50").alias("median_throughput")).drop("_s")


def kpi_core(df: DataFrame, true: str = "y", pred: str = "pred", proba: str = "proba", by: Sequence[str] = ()) -> DataFrame:
    """Weighted precision, recall, F1, detection and false-positive rate (class 0 is benign), AUC on 1 - p(0), multiclass MCC."""
    cells = contingency(df, true, pred, by)
    rep = class_report(cells, by)
    s = F.sum("support").cast("double")
    row = F.col("support").cast("double")
    col_ = (F.col("tp") + F.col("fp")).cast("double")
    weighted = rep.groupBy(*by).agg(
        (F.sum("tp") / s).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / s).alias(n) for m, n in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))],
        safe_divide(
            F.sum("tp").cast("double") * s - F.sum(row * col_),
            F.sqrt(s * s - F.sum(col_ * col_)) * F.sqrt(s * s - F.sum(row * row)),
        ).alias("mcc"),
    )
    n = F.col("n")
    benign, flagged = F.col("true") == 0, F.col("pred") != 0

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(F.lit(0)))

    rates = cells.groupBy(*by).agg(
        safe_divide(total(~benign & flagged), total(~benign)).alias("detection_rate"),
        safe_divide(total(benign & flagged), total(benign)).alias("false_positive_rate"),
    )
    scored = df.select(*by, (F.col(true) != 0).cast("int").alias("hit"), (F.lit(1.0) - F.element_at(proba, 1)).alias("p"))
    auc = auc_scores(scored, "hit", "p", by).select(*by, F.col("auc").alias("auc_roc"))
    if by:
        return match_keys(match_keys(weighted, rates, list(by)), auc, list(by))
    return attach_row(attach_row(weighted, rates, "_r"), auc, "_a").select("*", "_r.*", "_a.*").drop("_r", "_a")


def kpi_score(metrics: DataFrame) -> DataFrame:
    """Overall score and compliance flags of a one-row (or row-per-run) metrics table."""
    t, w = KPI_TARGETS, KPI_WEIGHTS

    def up(name: str) -> Column:
        return F.least(F.col(name) / t[name], F.lit(1.0))

    def down(name: str, slope: float) -> Column:
        over = F.col(name) - t[name]
        return F.when(over <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - over / slope))

    parts = {
        "detection_rate": up("detection_rate"), "false_positive_rate": down("false_positive_rate", 0.1),
        "adversarial_detection_rate": up("adversarial_detection_rate"), "cross_dataset_f1": up("cross_dataset_f1"),
        "f1_score": up("f1_score"), "latency_performance": down("average_latency_ms", 100.0),
    }
    score = None
    for name, part in parts.items():
        score = part * w[name] if score is None else score + part * w[name]
    lower = ("false_positive_rate", "average_latency_ms")
    flags = {
        k: (F.col(k) <= v) if k in lower else (F.col(k) >= v) for k, v in t.items() if k != "throughput_fps"
    }
    overall = None
    for f in flags.values():
        overall = f if overall is None else overall & f
    return metrics.select(
        "*", score.alias("overall_score"), *[f.alias(f"ok_{k}") for k, f in flags.items()], overall.alias("ok_overall")
    )


def split_distribution(df: DataFrame, split: str, label: str, splits: Sequence[str]) -> DataFrame:
    """Class counts per split, side by side."""
    return df.groupBy(label).agg(*[F.count_if(F.col(split) == s).alias(str(s)) for s in splits])


def melt_metrics(runs: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    return runs.unpivot([run], list(metrics), "metric", "value")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram; the maximum falls in the last bin and empty bins are kept."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    inside = attach_row(df.select(F.col(column).alias("x")).where(F.col("x").isNotNull()), r)
    counts = inside.groupBy(equal_width_bin(F.col("x"), F.col("_s.lo"), F.col("_s.hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = attach_row(df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")), r)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("_s.lo") + width * (F.col("bin") - 1)).alias("low"), F.coalesce("n", F.lit(0)).alias("n")
    )
