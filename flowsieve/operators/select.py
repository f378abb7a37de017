"""Feature selection. Statistics are aggregates in long form (feature, score); only the scores leave the cluster."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from flowsieve.functions.columns import equal_width_bin, safe_divide
from flowsieve.operators.gram import cross_validated_lasso, fit_components, gram_matrix
from flowsieve.operators.ordering import attach_row, match_keys, melt, training_rows

# Variance below which a feature is dropped, correlation above which it is.
MIN_VARIANCE, MAX_CORRELATION = 0.01, 0.95


def variance_scores(df: DataFrame, columns: Sequence[str], minimum: float = MIN_VARIANCE) -> DataFrame:
    """(feature, score, selected): population variance above ``minimum``."""
    wide = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "score").withColumn("selected", F.col("score") > minimum)


def anova_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of each feature over the label classes, from per-class counts, means and variances."""
    cells = melt(df, [label], columns)
    per = cells.groupBy("feature", label).agg(
        F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    w = Window.partitionBy("feature")  # over one row per class
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    n, k = F.sum("n"), F.count(F.lit(1))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))) / (k - 1)
    within = F.sum(F.col("n") * F.col("v")) / (n - k)
    return per.groupBy("feature").agg(safe_divide(between, within).alias("score"))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats between each feature in equal-width bins and the label."""
    limits = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    out = attach_row(df, limits)
    binned = out.select(label, *[
        equal_width_bin(F.col(c), F.col(f"_s.lo_{c}"), F.col(f"_s.hi_{c}"), bins).alias(c) for c in columns
    ]).unpivot([label], list(columns), "feature", "bin")
    cells = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    wx, wy, wa = (Window.partitionBy("feature", *k) for k in (["bin"], [label], []))  # over bins x classes rows
    cells = cells.select(
        "feature", "n", F.sum("n").over(wx).alias("x"), F.sum("n").over(wy).alias("y"), F.sum("n").over(wa).alias("a")
    )
    return cells.groupBy("feature").agg(
        F.sum(F.col("n") / F.col("a") * F.log(F.col("n") * F.col("a") / (F.col("x") * F.col("y")))).alias("score")
    )


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(first, second, corr) for every pair of columns, first before second."""
    return gram_matrix(df, columns).where(F.col("first") != F.col("second")).select("first", "second", "corr")


def correlation_pruning(df: DataFrame, columns: Sequence[str], limit: float = MAX_CORRELATION) -> DataFrame:
    """(feature, score, selected): highest |corr| with an earlier column; dropped above ``limit``."""
    worst = correlation_pairs(df, columns).groupBy(F.col("second").alias("feature")).agg(F.max(F.abs("corr")).alias("score"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(worst, "feature", "left").select(
        "feature", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) <= limit).alias("selected")
    )


def vote(tables: Sequence[DataFrame], share: float = 0.5, limit: int | None = None) -> DataFrame:
    """Features chosen by at least ``share`` of the methods; every table has (feature, selected)."""
    both = reduce(lambda a, b: a.unionByName(b), [t.select("feature", "selected") for t in tables])
    votes = both.groupBy("feature").agg(F.sum(F.col("selected").cast("int")).alias("votes"))
    kept = votes.where(F.col("votes") / F.lit(float(len(tables))) >= share)
    return kept.orderBy(F.desc("votes"), "feature").limit(limit) if limit else kept


def mark_top(scores: DataFrame, k: int) -> DataFrame:
    """Scores with ``selected`` for the k highest (one row per feature)."""
    w = Window.orderBy(F.desc("score"), "feature")  # over one row per feature
    return scores.withColumn("selected", F.row_number().over(w) <= k)


def assemble(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    made = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    return made.select("features", F.col(label).cast("double").alias("label"))


def _importances(df: DataFrame, columns: Sequence[str], label: str, model: str, trees: int, depth: int, seed: int) -> list[tuple[str, float]]:
    cls = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed) if model == "rf" else GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
    stored = training_rows(df.select(*dict.fromkeys([*columns, label])))
    fitted = cls.fit(assemble(stored, columns, label))
    return list(zip(columns, [float(x) for x in fitted.featureImportances.toArray()]))


def tree_importance(
    df: DataFrame, columns: Sequence[str], label: str, model: str = "rf", keep: str | float = "median",
    max_features: int | None = None, trees: int = 20, depth: int = 5, seed: int = 42,
) -> DataFrame:
    """(feature, score, selected) from a forest or boosted trees; kept at or above the
    median, the mean or a value."""
    scores = _importances(df, columns, label, model, trees, depth, seed)
    values = sorted(s for _, s in scores)
    mid = len(values) // 2
    median = values[mid] if len(values) % 2 else (values[mid - 1] + values[mid]) / 2
    limit = {"median": median, "mean": sum(values) / len(values)}.get(keep, keep)
    ranked = sorted(scores, key=lambda s: (-s[1], s[0]))
    chosen = {c for c, s in ranked if s >= limit}
    if max_features:
        chosen &= {c for c, _ in ranked[:max_features]}
    return df.sparkSession.createDataFrame([(c, s, c in chosen) for c, s in scores], "feature string, score double, selected boolean")


def recursive_elimination(
    df: DataFrame, columns: Sequence[str], label: str, n: int, step: int = 1, trees: int = 10, depth: int = 5, seed: int = 42
) -> DataFrame:
    """(feature, rank, selected): refit a forest and drop the ``step`` weakest until ``n`` are left."""
    left, dropped = list(columns), []
    while len(left) > n:
        scores = sorted(_importances(df, left, label, "rf", trees, depth, seed), key=lambda s: (s[1], s[0]))
        out = [c for c, _ in scores[: min(step, len(left) - n)]]
        dropped.append(out)
        left = [c for c in left if c not in out]
    rows = [(c, 1, True) for c in left]
    for i, group in enumerate(reversed(dropped)):
        rows += [(c, i + 2, False) for c in group]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean")


def lasso_selection(
    df: DataFrame, columns: Sequence[str], label: str, key: str, alphas: Sequence[float] | None = None, folds: int = 5, fallback: int = 10,
) -> DataFrame:
    """(feature, score, selected): |coefficient| of an L1 model with the penalty chosen by cross-validation, or the ``fallback``
    largest where it keeps none. One pass over the table (see ``gram``)."""
    scores = [(r["feature"], r["score"]) for r in cross_validated_lasso(df, columns, label, key, alphas, folds)[0].collect()]
    chosen = {c for c, s in scores if s > 0} or {c for c, _ in sorted(scores, key=lambda s: -s[1])[:fallback]}
    return df.sparkSession.createDataFrame([(c, s, c in chosen) for c, s in scores], "feature string, score double, selected boolean")


def pca_components(df: DataFrame, columns: Sequence[str], key: str, k: int = 32) -> DataFrame:
    """(key, components): standardised features projected on min(k, n) principal components; rows with a missing value are left out."""
    fitted = fit_components(df, columns, k)
    made = fitted.project(df.select(key, *columns).dropna(subset=list(columns)), "_pc")
    return made.select(key, F.array(*[F.col(f"_pc{i}") for i in range(len(fitted.loadings))]).alias("components"))
