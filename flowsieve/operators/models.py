"""Classifiers trained and applied with MLlib."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, functions as F

from flowsieve.functions.columns import total
from flowsieve.operators.clean import coerce_numeric, drop_rare_classes
from flowsieve.operators.flows import class_weights
from flowsieve.operators.metrics import basic_metrics
from flowsieve.operators.ordering import join_class_stats, training_rows
from flowsieve.operators.sampling import stratified_sample, stratified_split
from flowsieve.session import materialize

SEED = 42


def with_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def with_weights(df: DataFrame, label: str, spread: Sequence[str], out: str = "weight") -> DataFrame:
    """Balanced class weight of each row."""
    w = class_weights(df, label).select(label, F.col("balanced").alias(out))
    return join_class_stats(df, w, [label], spread)


def classifier(kind: str, label: str = "label", weight: str | None = None, **params):
    """An MLlib classifier by short name: rf, gbt, lr, dt, svc."""
    makers = {
        "rf": lambda: RandomForestClassifier(seed=SEED, **params), "gbt": lambda: GBTClassifier(seed=SEED, **params),
        "lr": lambda: LogisticRegression(**params), "dt": lambda: DecisionTreeClassifier(seed=SEED, **params),
        "svc": lambda: LinearSVC(**params),
    }
    c = makers[kind]().setLabelCol(label)
    return c.setWeightCol(weight) if weight else c


def fit_model(df: DataFrame, columns: Sequence[str], label: str, kind: str = "rf", weight: str | None = None, standardize: bool = False, pca: int = 0, **params) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="keep")]
    features = "_raw"
    if standardize:
        stages.append(StandardScaler(inputCol=features, outputCol="_std", withMean=True, withStd=True))
        features = "_std"
    if pca:
        stages.append(PCA(k=min(pca, len(columns)), inputCol=features, outputCol="_pca"))
        features = "_pca"
    stages.append(classifier(kind, label, weight, **params).setFeaturesCol(features))
    held = dict.fromkeys([*columns, label, *([weight] if weight else [])])
    return Pipeline(stages=stages).fit(training_rows(df.select(*held)))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., pred, proba, confidence)."""
    out = model.transform(df)
    proba = vector_to_array("probability")
    return out.select(*keep, F.col("prediction").cast("int").alias("pred"), proba.alias("proba"), F.array_max(proba).alias("confidence"))


def importances(model: PipelineModel, columns: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(x)) for c, x in zip(columns, values)], "feature string, score double")


def soft_vote(train: DataFrame, df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str], kinds: Mapping[str, dict]) -> DataFrame:
    """Mean probability of several models, applied one after the other to the same rows (no join)."""
    out = with_features(df, columns)
    data = with_features(train, columns)
    names = []
    for kind, params in kinds.items():
        cls = classifier(kind, label, **params)
        cls = cls.setPredictionCol(f"_pred_{kind}").setProbabilityCol(f"_prob_{kind}").setRawPredictionCol(f"_raw_{kind}")
        out = cls.fit(data).transform(out)
        names.append(f"_prob_{kind}")
    p1 = total([vector_to_array(n)[1] for n in names]) / F.lit(float(len(names)))
    return out.select(*keep, p1.alias("p"), (p1 >= 0.5).cast("int").alias("pred"))


def calibrate(validation: DataFrame, df: DataFrame, score: str, label: str, out: str = "calibrated") -> DataFrame:
    """Sigmoid calibration of a score, fitted on a validation table."""
    model = LogisticRegression(labelCol=label, featuresCol="_f").fit(with_features(validation, [score], "_f"))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col(score) + F.lit(b)))))


def weighted_linear(df: DataFrame, columns: Sequence[str], label: str, spread: Sequence[str], **params) -> PipelineModel:
    """Logistic regression with balanced weights on the whole table, one pass per iteration."""
    return fit_model(with_weights(df, label, spread), columns, label, "lr", "weight", standardize=True, **params)


def train_and_evaluate(
    df: DataFrame, columns: Sequence[str], key: str, label: str, size: int = 20000, pca: int = 32, trees: int = 20,
) -> tuple[PipelineModel, DataFrame]:
    """Coerce, drop rare classes, split, train a forest on a sample of at most about ``size`` training rows (scaled, projected),
    and measure on all test rows. With a single class a linear model takes the forest's place."""
    data = drop_rare_classes(coerce_numeric(df, columns), label, [key])
    data = materialize(stratified_split(data, key, label), "split")
    train = materialize(stratified_sample(data.where(F.col("split") == "train"), key, label, size), "sample")
    classes = train.agg(F.count_distinct(label)).first()[0]
    if not classes:
        raise ValueError("no class has enough rows to train on")
    kind, params = ("rf", {"numTrees": trees}) if classes > 1 else ("lr", {})
    model = fit_model(train, columns, label, kind, standardize=True, pca=pca, **params)
    scored = predict(model, data.where(F.col("split") == "test"), [F.col(label).cast("int").alias("y")])
    return model, basic_metrics(scored)


def two_stage(df: DataFrame, columns: Sequence[str], key: str, encrypted: str, label: str, trees: int = 20, depth: int = 10) -> DataFrame:
    """First whether a flow is encrypted, then the class of the encrypted ones: (key, encrypted_pred, pred or NULL)."""
    held = list(dict.fromkeys([key, encrypted, label, *columns]))
    data = materialize(stratified_split(coerce_numeric(df.select(*held), columns), key, encrypted), "two-stage")  # every fit reads it several times
    train = data.where(F.col("split") == "train")
    first = fit_model(train, columns, encrypted, "lr", standardize=True)
    second = fit_model(train.where(F.col(encrypted) == 1), columns, label, "rf", standardize=True, numTrees=trees, maxDepth=depth)
    test = data.where(F.col("split") == "test")
    gate = first.transform(test).select(*test.columns, F.col("prediction").cast("int").alias("encrypted_pred"))
    deep = second.transform(gate).select(key, encrypted, label, "encrypted_pred", F.col("prediction").cast("int").alias("_p"))
    return deep.withColumn("pred", F.when(F.col("encrypted_pred") == 1, F.col("_p"))).drop("_p")


def one_vs_rest(df: DataFrame, columns: Sequence[str], label: str, kind: str = "svc", **params):
    """A binary learner for many classes."""
    return OneVsRest(classifier=classifier(kind, label, **params), labelCol=label).fit(with_features(df, columns))


def search(
    df: DataFrame, columns: Sequence[str], label: str, kind: str, grid: Mapping[str, Sequence], samples: int | None = None,
    train_share: float = 0.8, parallelism: int = 2,
) -> DataFrame:
    """(params, score, best) of a grid search, or of ``samples`` random picks of the grid, by validation AUC."""
    cls = classifier(kind, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(cls, name), list(values))
    maps = builder.build()
    if samples is not None and samples < len(maps):
        maps = random.Random(SEED).sample(maps, samples)
    tvs = TrainValidationSplit(estimator=cls, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), trainRatio=train_share, parallelism=parallelism, seed=SEED)
    scores = tvs.fit(with_features(df, columns)).validationMetrics
    top = max(scores)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(s), s == top) for m, s in zip(maps, scores)]
    return df.sparkSession.createDataFrame(rows, "params string, score double, best boolean")
