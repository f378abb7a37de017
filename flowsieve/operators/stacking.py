"""Cross-validated training and a stacking classifier as an Estimator with its Model.

Folds are stored, each in files of its own, so every fit reads the same rows and no others; the fits of folds and learners run side by side, each a Spark job of
its own. Out-of-fold answers are a table. Models score rows they never saw, in batches and in streams: scoring is a chain of
``transform`` calls over the same rows, without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.operators.metrics import basic_metrics
from flowsieve.operators.sampling import fold_numbers, fold_summary
from flowsieve.session import materialize

ANSWER = "_answer"  # array column of the scores of one learner, "<name>" added


def is_binary(learner: Estimator) -> bool:
    """Learners that know two classes only."""
    return type(learner).__name__ in ("LinearSVC", "GBTClassifier")


def class_count(df: DataFrame, label: str) -> int:
    """Classes are 0 .. n - 1; at least two."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    if high is None:
        raise ValueError("no labelled row")
    if low < 0:
        raise ValueError(f"labels start at 0, not {low}")
    return max(int(high) + 1, 2)


def fit_learner(learner: Estimator, df: DataFrame, features: str, label: str, classes: int) -> list[Model]:
    """One model, or one per class (that class against the others) for a binary learner on more than two classes."""
    ready = learner.copy()
    ready._set(featuresCol=features, labelCol="_y")
    targets = range(classes) if classes > 2 and is_binary(learner) else [None]
    y = F.col(label).cast("double")
    return [ready.fit(df.withColumn("_y", y if c is None else (y == c).cast("double"))) for c in targets]


def answers(models: Sequence[Model], df: DataFrame, features: str, classes: int, out: str) -> DataFrame:
    """Adds ``out``: the scores of the classes as an array. Probabilities; margins for learners without any (two classes: of 1)."""
    parts = []
    for k, m in enumerate(models):
        m = m.copy()
        names = {"featuresCol": features, "predictionCol": f"_p{k}", "rawPredictionCol": f"_r{k}"}
        sure = m.hasParam("probabilityCol")
        m._set(**names, **({"probabilityCol": f"_q{k}"} if sure else {}))
        df = m.transform(df)
        parts.append((vector_to_array(f"_q{k}" if sure else f"_r{k}"), sure))
    if len(models) > 1:
        scores = [F.get(x, F.lit(1)) for x, _ in parts]
    elif parts[0][1]:  # a class that the training rows lacked has no place in the vector
        scores = [F.coalesce(F.get(parts[0][0], F.lit(c)), F.lit(0.0)) for c in range(classes)]
    else:
        scores = [F.get(parts[0][0], F.lit(1))]
    return df.withColumn(out, F.array(*scores)).drop(*[f"_{c}{k}" for k in range(len(models)) for c in "prq"])


def best_class(scores: Column) -> Column:
    """The first class of the highest score; a single margin is that of class 1."""
    top = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.when(F.size(scores) == 1, (F.get(scores, F.lit(0)) > 0).cast("int")).otherwise(top)


def out_of_fold(
    df: DataFrame, learners: Mapping[str, Estimator], features: str, label: str, fold: str, folds: int, classes: int, parallelism: int = 4,
) -> DataFrame:
    """``df`` with ``_answer<name>`` of each learner, each row scored by models of the other folds. ``df`` is read once per fit,
    so give a stored table."""
    tasks = [(f, name) for f in range(folds) for name in learners]

    def fit(task: tuple[int, str]) -> list[Model]:
        f, name = task
        return fit_learner(learners[name], df.where(F.col(fold) != f), features, label, classes)

    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        fitted = dict(zip(tasks, pool.map(fit, tasks, chunksize=1)))
    parts = []
    for f in range(folds):
        held = df.where(F.col(fold) == f)
        for name in learners:
            held = answers(fitted[f, name], held, features, classes, ANSWER + name)
        parts.append(held)
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(
    df: DataFrame, learners: Mapping[str, Estimator], key: str, label: str, features: str = "features", folds: int = 5, parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(answers, metrics) of stratified cross-validation.

    answers: (key, label, fold, model, scores, pred), each row scored by the models that did not see it.
    metrics: (model, metric, mean, std) of the folds' accuracy and macro precision, recall and F1; population deviation.
    Rows without a label are left out. Folds follow a digest of the key, so a retry draws the same.
    """
    data = df.where(F.col(label).isNotNull()).select(key, label, features)
    data = materialize(fold_numbers(data, key, folds, label), "folds", "fold")
    classes = class_count(data, label)
    scored = out_of_fold(data, learners, features, label, "fold", folds, classes, parallelism)
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.col(ANSWER + n).alias("scores")) for n in learners])
    long = scored.select(key, label, "fold", F.explode(each).alias("_e")).select(key, label, "fold", "_e.*")
    table = materialize(long.withColumn("pred", best_class(F.col("scores"))), "out-of-fold")
    names = {"accuracy": "accuracy", "precision_macro": "precision", "recall_macro": "recall", "f1_macro": "f1"}
    per = basic_metrics(table.withColumn("_y", F.col(label).cast("int")), "_y", "pred", ["model", "fold"])
    per = per.select("model", *[F.col(a).alias(b) for a, b in names.items()])
    parts = [fold_summary(per.where(F.col("model") == n), list(names.values())).withColumn("model", F.lit(n)) for n in learners]
    return table, reduce(lambda a, b: a.unionByName(b), parts).select("model", "metric", "mean", "std")


# -- stacking ----------------------------------------------------------------------------------------

class _Stack:
    """What the estimator and its model share: names of columns and learners."""

    def _describe(self) -> dict:
        return {k: getattr(self, k) for k in self._kept}


class StackingClassifier(Estimator, MLWritable, MLReadable, _Stack):
    """Base learners answer out of fold, a meta learner (logistic unless given) learns from their answers, the base learners are fitted
    again on all rows.

    ``learners`` maps names to MLlib classifiers; binary ones are fitted per class where there are more than two. The input has
    a ``features`` vector, a ``key`` and labels 0 .. n - 1; rows without a label are left out, more columns do not matter.
    """

    _kept = ("names", "key", "label", "features", "folds", "parallelism")

    def __init__(
        self, learners: Mapping[str, Estimator], key: str, label: str = "label", features: str = "features", folds: int = 5,
        parallelism: int = 4, meta: Estimator | None = None,
    ):
        super().__init__()
        if folds < 2 or not learners:
            raise ValueError("at least two folds and one learner are needed")
        self.learners, self.names = dict(learners), list(learners)
        self.key, self.label, self.features, self.folds, self.parallelism = key, label, features, folds, parallelism
        self.meta = meta or LogisticRegression(regParam=1e-3)

    def _fit(self, dataset: DataFrame) -> StackingModel:
        data = dataset.where(F.col(self.label).isNotNull()).select(self.key, self.label, self.features)
        data = materialize(fold_numbers(data, self.key, self.folds, self.label), "stack-folds", "fold")
        classes = class_count(data, self.label)
        level = out_of_fold(data, self.learners, self.features, self.label, "fold", self.folds, classes, self.parallelism)
        level = materialize(level.select(self.label, meta_features(self.names, classes).alias("_meta")), "stack-level")
        meta = fit_learner(self.meta, level, "_meta", self.label, classes)
        with ThreadPool(max(1, min(self.parallelism, len(self.names)))) as pool:
            bases = pool.map(lambda n: fit_learner(self.learners[n], data, self.features, self.label, classes), self.names, chunksize=1)
        return StackingModel(dict(zip(self.names, bases)), meta, classes, self.features)

    def write(self) -> MLWriter:
        return _Writer(self, {f"learner-{i}": self.learners[n] for i, n in enumerate(self.names)} | {"meta": self.meta})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def _from_parts(cls, said: dict, load) -> StackingClassifier:
        learners = {n: load(f"learner-{i}") for i, n in enumerate(said["names"])}
        return cls(learners, meta=load("meta"), **{k: said[k] for k in cls._kept if k != "names"})


def meta_features(names: Sequence[str], classes: int) -> Column:
    """The answers of all learners as one vector. Probabilities of all classes sum to 1, so that of class 0 is left out."""
    tails = [F.when(F.size(ANSWER + n) == classes, F.slice(ANSWER + n, 2, classes - 1)).otherwise(F.col(ANSWER + n)) for n in names]
    return array_to_vector(F.concat(*tails))


class StackingModel(Model, MLWritable, MLReadable, _Stack):
    """Adds ``probability`` (array by class) and ``prediction`` (int) to rows with a ``features`` vector."""

    _kept = ("names", "sizes", "meta_size", "classes", "features")

    def __init__(self, bases: Mapping[str, Sequence[Model]], meta: Sequence[Model], classes: int, features: str = "features"):
        super().__init__()
        self.bases, self.meta, self.classes, self.features = {n: list(m) for n, m in bases.items()}, list(meta), classes, features
        self.names, self.sizes, self.meta_size = list(self.bases), [len(m) for m in self.bases.values()], len(self.meta)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for n in self.names:
            out = answers(self.bases[n], out, self.features, self.classes, ANSWER + n)
        out = answers(self.meta, out.withColumn("_meta", meta_features(self.names, self.classes)), "_meta", self.classes, "probability")
        return out.withColumn("prediction", best_class(F.col("probability"))).drop("_meta", *[ANSWER + n for n in self.names])

    def write(self) -> MLWriter:
        parts = {f"base-{i}-{j}": m for i, n in enumerate(self.names) for j, m in enumerate(self.bases[n])}
        return _Writer(self, parts | {f"meta-{j}": m for j, m in enumerate(self.meta)})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def _from_parts(cls, said: dict, load) -> StackingModel:
        bases = {n: [load(f"base-{i}-{j}") for j in range(size)] for i, (n, size) in enumerate(zip(said["names"], said["sizes"]))}
        return cls(bases, [load(f"meta-{j}") for j in range(said["meta_size"])], said["classes"], said["features"])


class _Writer(MLWriter):
    def __init__(self, instance, parts: Mapping[str, MLWritable]):
        super().__init__()
        self.instance, self.parts = instance, parts

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"stack": self.instance._describe()})
        for name, part in self.parts.items():
            part.write().save(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        said = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls._from_parts(said["stack"], lambda name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", self.sparkSession))
        out._resetUid(said["uid"])
        return out
