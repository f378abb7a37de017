"""Out-of-fold answers, fold metrics, and a stack that scores rows it never saw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsieve.operators import stacking as sk
from flowsieve.session import scratch_path


def rows(n, classes, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    score = x[:, 0] + (x[:, 1] > 0) * 1.5 + r.normal(size=n) * 0.3
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": np.digitize(score, np.quantile(score, np.arange(1, classes) / classes))})


@pytest.fixture(scope="module")
def vectors():
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")


def log_loss(df, p):
    truth = F.get(F.col(p), F.col("y").cast("int"))
    return df.agg(F.avg(-F.log(F.greatest(truth, F.lit(1e-12))))).first()[0]


def test_stack_of_two_classes(spark, vectors, tmp_path):
    data = vectors.transform(spark.createDataFrame(rows(900, 2)).repartition(2))
    train, held = data.where("id < 600"), data.where("id >= 600").withColumn("extra", F.lit("kept"))
    learners = {"lr": LogisticRegression(maxIter=10), "dt": DecisionTreeClassifier(maxDepth=2, seed=1), "svc": LinearSVC(maxIter=5)}
    estimator = sk.StackingClassifier(learners, "id", "y", folds=3)
    model = estimator.fit(train.unionByName(train.limit(1).withColumn("y", F.lit(None).cast("long"))))
    out = model.transform(held)
    assert set(out.columns) == {*held.columns, "probability", "prediction"} and out.count() == 300
    worst = max(log_loss(sk.answers(model.bases[n], held, "features", 2, "p"), "p") for n in ("lr", "dt"))
    assert log_loss(out, "probability") < worst
    assert out.where("prediction = y").count() > 240
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    again = sk.StackingModel.load(path)
    got = again.transform(held).orderBy("id").select("prediction", F.get("probability", F.lit(1)).alias("p")).collect()
    want = out.orderBy("id").select("prediction", F.get("probability", F.lit(1)).alias("p")).collect()
    assert [r["prediction"] for r in got] == [r["prediction"] for r in want] and np.allclose([r["p"] for r in got], [r["p"] for r in want])
    estimator.save(str(tmp_path / "estimator"))
    same = sk.StackingClassifier.load(str(tmp_path / "estimator"))
    assert same.names == estimator.names and same.folds == 3 and same.learners["dt"].getMaxDepth() == 2 and same.uid == estimator.uid

    source = scratch_path(spark, "stack-rows")
    held.write.parquet(source)
    stream = again.transform(spark.readStream.schema(held.schema).parquet(source))
    query = stream.writeStream.format("memory").queryName("stacked").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {r["id"]: r["prediction"] for r in spark.table("stacked").collect()}
    assert streamed == {r["id"]: r["prediction"] for r in out.collect()}


def test_binary_learners_on_three_classes(spark, vectors):
    data = vectors.transform(spark.createDataFrame(rows(360, 3)).coalesce(1))
    learners = {"svc": LinearSVC(maxIter=3), "gbt": GBTClassifier(maxIter=1, maxDepth=2, seed=1)}
    model = sk.StackingClassifier(learners, "id", "y", folds=2).fit(data.where("id < 240"))
    assert model.sizes == [3, 3] and model.classes == 3
    out = model.transform(data.where("id >= 240"))
    assert out.where("prediction = y").count() > 72 and out.first()["probability"].__len__() == 3


def test_cross_validation_scores_each_row_once(spark, vectors):
    table = rows(200, 2)
    data = vectors.transform(spark.createDataFrame(table).coalesce(1))
    answers, metrics = sk.cross_validate(data, {"lr": LogisticRegression(maxIter=5)}, "id", "y", folds=4)
    got = answers.toPandas()
    assert sorted(got["id"]) == list(range(200)) and got.groupby("fold").size().between(49, 51).all()
    per = got.assign(hit=got["y"] == got["pred"]).groupby("fold")["hit"].mean()
    said = {r["metric"]: (r["mean"], r["std"]) for r in metrics.collect()}
    assert said["accuracy"] == pytest.approx((per.mean(), per.std(ddof=0))) and set(said) == {"accuracy", "precision", "recall", "f1"}
    # an answer does not depend on the row's own label
    f = int(got["fold"].iloc[0])
    others = data.join(answers.where(F.col("fold") != f).select("id"), "id")
    models = sk.fit_learner(LogisticRegression(maxIter=5), others, "features", "y", 2)
    alone = sk.answers(models, data.join(answers.where(F.col("fold") == f).select("id"), "id"), "features", 2, "s").orderBy("id").toPandas()
    mine = got[got["fold"] == f].sort_values("id")
    assert np.allclose([s[1] for s in alone["s"]], [s[1] for s in mine["scores"]], atol=1e-6)


def test_odd_input(spark, vectors):
    data = vectors.transform(spark.createDataFrame(rows(20, 2)))
    with pytest.raises(ValueError):
        sk.class_count(data.where("id < 0"), "y")
    with pytest.raises(ValueError):
        sk.class_count(data.withColumn("y", F.lit(-1)), "y")
    with pytest.raises(ValueError):
        sk.StackingClassifier({}, "id")


def test_two_stage_computes_its_split_once(spark):
    """The split is a stored table: the fits and the scoring read it and do not compute it again (F1)."""
    from pyspark.sql import functions as F

    from flowsieve.operators import models as mo

    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("e"))
    rows = rows.withColumn("c", (F.col("a") > 8).cast("int"))
    out = mo.two_stage(rows, ["a"], "k", "e", "c", trees=2, depth=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() and "two-stage" in plan and "Join" not in plan and "Range (" not in plan
