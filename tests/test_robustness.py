"""Certified radii against the closed form of a linear scorer; weights of a fitted model."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import models as mo, robustness as ro

W, BIAS = [1.0, -2.0, 0.5], 0.2


def table(n):
    x = np.random.default_rng(2).uniform(size=(n, 3))
    return pd.DataFrame({"id": np.arange(n), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": (x @ W + BIAS > 0).astype(int)})


def test_binomial_bound():
    p = ro.share_bound(18, 20, 0.05)
    assert sum(math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(18, 21)) == pytest.approx(0.05, rel=1e-6)
    assert ro.share_bound(0, 20, 0.05) == 0.0 and ro.share_bound(20, 20, 0.05) == pytest.approx(0.05 ** (1 / 20))


def test_radius_stays_below_the_distance_to_the_border(spark):
    df = spark.createDataFrame(table(1500)).withColumn("x1", F.when(F.col("id") != 3, F.col("x1")))
    got = ro.certified_radius(df, "id", ["x1", "x2", "x3"], W, BIAS, 0.2, 300, 0.001).toPandas().set_index("id")
    assert set(got.columns) == {"x1", "x2", "x3", "y", "votes", "smoothed_pred", "radius"}
    assert math.isnan(got.loc[3, "votes"]) and math.isnan(got.loc[3, "radius"])
    got = got.drop(3)
    border = np.abs(got[["x1", "x2", "x3"]].to_numpy() @ W + BIAS) / math.sqrt(sum(w * w for w in W))
    sure = got["radius"].notna().to_numpy()
    right = (got["smoothed_pred"] == got["y"]).to_numpy()
    # an error of 0.001 a row: of some 1,300 sure rows a few may lie above
    assert sure.sum() > 800 and right[sure].mean() > 0.995 and (got["radius"].to_numpy()[sure] <= border[sure]).mean() > 0.99
    assert got["smoothed_pred"].isna().sum() == (~sure).sum() and border[~sure].max() < 0.2


def test_weights_of_a_fitted_model(spark):
    df = spark.createDataFrame(table(400)).withColumn("x2", F.col("x2") * 1000)
    model = mo.fit_model(df, ["x1", "x2", "x3"], "y", "lr", standardize=True, maxIter=20, regParam=0.01)
    weights, bias = ro.fitted_weights(model)
    same = model.transform(df).withColumn("mine", ro.linear_predict([F.col(c) for c in ("x1", "x2", "x3")], weights, bias))
    assert same.where("mine <> prediction").count() == 0
    with pytest.raises(ValueError):
        ro.fitted_weights(mo.fit_model(df, ["x1", "x2", "x3"], "y", "lr", pca=2, maxIter=2))


def test_votes_draw_spark_hashes(spark):
    """The noise comes from Spark's own hash of (key, copy, part), computed for many rows at once."""
    import math

    import numpy as np

    df = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7 / 7).alias("x")).withColumn("x", F.when(F.col("k") != "k5", F.col("x")))
    h = df.select(F.xxhash64("k").alias("h"), F.xxhash64("k", F.lit(3), F.lit(2)).alias("want")).toPandas()
    with np.errstate(over="ignore"):
        got = ro.hash_int(2, ro.hash_int(3, h["h"].to_numpy().view(np.uint64)))
    assert (got.view(np.int64) == h["want"]).all()

    def uniform(i, part):
        return (F.pmod(F.xxhash64("k", F.lit(i), F.lit(part)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))

    votes = sum((F.col("x") * 2.0 - 1.0 + 0.5 * 2.0 * F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2 * math.pi * uniform(i, 2)) >= 0).cast("int") for i in range(1, 9))
    out = ro.noisy_votes(df.withColumn("_want", votes), "k", ["x"], [2.0], -1.0, 0.5, 8).collect()
    assert all(r["votes"] == r["_want"] for r in out) and sum(r["votes"] is None for r in out) == 1
