"""Moments of column pairs against numpy, optimality of the L1 path, components."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import gram as gr, select as se


@pytest.fixture(scope="module")
def table():
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 6)) * [1, 5, 0.1, 1, 1, 2] + [0, 1e7, 3, 0, 0, -2]
    x[:, 3] = 0.8 * x[:, 0] + 0.2 * x[:, 3]
    y = 2 * x[:, 0] - 3 * (x[:, 1] - 1e7) / 5 + r.normal(size=3000) * 0.5
    out = pd.DataFrame(x, columns=list("abcdef"))
    out["y"], out["id"] = y, np.arange(3000)
    return out


def test_pairs_use_the_rows_where_both_are_present(spark, table, monkeypatch):
    monkeypatch.setattr(gr, "BLOCK", 4)  # seven columns in blocks of four
    holes = table.copy()
    holes.loc[::7, "a"] = np.nan
    holes.loc[::5, "b"] = np.inf
    df = spark.createDataFrame(holes).repartition(11)
    got = {(r["first"], r["second"]): r for r in gr.gram_matrix(df, list("abcdefy")).collect()}
    assert len(got) == 28
    clean = holes.replace([np.inf, -np.inf], np.nan)
    corr, cov = clean[list("abcdefy")].corr(), clean[list("abcdefy")].cov()
    for (a, b), r in got.items():
        assert r["n"] == clean[[a, b]].dropna().shape[0]
        assert r["corr"] == pytest.approx(corr.loc[a, b], abs=1e-9) and r["covariance"] == pytest.approx(cov.loc[a, b], rel=1e-7)


def test_moments_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 5.0, 2.0), (3.0, None, 2.0)], "`a.b` double, c double, k double")
    got = {(r["first"], r["second"]): r for r in gr.gram_matrix(df, ["a.b", "c", "k"]).collect()}
    assert got["a.b", "c"]["n"] == 1 and got["a.b", "c"]["covariance"] is None and got["a.b", "c"]["corr"] is None
    assert got["a.b", "k"]["covariance"] == 0.0 and got["a.b", "k"]["corr"] is None and got["a.b", "a.b"]["corr"] == pytest.approx(1.0)
    assert gr.gram_matrix(df.where("k > 9"), ["a.b", "c"]).count() == 0
    with pytest.raises(ValueError):
        gr.fit_components(df.where("k > 9"), ["a.b", "k"])
    with pytest.raises(ValueError):
        gr.cross_validated_lasso(df.where("k > 9"), ["k"], "c", "k")


def test_one_scan_and_no_wide_aggregate(spark, table):
    plan = gr.pair_moments(spark.createDataFrame(table), list("abc"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "corr(" not in plan


def test_lasso_weights_are_optimal(spark, table):
    m = gr.fold_moments(spark.createDataFrame(table), [*"abcdef", "y"])[0]
    sd = np.sqrt(np.diag(m.cross)[:-1] / m.n)
    g, c = m.cross[:-1, :-1] / m.n / np.outer(sd, sd), m.cross[:-1, -1] / m.n / sd
    alphas = gr.alpha_grid(m, 20, 1e-3)
    for alpha, w in zip(alphas, gr.lasso_path(m, alphas)):
        b = w * sd
        slope = c - g @ b
        assert np.all(np.abs(slope) <= alpha + 1e-6)  # no column could still gain
        assert np.allclose(slope[b != 0], alpha * np.sign(b[b != 0]), atol=1e-6)
    assert np.all(gr.lasso_path(m, alphas[:1])[0] == 0)


def test_cross_validation_from_moments_equals_that_on_rows(spark, table):
    df = spark.createDataFrame(table)
    weights, path = gr.cross_validated_lasso(df, list("abcdef"), "y", "id", folds=3, size=15)
    got = {r["feature"]: r for r in weights.collect()}
    assert got["a"]["coefficient"] == pytest.approx(2, abs=0.15) and got["b"]["coefficient"] == pytest.approx(-0.6, abs=0.05)
    assert max(got[c]["score"] for c in "cef") < 0.05
    fold = df.select("id", F.floor(gr.unit_hash("id") * 3).alias("f")).toPandas().set_index("id")["f"].loc[table["id"]].to_numpy()
    steps = path.orderBy(F.desc("alpha")).collect()
    x, y = table[list("abcdef")].to_numpy(), table["y"].to_numpy()
    for at in (0, 7, 14):
        errors = []
        for f in range(3):
            tx, ty = x[fold != f], y[fold != f]
            every = np.column_stack([tx, ty])
            m = gr.Moments(len(every), every.mean(0), (every - every.mean(0)).T @ (every - every.mean(0)))
            w = gr.lasso_path(m, [r["alpha"] for r in steps])[at]
            errors.append(np.mean((y[fold == f] - ty.mean() - (x[fold == f] - tx.mean(0)) @ w) ** 2))
        assert steps[at]["error"] == pytest.approx(np.mean(errors), rel=1e-6) and steps[at]["deviation"] == pytest.approx(np.std(errors), rel=1e-4, abs=1e-8)
    assert sum(r["best"] for r in steps) == 1 and steps[0]["n_kept"] == 0


def test_selection_falls_back_to_the_largest_weights(spark, table):
    df = spark.createDataFrame(table)
    got = {r["feature"]: r["selected"] for r in se.lasso_selection(df, list("abcdef"), "y", "id").collect()}
    assert got["a"] and got["b"]
    flat = df.withColumn("y", F.lit(1.0))
    assert [r["selected"] for r in se.lasso_selection(flat, list("abc"), "y", "id", fallback=2).collect()].count(True) == 2


def test_components(spark, table):
    df = spark.createDataFrame(table)
    c = gr.fit_components(df, list("abcdef"), 4)
    assert np.allclose(c.loadings @ c.loadings.T, np.eye(4), atol=1e-9) and np.all(np.diff(c.variance) <= 1e-12)
    assert all(row[np.abs(row).argmax()] > 0 for row in c.loadings)
    z = table[list("abcdef")]
    z = ((z - z.mean()) / z.std()).to_numpy()
    got = c.project(df).orderBy("id").select("pc0", "pc3").toPandas().to_numpy()
    assert np.allclose(got, z @ c.loadings[[0, 3]].T, atol=1e-6)
    assert np.allclose(c.variance, np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1][:4])
