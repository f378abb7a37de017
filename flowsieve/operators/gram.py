"""Second moments of all pairs of columns in one pass, and what follows from them: correlations, an L1 path, PCA.

Each task turns its Arrow batches into blocks of at most ``BLOCK`` x ``BLOCK`` pairs by matrix products and merges them as it
goes; the blocks are then merged in groups of at most 64 (a tree), so what moves grows with the tasks and the pairs, never with
the rows. Moments are centred, so large means cost no digits. A pair uses the rows where both columns are present; NaN and
infinities count as missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.functions.columns import total
from flowsieve.operators.sampling import unit_hash

BLOCK = 128  # columns of a block
FAN_IN = 64  # blocks merged by one group of the tree

# Moments of a block of pairs (i, j): rows with both, mean of i and of j over them, centred products, centred squares of i and of j.
MOMENTS = ("n", "mean_i", "mean_j", "cross", "ss_i", "ss_j")
_PARTIAL = "fold long, bi int, bj int, branch long, " + ", ".join(f"{m} array<double>" for m in MOMENTS)
_CELLS = "fold long, i int, j int, n long, mean_i double, mean_j double, cross double, ss_i double, ss_j double"


def block_moments(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The six moments of every pair of a column of ``a`` and one of ``b``; rows are the same, NaN is missing."""
    parts = []
    for x in (a, b):
        there = np.isfinite(x)
        held = there.sum(axis=0)
        shift = np.where(there, x, 0.0).sum(axis=0) / np.maximum(held, 1)
        z = np.where(there, x - shift, 0.0)
        parts.append((there.astype(float), shift, z))
    (ma, sa, za), (mb, sb, zb) = parts
    n = ma.T @ mb
    d = np.maximum(n, 1.0)
    ta, tb = za.T @ mb, ma.T @ zb
    squares_i, squares_j = (za * za).T @ mb - ta * ta / d, ma.T @ (zb * zb) - tb * tb / d
    some = n > 0
    return [
        n, np.where(some, sa[:, None] + ta / d, 0.0), np.where(some, sb[None, :] + tb / d, 0.0),
        za.T @ zb - ta * tb / d, np.maximum(squares_i, 0.0), np.maximum(squares_j, 0.0),
    ]


def merge_moments(x: Sequence[np.ndarray], y: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Moments of the rows of both."""
    n = x[0] + y[0]
    d = np.maximum(n, 1.0)
    gap_i, gap_j = np.where(x[0] * y[0] > 0, y[1] - x[1], 0.0), np.where(x[0] * y[0] > 0, y[2] - x[2], 0.0)
    w = x[0] * y[0] / d
    mean = [(x[0] * x[k] + y[0] * y[k]) / d for k in (1, 2)]
    return [n, *mean, x[3] + y[3] + w * gap_i * gap_j, x[4] + y[4] + w * gap_i * gap_i, x[5] + y[5] + w * gap_j * gap_j]


def pair_moments(df: DataFrame, columns: Sequence[str], fold: Column | None = None) -> DataFrame:
    """(fold, i, j, n, mean_i, mean_j, cross, ss_i, ss_j) for the pairs i <= j of column positions, one pass over ``df``.

    ``fold`` (0 without one) is a number with few values, not NULL; rows without one are left out. An empty table gives no rows.
    """
    p = len(columns)
    starts = range(0, p, BLOCK)
    data = df.select(
        (F.lit(0) if fold is None else fold).cast("long").alias("_fold"), *[F.col(f"`{c}`").try_cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    ).where(F.col("_fold").isNotNull())

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for batch in batches:
            folds = batch["_fold"].to_numpy()
            values = batch.iloc[:, 1:].to_numpy(dtype=float, na_value=np.nan)
            for f in np.unique(folds):
                x = values[folds == f]
                for i in starts:
                    for j in starts:
                        if i <= j:
                            made, at = block_moments(x[:, i:i + BLOCK], x[:, j:j + BLOCK]), (int(f), i, j)
                            held[at] = merge_moments(held[at], made) if at in held else made
        task = TaskContext.get().partitionId()
        for (f, i, j), m in held.items():
            yield pd.DataFrame({"fold": [f], "bi": [i], "bj": [j], "branch": [task], **{k: [x.ravel()] for k, x in zip(MOMENTS, m)}})

    def merged(group: pd.DataFrame) -> list[np.ndarray]:
        out = None
        for r in group.sort_values("branch").itertuples():
            m = [np.asarray(getattr(r, k)) for k in MOMENTS]
            out = m if out is None else merge_moments(out, m)
        return out

    def join_branches(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        f, i, j, branch = key
        return pd.DataFrame({"fold": [f], "bi": [i], "bj": [j], "branch": [branch], **{k: [x] for k, x in zip(MOMENTS, merged(group))}})

    def to_cells(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        f, i, j = key
        wide, high = min(BLOCK, p - j), min(BLOCK, p - i)
        at_i, at_j = (x.ravel() for x in np.meshgrid(np.arange(i, i + high), np.arange(j, j + wide), indexing="ij"))
        m = dict(zip(MOMENTS, merged(group)))
        out = pd.DataFrame({"fold": f, "i": at_i, "j": at_j, **m})
        return out[out["i"] <= out["j"]]

    level = data.mapInPandas(per_task, _PARTIAL)
    for _ in range(2):  # 64 x 64 x 64 tasks end in groups of 64
        up = F.floor(F.col("branch") / FAN_IN).alias("branch")
        level = level.groupBy("fold", "bi", "bj", up).applyInPandas(join_branches, _PARTIAL)
    return level.groupBy("fold", "bi", "bj").applyInPandas(to_cells, _CELLS)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(first, second, n, mean_first, mean_second, covariance, corr) for all pairs, each column with itself included.

    Sample covariance, NULL below two rows; corr is NULL where a column is constant over the pair's rows.
    """
    names = F.array(*[F.lit(c) for c in columns])
    m = pair_moments(df, columns)
    size = F.sqrt(F.col("ss_i")) * F.sqrt(F.col("ss_j"))
    return m.select(
        F.get(names, F.col("i")).alias("first"), F.get(names, F.col("j")).alias("second"), "n",
        F.when(F.col("n") > 0, F.col("mean_i")).alias("mean_first"), F.when(F.col("n") > 0, F.col("mean_j")).alias("mean_second"),
        F.when(F.col("n") > 1, F.col("cross") / (F.col("n") - 1)).alias("covariance"),
        F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cross") / size))).alias("corr"),
    )


@dataclass
class Moments:
    """Moments of whole rows: their number, the column means and the centred products."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        w = self.n * other.n / n if n else 0.0
        mean = (self.n * self.mean + other.n * other.mean) / n if n else self.mean
        return Moments(n, mean, self.cross + other.cross + w * np.outer(gap, gap))


def fold_moments(df: DataFrame, columns: Sequence[str], fold: Column | None = None) -> dict[int, Moments]:
    """Moments per fold over the rows without a missing value. The cells (pairs times folds) reach the driver, no rows do."""
    whole = total([F.coalesce(_finite(c), F.lit(False)).cast("int") for c in columns]) == len(columns)
    p = len(columns)
    out: dict[int, Moments] = {}
    for r in pair_moments(df.where(whole), columns, fold).collect():
        m = out.setdefault(r["fold"], Moments(float(r["n"]), np.zeros(p), np.zeros((p, p))))
        m.cross[r["i"], r["j"]] = m.cross[r["j"], r["i"]] = r["cross"]
        m.mean[r["i"]], m.mean[r["j"]] = r["mean_i"], r["mean_j"]
    return out


def _finite(c: str) -> Column:
    x = F.col(f"`{c}`").try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


# -- L1 path -----------------------------------------------------------------------------------------

def soft(x: float, by: float) -> float:
    return max(x - by, 0.0) if x > 0 else min(x + by, 0.0)


def lasso_weights(g: np.ndarray, c: np.ndarray, alpha: float, start: np.ndarray, tolerance: float = 1e-9, sweeps: int = 10000) -> np.ndarray:
    """Minimiser of b'Gb/2 - c'b + alpha |b|_1 by coordinate descent; ``Gb`` is kept, so a step costs one column of G."""
    b = start.copy()
    gb = g @ b
    scale = max(float(np.abs(c).max(initial=0.0)), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if g[j, j] <= 0:
                continue
            new = soft(c[j] - gb[j] + g[j, j] * b[j], alpha) / g[j, j]
            if new != b[j]:
                gb += g[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * g[j, j])
                b[j] = new
        if moved <= tolerance * scale:
            break
    return b


def lasso_path(m: Moments, alphas: Sequence[float]) -> list[np.ndarray]:
    """Weights on standardised columns (the last column of ``m`` is the target) for falling alphas, each started at the one before."""
    sd = np.sqrt(np.diag(m.cross)[:-1] / max(m.n, 1.0))
    unit = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    g = m.cross[:-1, :-1] / max(m.n, 1.0) * np.outer(unit, unit)
    c = m.cross[:-1, -1] / max(m.n, 1.0) * unit
    b, out = np.zeros(len(c)), []
    for alpha in alphas:
        b = lasso_weights(g, c, alpha, b)
        out.append(b * unit)
    return out


def mean_squared_error(held: Moments, fitted: Moments, weights: np.ndarray) -> float:
    """Error on the rows of ``held`` of a linear model with the intercept of ``fitted``, from moments alone."""
    bias = (held.mean[-1] - fitted.mean[-1]) - weights @ (held.mean[:-1] - fitted.mean[:-1])
    inside = held.cross[-1, -1] - 2 * weights @ held.cross[:-1, -1] + weights @ held.cross[:-1, :-1] @ weights
    return float(max(inside, 0.0) / held.n + bias * bias)


def alpha_grid(m: Moments, size: int, span: float) -> list[float]:
    """Falling penalties from the smallest that leaves no column, down to ``span`` of it."""
    sd = np.sqrt(np.diag(m.cross)[:-1] / m.n)
    c = np.divide(m.cross[:-1, -1] / m.n, sd, out=np.zeros_like(sd), where=sd > 0)
    top = float(np.abs(c).max(initial=0.0))
    return [float(a) for a in np.geomspace(top, top * span, size)] if top > 0 else [0.0]


def cross_validated_lasso(
    df: DataFrame, columns: Sequence[str], target: str, key: str, alphas: Sequence[float] | None = None, folds: int = 5, size: int = 100, span: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """(weights, path) of an L1 model whose penalty is chosen by cross-validation, from one pass over the table.

    weights: (feature, coefficient, score), score = |coefficient| on standardised columns. path: (alpha, error, deviation, n_kept,
    best): mean and population deviation of the folds' squared errors. Folds follow a hash of ``key``, so a retry draws the same.
    Rows with a missing value are left out; a constant column gets 0; without rows, ValueError.
    """
    at = F.least(F.floor(unit_hash(key) * folds), F.lit(folds - 1))
    parts = {f: m for f, m in fold_moments(df, [*columns, target], at).items() if m.n}
    if not parts:
        raise ValueError("no row has all columns")
    whole = _sum(list(parts.values()))
    alphas = sorted((float(a) for a in alphas), reverse=True) if alphas else alpha_grid(whole, size, span)
    errors = []
    for f, held in parts.items():
        rest = [m for g, m in parts.items() if g != f]
        if rest:
            fitted = _sum(rest)
            errors.append([mean_squared_error(held, fitted, w) for w in lasso_path(fitted, alphas)])
    mean = np.mean(errors, axis=0) if errors else np.zeros(len(alphas))
    deviation = np.std(errors, axis=0) if errors else np.zeros(len(alphas))
    best = int(np.argmin(mean))  # the largest penalty of equal ones
    path = lasso_path(whole, alphas)
    sd = np.sqrt(np.diag(whole.cross)[:-1] / whole.n)
    spark = df.sparkSession
    rows = [(c, float(w), float(abs(w * s))) for c, w, s in zip(columns, path[best], sd)]
    steps = [(a, float(e), float(d), int((w != 0).sum()), k == best) for k, (a, e, d, w) in enumerate(zip(alphas, mean, deviation, path))]
    return (
        spark.createDataFrame(rows, "feature string, coefficient double, score double"),
        spark.createDataFrame(steps, "alpha double, error double, deviation double, n_kept int, best boolean"),
    )


def _sum(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


# -- PCA ---------------------------------------------------------------------------------------------

@dataclass
class Components:
    """Principal components of standardised columns; ``loadings`` has one row per component."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Adds ``pc0``, ``pc1``, ...: linear expressions over the columns, NULL where one is missing."""
        z = [(F.col(f"`{c}`").cast("double") - F.lit(float(m))) * F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.scale)]
        return df.withColumns({f"{prefix}{k}": total([x * F.lit(float(w)) for x, w in zip(z, row)]) for k, row in enumerate(self.loadings)})


def fit_components(df: DataFrame, columns: Sequence[str], k: int = 32) -> Components:
    """min(k, n) components from one pass; the largest loading of each (the first of equal ones) is positive.

    Rows with a missing value are left out; a constant column has scale 0. Without rows, ValueError.
    """
    m = _sum(list(fold_moments(df, columns).values()) or [Moments(0.0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))])
    if not m.n:
        raise ValueError("no row has all columns")
    sd = np.sqrt(np.diag(m.cross) / max(m.n - 1, 1.0))
    unit = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    values, vectors = np.linalg.eigh(m.cross / max(m.n - 1, 1.0) * np.outer(unit, unit))
    order = np.argsort(-values, kind="stable")[:min(k, len(columns))]
    loadings = vectors[:, order].T
    heavy = np.abs(loadings)
    lead = (heavy >= heavy.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
    loadings = loadings * np.where(loadings[np.arange(len(loadings)), lead] < 0, -1.0, 1.0)[:, None]
    return Components(list(columns), m.mean, unit, loadings, np.maximum(values[order], 0.0))
