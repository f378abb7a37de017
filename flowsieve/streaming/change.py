"""Change detection: stateful stream detectors with bounded state, and their batch forms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowsieve.functions.columns import first_n_of, total
from flowsieve.operators.ordering import attach_row, block_window, column_quantiles, index_rows, with_look_back

# Window lengths and limits of the detectors.
DRIFT_WINDOW, DRIFT_LIMIT, WARNING_LIMIT = 1000, 0.1, 0.05
SCORE_WINDOW, SCORE_LEAST, SCORE_STDS, ADAPT_RATE = 500, 50, 3.0, 0.1
NOVELTY_SHARE = 0.95


#: Samples evaluated at once.
STEP_ROWS = 1024


def drift_steps(errors: np.ndarray, past: tuple, size: int, drift: float, warning: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(drift now, any drift so far, warning) of ordered errors (0 or 1), and the state after them.

    The state is (errors, samples) of the reference, the last samples since the reference was replaced (at most ``size``) and
    whether there was a drift. The moving error rates of a stretch are differences of one running sum; the first rate
    that is too far off ends the stretch, and its window becomes the reference.
    """
    wrong, counted, recent, drifted = past
    half = max(1, size // 2)
    now, ever, warned = np.zeros(len(errors), bool), np.zeros(len(errors), bool), np.zeros(len(errors), bool)
    at = 0
    while at < len(errors):
        stretch = np.concatenate([recent, errors[at : at + STEP_ROWS + size]]).astype(np.int64)
        sums, old = np.concatenate([[0], np.cumsum(stretch)]), len(recent)
        if not counted and len(stretch) >= half:
            wrong, counted = int(sums[half]), half
            judged = np.arange(max(old, half), len(stretch))
        else:
            judged = np.arange(max(old, half - 1), len(stretch)) if counted else np.zeros(0, int)
        begin = np.maximum(judged + 1 - size, 0)
        inside = sums[judged + 1] - sums[begin]
        gap = np.abs(inside / (judged + 1 - begin) - wrong / max(counted, 1))
        hits = np.flatnonzero(gap > drift)
        end = int(judged[hits[0]]) + 1 if len(hits) else len(stretch)
        seen = judged < end - bool(len(hits))
        warned[at + judged[seen] - old] = gap[seen] > warning
        ever[at : at + end - old] = drifted
        at += end - old
        if len(hits):
            drifted = now[at - 1] = ever[at - 1] = True
            wrong, counted = int(inside[hits[0]]), int(end - begin[hits[0]])
            recent = np.zeros(0, np.uint8)
        else:
            recent = stretch[-size:].astype(np.uint8)
    return now, ever, warned, (wrong, counted, recent, bool(drifted))


def threshold_steps(scores: np.ndarray, past: tuple, size: int, least: int, stds: float, rate: float) -> tuple[np.ndarray, tuple]:
    """Moving thresholds of ordered scores (NaN before ``least`` of them), and the state (last scores, threshold) after them.

    The threshold is a sum of mean + deviations of the window with weights that shrink by ``1 - rate`` per sample, so a step of
    samples is one scaled running sum; steps are short enough for the scale to stay within a double.
    """
    recent, last = past
    keep = 1.0 - rate
    step = min(STEP_ROWS, int(200 / -np.log10(keep)) + 1 if 0 < keep < 1 else STEP_ROWS if keep else 1)
    out = np.full(len(scores), np.nan)
    for at in range(0, len(scores), step):
        known = np.concatenate([recent, scores[at : at + step]])
        n = len(known) - len(recent)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), known]), size)[-n:]
        first = max(0, least - 1 - len(recent))
        recent = known[-size:]
        if first >= n:
            continue
        fresh = np.nanmean(windows[first:], axis=1) + stds * np.nanstd(windows[first:], axis=1)
        scale = keep ** np.arange(len(fresh))
        before = fresh[0] if last is None else last
        out[at + first : at + n] = scale * (keep * before + rate * np.cumsum(fresh / scale))
        last = float(out[at + n - 1])
    return out, (recent, last)


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(order)


def stream_drift(
    stream: DataFrame, key: str, order: Sequence[str], error: str, size: int = DRIFT_WINDOW, drift: float = DRIFT_LIMIT,
    warning: float = WARNING_LIMIT,
) -> DataFrame:
    """Per sample: ``drift_now``, the sticky ``drift`` flag and ``warning``, per stream key.

    Samples of a micro-batch are ordered by event time; the state of a key is
    one window of one byte per sample and two counts.
    """
    order = list(order)
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wrong, counted, recent, drifted = state.get if state.exists else (0, 0, b"", False)
        pdf = _ordered(batches, order)
        past = (wrong, counted, np.frombuffer(recent, np.uint8), drifted)
        now, ever, warned, (wrong, counted, recent, drifted) = drift_steps(pdf[error].to_numpy(np.int64), past, size, drift, warning)
        state.update((wrong, counted, recent.tobytes(), drifted))
        yield pdf[[key, *order]].reset_index(drop=True).assign(drift_now=now, drift=ever, warning=warned)

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order])
    return stream.select(key, *order, error).groupBy(key).applyInPandasWithState(
        step, f"{columns}, drift_now boolean, drift boolean, warning boolean",
        "wrong bigint, counted bigint, recent binary, drift boolean", "append", GroupStateTimeout.NoTimeout,
    )


def stream_adaptive_threshold(
    stream: DataFrame, key: str, order: Sequence[str], score: str, size: int = SCORE_WINDOW, least: int = SCORE_LEAST,
    stds: float = SCORE_STDS, rate: float = ADAPT_RATE,
) -> DataFrame:
    """Per sample: the moving threshold of its key and whether the score exceeds it."""
    order = list(order)
    kinds = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, last = state.get if state.exists else (b"", None)
        pdf = _ordered(batches, order)
        values = pdf[score].to_numpy(float)
        limits, (recent, last) = threshold_steps(values, (np.frombuffer(recent), last), size, least, stds, rate)
        state.update((recent.tobytes(), last))
        yield pdf[[key, *order]].reset_index(drop=True).assign(threshold=pd.Series(limits).where(~np.isnan(limits)), anomaly=values > limits)

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order])
    return stream.select(key, *order, score).groupBy(key).applyInPandasWithState(
        step, f"{columns}, threshold double, anomaly boolean", "scores binary, threshold double", "append", GroupStateTimeout.NoTimeout,
    )


def adjacent_window_drift(
    df: DataFrame, order: Sequence[str], error: str, size: int = DRIFT_WINDOW, key: Sequence[str] = (),
    drift: float = DRIFT_LIMIT, warning: float = WARNING_LIMIT,
) -> DataFrame:
    """Batch form: error rate of the last ``size`` rows against that of the ``size`` rows before them."""
    key = list(key)
    rows = with_look_back(index_rows(df, key, order), key, 2 * size - 1, max(4096, 8 * size))
    w = block_window(key)
    rows = rows.withColumns({
        "current_rate": F.avg(error).over(w.rowsBetween(1 - size, 0)),
        "reference_rate": F.avg(error).over(w.rowsBetween(1 - 2 * size, -size)),
    })
    diff = F.abs(F.col("current_rate") - F.col("reference_rate"))
    return rows.where(~F.col("_ghost") & (F.col("rn") >= 2 * size)).withColumns(
        {"drift": diff > drift, "warning": (diff > warning) & (diff <= drift)}
    ).drop("_ghost", "_blk")


def adaptive_threshold(
    df: DataFrame, key: Sequence[str], order: Sequence[str], score: str, size: int = SCORE_WINDOW, least: int = SCORE_LEAST,
    stds: float = SCORE_STDS, rate: float = ADAPT_RATE, block: int = 2048,
) -> DataFrame:
    """Batch form of the moving threshold, without a fold over a whole key.

    The threshold is a sum of fresh values with weights that shrink by
    ``1 - rate`` per row. Inside a block of rows it is a scaled running sum;
    from the block before only its last value is carried, since older ones
    weigh less than a double can show (0.9^2048 < 1e-93).
    """
    key = list(key)
    rows = with_look_back(index_rows(df, key, order), key, size - 1, max(4096, 8 * size))
    w = block_window(key).rowsBetween(1 - size, 0)
    fresh = F.avg(score).over(w) + stds * F.stddev_pop(score).over(w)
    rows = rows.withColumn("_fresh", fresh).where(~F.col("_ghost")).drop("_ghost", "_blk")
    keep = 1.0 - rate
    active = F.col("rn") >= least
    share = F.when(F.col("rn") == least, F.lit(1.0)).when(active, F.lit(rate)).otherwise(F.lit(0.0))
    k = (F.col("rn") - 1) % block
    rows = rows.withColumns({"_blk": F.floor((F.col("rn") - 1) / block), "_k": k})
    rows = rows.withColumn("_u", share * F.col("_fresh") * F.pow(F.lit(keep), -F.col("_k")))
    ends = rows.groupBy(*key, "_blk").agg((F.sum("_u") * F.pow(F.lit(keep), F.max("_k"))).alias("_end"))
    carry = ends.select(*key, "_blk", F.coalesce(F.lag("_end").over(Window.partitionBy(*key).orderBy("_blk")), F.lit(0.0)).alias("_carry"))
    joined = rows.join(carry, [*key, "_blk"])
    inside = block_window(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    thr = F.pow(F.lit(keep), F.col("_k")) * F.sum("_u").over(inside) + F.pow(F.lit(keep), F.col("_k") + 1) * F.col("_carry")
    out = joined.withColumn("threshold", F.when(active, thr))
    return out.withColumn("anomaly", F.coalesce(F.col(score) > F.col("threshold"), F.lit(False))).drop("_blk", "_k", "_u", "_carry", "_fresh")


def novelty_flags(df: DataFrame, train: DataFrame, error: str, share: float = NOVELTY_SHARE) -> DataFrame:
    """Rows whose error exceeds the ``share`` quantile of the training errors."""
    q = column_quantiles(train, [error], [share]).toDF("limit")
    return attach_row(df, q).withColumn("novel", F.col(error) > F.col("_s.limit")).drop("_s")


def reconstruction_error(train: DataFrame, df: DataFrame, features: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(train, df) with ``error``: mean squared error of a k-component PCA fitted on ``train``."""
    stages = [
        StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=False), PCA(k=k, inputCol="_z", outputCol="_p"),
    ]
    vec = lambda d: d.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = Pipeline(stages=stages).fit(vec(train))

    def squares(c: str) -> Column:
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)

    def scored(d: DataFrame) -> DataFrame:
        made = model.transform(vec(d))
        err = F.greatest(squares("_z") - squares("_p"), F.lit(0.0)) / F.size(features)
        return made.withColumn("error", err).drop("_v", "_z", "_p")

    return scored(train), scored(df)


def fit_patterns(df: DataFrame, features: str, k: int = 10, seed: int = 42) -> list[list[float]]:
    """Cluster centres; k rows reach the driver."""
    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    return [list(map(float, c)) for c in KMeans(k=k, seed=seed).fit(data).clusterCenters()]


def new_centres(old: Sequence[Sequence[float]], new: Sequence[Sequence[float]], share: float = 75.0) -> list[bool]:
    """Which new centres lie further from every old one than the ``share`` percentile of such distances."""
    a, b = np.asarray(old), np.asarray(new)
    nearest = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)).min(axis=0)
    return [bool(x) for x in nearest > np.percentile(nearest, share)]


def pattern_flags(df: DataFrame, features: str, centres: Sequence[Sequence[float]], stds: float = 2.0) -> DataFrame:
    """Rows whose nearest centre is further than mean + 2 std of the distances to all centres."""
    x = F.col(features)

    def distance(c: Sequence[float]) -> Column:
        parts = F.zip_with(x, first_n_of(c), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))

    out = df.withColumn("_d", F.array(*[distance(c) for c in centres]))
    n = float(len(centres))
    mean = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / n
    out = out.withColumn("_m", mean)
    var = F.aggregate(F.transform("_d", lambda v: (v - F.col("_m")) * (v - F.col("_m"))), F.lit(0.0), lambda s, v: s + v) / n
    return out.withColumns({"min_distance": F.array_min("_d"), "limit": F.col("_m") + stds * F.sqrt(var)}).withColumn(
        "new_pattern", F.col("min_distance") > F.col("limit")).drop("_d", "_m")


def combined_flag(flags: Sequence[str]) -> Column:
    """True when at least half (rounded down) of the detectors that answered say so; absent answers do not count."""
    votes = total([F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags])
    answered = total([F.col(f).isNotNull().cast("int") for f in flags])
    return votes >= F.floor(answered / 2)
