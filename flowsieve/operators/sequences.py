"""Sliding-window sequence datasets.

Rows get a dense index first; windows are then built inside blocks of the
index, with the rows a window needs from the block before copied in front.
Neither one long table nor one long group ever lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.operators.ordering import BLOCK_ROWS, attach_row, block_window, index_rows, with_look_back

# Window sizes of the multi-scale dataset.
WINDOW_SIZES = [5, 10, 20, 50]


def _row(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _index(df: DataFrame, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    return index_rows(df, key, order)


def _slide(indexed: DataFrame, features: Sequence[str], label: str, window: int, stride: int, key: Sequence[str]) -> DataFrame:
    rows = with_look_back(indexed, key, window - 1, max(BLOCK_ROWS, 8 * window))
    w = block_window(key).rowsBetween(1 - window, 0)
    rows = rows.select(*key, "rn", "_ghost", F.col(label).alias("label"), F.collect_list(_row(features)).over(w).alias("sequences"))
    start = F.col("rn") - window
    keep = ~F.col("_ghost") & (start >= 0) & (start % stride == 0)
    return rows.where(keep).select(*key, (start / stride).cast("long").alias("window_id"), "sequences", "label")


def sliding_windows(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], window: int, stride: int = 1,
    key: Sequence[str] = (),
) -> DataFrame:
    """(key..., window_id, sequences, label): windows of ``window`` rows every ``stride``
    rows; the label is that of the last row. With ``key`` windows stay inside a group
    and groups shorter than the window give none."""
    return _slide(_index(df, order, list(key)), features, label, window, stride, list(key))


def multi_scale_windows(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], sizes: Sequence[int] = WINDOW_SIZES,
    stride: int = 1, key: Sequence[str] = (),
) -> DataFrame:
    indexed = _index(df, order, list(key))
    parts = [
        _slide(indexed, features, label, s, stride, list(key)).withColumn("window_size", F.lit(s)) for s in sizes
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def context_windows(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], past: int, window: int, future: int,
    stride: int = 1, key: Sequence[str] = (),
) -> DataFrame:
    """Past, main and future parts of each window; the label belongs to the end of the main part."""
    key = list(key)
    size = past + window + future
    rows = with_look_back(_index(df, order, key), key, size - 1, max(BLOCK_ROWS, 8 * size))
    w = block_window(key).rowsBetween(1 - size, 0)
    cells = F.struct(_row(features).alias("x"), F.col(label).alias("y"))
    rows = rows.select(*key, "rn", "_ghost", F.collect_list(cells).over(w).alias("_a"))
    start = F.col("rn") - size
    rows = rows.where(~F.col("_ghost") & (start >= 0) & (start % stride == 0))

    def part(first: int, n: int) -> Column:
        return F.transform(F.slice("_a", first, n), lambda c: c["x"])

    return rows.select(
        *key, (start / stride).cast("long").alias("window_id"), part(1, past).alias("past"),
        part(past + 1, window).alias("main"), part(past + window + 1, future).alias("future"),
        F.element_at("_a", past + window)["y"].alias("label"),
    )


def reshape_features(df: DataFrame, features: Sequence[str], steps: int, out: str = "sequence") -> DataFrame:
    """Feature vector as ``steps`` rows of ceil(n / steps) values, zero padded at the end."""
    width = -(-len(features) // steps)
    cells = [F.col(c).cast("double") for c in features] + [F.lit(0.0)] * (width * steps - len(features))
    return df.withColumn(out, F.array(*[F.array(*cells[i * width:(i + 1) * width]) for i in range(steps)]))


def flatten_sequences(df: DataFrame, window: int, n_features: int, column: str = "sequences") -> DataFrame:
    """(window x features) arrays to columns ``ts_<step>_<feature>``."""
    keep = [c for c in df.columns if c != column]
    flat = F.flatten(column)
    cells = [
        F.element_at(flat, i * n_features + j + 1).alias(f"ts_{i}_{j}") for i in range(window) for j in range(n_features)
    ]
    return df.select(*keep, *cells)


def sequence_summary(df: DataFrame, column: str = "sequences", label: str = "label") -> DataFrame:
    """Shape, value statistics and share of positive labels of a sequence dataset."""
    shape = df.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.max(F.size(column)).alias("window"),
        F.max(F.size(F.element_at(column, 1))).alias("features"), F.avg((F.col(label) != 0).cast("int")).alias("positive_share"),
    )
    cells = df.select(F.explode(F.flatten(column)).alias("x"))
    stats = cells.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return attach_row(shape, stats).select("*", "_s.*").drop("_s")
