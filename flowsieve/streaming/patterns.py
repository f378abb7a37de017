"""Pattern discovery on streams: centres refitted every so many samples, whatever the micro-batches.

A sample's place in the stream is the number of samples before its micro-batch plus its rank inside it, and every ``every`` places
are a window. All windows that a micro-batch completes are fitted side by side, one bounded group each, and compared with the
window before by joins. The store keeps one folder per micro-batch and table; a replayed micro-batch reads only what came before
it and writes its own folders anew, so it changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from flowsieve.operators.ordering import index_rows

# Samples of a window, centres of a window, percentile above which a centre is new, deviations above which a sample is.
EVERY, CENTRES, NEW_SHARE, NEW_STDS = 1000, 10, 0.75, 2.0

_OFFSETS = "start long, n long"
_SAMPLES = "place long, window long, min_distance double, new_pattern boolean"
_CENTRES = "window long, position int, centre array<double>"


def lloyd(x: np.ndarray, k: int, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """At most k centres (as many as there are distinct rows) by Lloyd's steps from spread starts; equal input, equal centres."""
    r = np.random.default_rng(seed)
    centres = x[:1] if len(x) == 0 else x[[r.integers(len(x))]]
    while 0 < len(centres) < k:
        far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[r.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds if len(x) else 0):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres[np.lexsort(centres.T[::-1])]


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def fit_windows(rows: DataFrame, k: int = CENTRES, seed: int = 42) -> DataFrame:
    """(window, position, centre) from rows (window, place, x); a window's rows are one group, as large as a window."""

    def fit(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(group.sort_values("place")["x"].to_numpy()).astype(float)
        made = lloyd(x, k, seed)
        return pd.DataFrame({"window": key[0], "position": np.arange(len(made)), "centre": list(made)})

    return rows.groupBy("window").applyInPandas(fit, _CENTRES)


def mark_new(centres: DataFrame, share: float = NEW_SHARE) -> DataFrame:
    """Adds ``is_new``: further from every centre of the window before than the ``share`` percentile of such distances. False
    in the first window."""
    before = centres.select((F.col("window") + 1).alias("window"), F.col("centre").alias("_old"))
    gaps = centres.join(before, "window", "left").groupBy("window", "position").agg(
        F.first("centre").alias("centre"), F.min(_distance(F.col("centre"), F.col("_old"))).alias("_gap"))
    limit = F.percentile("_gap", F.lit(share)).over(Window.partitionBy("window"))  # over one row per centre
    return gaps.withColumn("is_new", F.coalesce(F.col("_gap") > limit, F.lit(False))).drop("_gap")


def mark_samples(rows: DataFrame, centres: DataFrame, stds: float = NEW_STDS) -> DataFrame:
    """Adds ``min_distance`` and ``new_pattern`` by the centres of the window before: nearer than mean + 2 std of the distances to
    them is known. NULL in the first window."""
    lists = centres.groupBy((F.col("window") + 1).alias("window")).agg(F.collect_list("centre").alias("_c"))  # k centres each
    out = rows.join(lists, "window", "left").withColumn("_d", F.transform("_c", lambda c: _distance(F.col("x"), c)))
    n = F.size("_d")
    out = out.withColumn("_m", F.aggregate("_d", F.lit(0.0), lambda s, d: s + d) / n)
    std = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda s, d: s + (d - F.col("_m")) * (d - F.col("_m"))) / n)
    return out.withColumns({"min_distance": F.array_min("_d"), "new_pattern": F.array_min("_d") > F.col("_m") + stds * std}).drop("_c", "_d", "_m")


def pattern_batch(
    store: str, features: str, keep: Sequence[str], order: Sequence[str], every: int = EVERY, k: int = CENTRES, seed: int = 42,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that keeps ``rows``, ``offsets``, ``patterns`` and ``samples`` below ``store``.

    Rows whose features are NULL or hold a NULL or a non-finite number take no place. ``order`` places rows inside a micro-batch.
    """

    def put(df: DataFrame, table: str, number: int) -> DataFrame:
        path = f"{store}/{table}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        x = F.col(features).cast("array<double>")
        bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        rows = batch.where(x.isNotNull() & ~bad).select(*keep, *[c for c in order if c not in keep], x.alias("x"))
        kept = [*keep, *[c for c in order if c not in keep]]
        for table, schema in (("offsets", _OFFSETS), ("patterns", f"{_CENTRES}, is_new boolean")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/{table}/batch=-1")
        known = spark.read.schema(f"{_OFFSETS}, batch long").parquet(f"{store}/offsets").where(F.col("batch") < number)
        start = known.agg(F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0))).first()[0]
        place = (F.col("_rn") - 1 + start).cast("long")
        placed = index_rows(rows, [], list(order), "_rn").select(*kept, "x", place.alias("place"), F.floor(place / every).cast("long").alias("window"))
        placed = put(placed, "rows", number)
        n = placed.count()
        put(spark.createDataFrame([(start, n)], _OFFSETS).coalesce(1), "offsets", number)
        first, end = start // every, (start + n) // every  # windows that this micro-batch completes
        centres = spark.read.schema(f"{_CENTRES}, is_new boolean, batch long").parquet(f"{store}/patterns")
        earlier = centres.where((F.col("batch") < number) & (F.col("window") >= first - 1)).select("window", "position", "centre")
        if end > first:
            since = known.where(F.col("start") + F.col("n") > first * every).agg(F.min("batch")).first()[0]
            past = spark.read.schema("place long, window long, x array<double>, batch long").parquet(f"{store}/rows")
            past = past.where((F.col("batch") >= (number if since is None else since)) & (F.col("batch") <= number))
            fitted = fit_windows(past.where((F.col("window") >= first) & (F.col("window") < end)).select("window", "place", "x"), k, seed)
            marked = mark_new(earlier.unionByName(fitted)).where(F.col("window") >= first)
            fresh = put(marked.select("window", "position", "centre", "is_new"), "patterns", number)
            earlier = earlier.unionByName(fresh.select("window", "position", "centre"))
        put(mark_samples(placed, earlier).select(*kept, "place", "window", "min_distance", "new_pattern"), "samples", number)

    return step


def watch_patterns(
    stream: DataFrame, features: str, keep: Sequence[str], order: Sequence[str], store: str, every: int = EVERY, k: int = CENTRES, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(samples, patterns) of a stream read to its present end; a later call with the same store goes on where this one stopped.
    A stream without files gives none of either."""
    spark = stream.sparkSession
    kept = stream.select(*keep, *[c for c in order if c not in keep]).schema.fields
    samples = StructType([*kept, *spark.createDataFrame([], _SAMPLES).schema.fields])
    spark.createDataFrame([], samples).write.mode("ignore").parquet(f"{store}/samples/batch=-1")
    spark.createDataFrame([], f"{_CENTRES}, is_new boolean").write.mode("ignore").parquet(f"{store}/patterns/batch=-1")
    step = pattern_batch(store, features, keep, order, every, k, seed)
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(samples).parquet(f"{store}/samples"), spark.read.schema(f"{_CENTRES}, is_new boolean, batch long").parquet(f"{store}/patterns").drop("batch")
