"""Joins, unions and comparisons of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from flowsieve.operators.clean import label_column


def enrich_flows(flows: DataFrame, tls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of TLS features on the flow key; flows without TLS get zeros."""
    added = [c for c in tls.columns if c not in keys]
    return flows.join(tls, list(keys), "left").fillna(0, subset=added)


def first_label(rows: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """The label of the earliest row of each key."""
    return rows.groupBy(key).agg(F.min_by(label, F.struct(*order)).alias(label))


def label_features(features: DataFrame, rows: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    return features.join(first_label(rows, key, label, order), key)


def align_features(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of per-flow tables; of two equal column names the first wins."""
    out = frames[0]
    for f in frames[1:]:
        fresh = [c for c in f.columns if c == key or c not in out.columns]
        out = out.join(f.select(*fresh), key, "full_outer")
    return out


def stack_tables(frames: Sequence[DataFrame], sort_columns: bool = False) -> DataFrame:
    """Row union of unlike schemas; absent columns are NULL."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns)) if sort_columns else out


def compare_columns(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """(feature, n_datasets, common): in how many schemas each feature occurs. Reads no rows."""
    spark = next(iter(datasets.values())).sparkSession
    found: dict[str, int] = {}
    for df in datasets.values():
        for c in df.columns:
            if c != label_column(df.columns):
                found[c] = found.get(c, 0) + 1
    rows = [(c, n, n == len(datasets)) for c, n in sorted(found.items())]
    return spark.createDataFrame(rows, "feature string, n_datasets int, common boolean")


def compare_labels(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """(label, n_datasets, n_rows, common): labels over all datasets."""
    parts = []
    for name, df in datasets.items():
        label = F.col(label_column(df.columns)).cast("string").alias("label")
        parts.append(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(name)))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    out = both.groupBy("label").agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("n").alias("n_rows"))
    return out.withColumn("common", F.col("n_datasets") == len(datasets))


def dataset_profiles(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, label column and number of classes per dataset."""
    parts = []
    for name, df in datasets.items():
        label = label_column(df.columns)
        parts.append(df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(label).cast("string")).alias("n_labels")
        ).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
                 F.lit(label).alias("label_column"), "n_labels"))
    return reduce(lambda a, b: a.unionByName(b), parts)
