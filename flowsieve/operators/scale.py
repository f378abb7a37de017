"""Scaling. Every scaler is a one-row parameter frame that is fitted once and applied to any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.operators.ordering import attach_row, column_quantiles

KINDS = ("minmax", "standard", "robust", "unit")


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """One row with ``<column>_center`` and ``<column>_width``; a width of 0 becomes 1."""

    def row(center, width) -> list[Column]:
        out = []
        for c in columns:
            w = width(c)
            out += [center(c).alias(f"{c}_center"), F.when(w != 0, w).otherwise(F.lit(1.0)).alias(f"{c}_width")]
        return out

    if kind == "minmax":
        return df.agg(*row(lambda c: F.min(c), lambda c: F.max(c) - F.min(c)))
    if kind == "unit":
        bounded = df.select(*[bounded_value(c).alias(c) for c in columns])
        return bounded.agg(*row(lambda c: F.min(c), lambda c: F.max(c) - F.min(c)))
    if kind == "standard":
        return df.agg(*row(lambda c: F.avg(c), lambda c: F.stddev_pop(c)))
    if kind == "robust":
        q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
        return q.select(*row(lambda c: F.col(f"{c}_p50"), lambda c: F.col(f"{c}_p75") - F.col(f"{c}_p25")))
    raise ValueError(f"unknown scaler {kind}")


def apply_scaler(df: DataFrame, fitted: DataFrame, columns: Sequence[str], kind: str = "minmax") -> DataFrame:
    out = attach_row(df, fitted)
    value = bounded_value if kind == "unit" else F.col
    return out.withColumns(
        {c: (value(c) - F.col(f"_s.{c}_center")) / F.col(f"_s.{c}_width") for c in columns}
    ).drop("_s")


def scale(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, columns, kind), columns, kind)


def bounded_value(c: str) -> Column:
    """NaN and NULL to 0, +inf to 1, -inf to 0."""
    x = F.col(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (x == float("-inf")), F.lit(0.0)).when(x == float("inf"), F.lit(1.0)).otherwise(x)
    )


def log_scale(c: str | Column) -> Column:
    return F.log1p(F.abs(F.col(c) if isinstance(c, str) else c))


def sqrt_scale(c: str | Column) -> Column:
    return F.sqrt(F.abs(F.col(c) if isinstance(c, str) else c))
