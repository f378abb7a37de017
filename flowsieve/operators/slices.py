"""Order-preserving slices of keys that follow the data.

A sample of the (key, order) tuples, drawn by a hash of their content, is sorted per key; every
``SLICE_SAMPLE``-th becomes a cut. A row's slice is the number of cuts of its key that are not
above it. So a slice holds about the same number of rows whatever the values are: microsecond
gaps, one busy hour, scores near 1, a key with most of the table. Keys with few rows have one slice.

Sample, cuts and slices depend on the rows' content alone, so every task, every retry and
every reader of the plan agrees. The sample grows with the table between two bounds, and
the broadcast cuts are a fixed share of it. Rows find their slice in two steps, first a range of
cuts and then the cut in it, about the square root of their number each, without leaving generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAST_SAMPLE = 1 << 13
MOST_SAMPLE = 1 << 22
ROWS_PER_SAMPLE = 1 << 15
SLICE_SAMPLE = 32
#: Slices of rows without a value of the order lie below all others.
AFTER_NULL = 1 << 24


def cut_points(df: DataFrame, key: Sequence[str], order: Sequence[str], one_number: bool = False) -> DataFrame:
    """(_k0, _k1, ..., slice, range, starts, lo, hi): the cuts of each key, in order, dealt to ranges; ``hi`` is the next cut.

    The key columns are those of ``key`` and whether the first order column is NULL. With ``one_number`` the order
    is one numeric column, and cuts lie half-way between two sampled values, so a value that comes out
    different in its last bit elsewhere still falls on the same side.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    wanted = f"least(greatest(n div {ROWS_PER_SAMPLE}, {LEAST_SAMPLE}), {MOST_SAMPLE})"
    step = n.select(F.expr(f"greatest(n div {wanted}, 1)")).scalar()
    names = [f"_k{i}" for i in range(len(key) + 1)]
    drawn = df.where(F.pmod(F.xxhash64(*key, *order), step) == 0).select(*_keys(key, order), _place(order, one_number).alias("lo"))
    own = Window.partitionBy(*names).orderBy("lo")
    drawn = drawn.groupBy(*names, "lo").agg(F.count(F.lit(1)).alias("w"))
    placed = drawn.select(*names, "lo", F.floor((F.sum("w").over(own) - F.col("w")) / SLICE_SAMPLE).alias("k"), F.lag("lo").over(own).alias("last"))
    cut = F.col("lo")
    if one_number:
        value, before = F.col("lo.v0"), F.col("last.v0")
        middle = before + (value - before) / 2
        cut = F.struct(F.when((middle > before) & (middle < value), middle).otherwise(value).alias("v0"))
    starts = placed.select(*names, cut.alias("lo"), (F.col("k") > F.lag("k").over(own)).alias("starts")).where("starts")
    numbered = starts.select(
        *names, "lo", F.row_number().over(own).alias("slice"), F.lead("lo").over(own).alias("hi"), F.count(F.lit(1)).over(Window.partitionBy(*names)).alias("n")
    )
    place, wide = F.col("slice") - 1, F.ceil(F.sqrt("n"))
    return numbered.select(*names, "slice", F.floor(place / wide).alias("range"), (place % wide == 0).alias("starts"), "lo", "hi")


def _keys(key: Sequence[str], order: Sequence[str]) -> list[Column]:
    return [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(order[0]).isNull().alias(f"_k{len(key)}")]


def _place(order: Sequence[str], one_number: bool) -> Column:
    return F.struct(*[(F.col(c).cast("double") if one_number else F.col(c)).alias(f"v{i}") for i, c in enumerate(order)])


def with_slices(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "_b", one_number: bool = False) -> DataFrame:
    """``df`` with its slice number: within a key, a row that comes later in ``order`` never has a smaller one.

    NULLs come first, as in an ascending sort, so rows without a time have slices of their own. A NULL
    key is a key like any other here.
    """
    cuts = cut_points(df, key, order, one_number)
    names = [f"_k{i}" for i in range(len(key) + 1)]
    ranges = cuts.where("starts").withColumn("hi", F.lead("lo").over(Window.partitionBy(*names).orderBy("slice")))
    at = _place(order, one_number)

    def find(rows: DataFrame, among: DataFrame, equal: list[tuple[Column, str]], found: str) -> DataFrame:
        here = among.select(*[F.col(c).alias(f"_cut_{c}") for _, c in equal], F.col("lo").alias("_cut_lo"), F.col("hi").alias("_cut_hi"), F.col(found).alias(f"_cut_found_{found}"))
        test = (F.col("_cut_lo") <= at) & (F.col("_cut_hi").isNull() | (at < F.col("_cut_hi")))
        for mine, c in equal:
            test = test & mine.eqNullSafe(F.col(f"_cut_{c}"))
        return rows.join(F.broadcast(here), test, "left").drop("_cut_lo", "_cut_hi", *[f"_cut_{c}" for _, c in equal])

    mine = [*[F.col(k) for k in key], F.col(order[0]).isNull()]
    equal = list(zip(mine, names))
    in_range = find(df, ranges, equal, "range")
    sliced = find(in_range, cuts, [*equal, (F.col("_cut_found_range"), "range")], "slice")
    number = F.coalesce("_cut_found_slice", F.lit(0)) + F.when(F.col(order[0]).isNull(), 0).otherwise(AFTER_NULL)
    return sliced.withColumn(name, number.cast("int")).drop("_cut_found_range", "_cut_found_slice")
