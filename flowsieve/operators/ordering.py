"""Ordered work inside a group without sending the whole group to one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts each key in one task,
which fails as soon as one flow holds a large share of all rows. The kernels
here cut each key into order-preserving slices that follow the data
(``slices.with_slices``), work inside ``(key, slice)``, and carry what must cross
a slice edge through a summary with one row per ``(key, slice)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.operators.slices import with_slices
from flowsieve.session import materialize

BLOCK_ROWS = 4096


def attach_row(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row frame as a struct column through a scalar subquery."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias(name))
    return df.withColumn(name, packed.scalar())


def match_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Equi-join on ``keys``; the key columns of the left side are kept.

    Plain equality lets the join share the exchange of a window or aggregate
    over the same keys. Rows with a NULL key belong to no group then, as in a
    groupby; ``null_safe`` lets NULL match NULL and is meant for small right sides.
    """
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_group_stats(
    rows: DataFrame, stats: DataFrame, key: Sequence[str], spread: Sequence[str], salts: int = 8, how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Join one stats row per key to the rows of the key, spreading each key over
    ``salts`` tasks by a hash of the ``spread`` columns."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return match_keys(salted, copies, [*key, "_salt"], how, null_safe).drop("_salt")


#: Stats of so many keys at most are broadcast.
FEW_KEYS = 20_000


def join_class_stats(
    rows: DataFrame, stats: DataFrame, key: Sequence[str], spread: Sequence[str], how: str = "inner", null_safe: bool = False,
) -> DataFrame:
    """Join one stats row per class to the rows of the class. Classes are few as a rule, each with a large share of the
    rows: then the stats go to the rows, which do not move. Stats of more than ``FEW_KEYS`` classes are joined by salted keys.

    The stats are stored first, so every reader of the result finds them computed.
    """
    stored, few = store_small(stats, "class-stats")
    return match_keys(rows, F.broadcast(stored), key, how, null_safe) if few else join_group_stats(rows, stored, key, spread, how=how, null_safe=null_safe)


def store_small(df: DataFrame, label: str, most: int = FEW_KEYS) -> tuple[DataFrame, bool]:
    """``df`` stored, and whether it has at most ``most`` rows."""
    stored = materialize(df, label)
    return stored, stored.limit(most + 1).count() <= most


HOT_SHARE = 0.001


def join_heavy_stats(
    rows: DataFrame, stats: DataFrame, key: Sequence[str], weight: str, total: DataFrame | None = None, salts: int = 64,
    how: str = "inner", spread: Sequence[str] | None = None,
) -> DataFrame:
    """Join stats that may be as many as the rows, copying only those of hot keys.

    ``weight`` counts the rows of each key; ``total`` is a one-row frame with the
    number of all rows, if it is known more cheaply. Keys above a thousandth of
    all rows, at most a thousand by construction, are broadcast to mark their
    rows; these spread over ``salts`` tasks by a hash of ``spread`` (else all columns). All other keys stay whole. With ``how``
    left, rows without a key spread like those of a hot one.
    """
    everything = total if total is not None else stats.agg(F.sum(weight))
    limit = everything.select((F.col(everything.columns[0]) * HOT_SHARE).alias("_limit")).scalar()
    is_hot = F.col(weight) > limit
    hot = stats.where(is_hot).select(*key, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(*(spread or rows.columns)), F.lit(salts)).cast("int")
    wide = F.col("_hot")
    for k in key if how == "left" else ():
        wide = wide | F.col(k).isNull()
    marked = rows.join(F.broadcast(hot), list(key), "left").withColumn("_salt", F.when(wide, salt).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.drop("_hot").join(stats.withColumn("_salt", F.explode(copies)), [*key, "_salt"], how).drop("_salt")


def index_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "rn", null_safe: bool = False, total: str | None = None,
) -> DataFrame:
    """Dense 1-based row number inside each key (or over the whole table when
    ``key`` is empty), NULLs of the order first. ``total`` names a further column for
    the number of rows of the key, which comes along at no extra cost."""
    b = with_slices(df, key, order)
    totals = b.groupBy(*key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    size = [F.sum("_n").over(Window.partitionBy(*key)).alias(total)] if total else []
    offsets = totals.select(*key, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *size)
    inside = Window.partitionBy(*key, "_b").orderBy(*order)
    return (
        match_keys(b, offsets, [*key, "_b"], null_safe=null_safe)
        .withColumn(name, F.col("_off") + F.row_number().over(inside))
        .drop("_b", "_off")
    )


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_", keep_slice: bool = False,
) -> DataFrame:
    """``lag(1)`` of ``columns`` inside each key, ordered by ``order``, NULLs first. Rows travel
    once, to their ``(key, slice)``; the last row of the slice before comes from a per-slice summary.
    ``keep_slice`` leaves the slice number in ``_b``."""
    b = with_slices(df, key, order)
    tail = F.max(F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in columns])).alias("_tail")
    carried = {c: F.col(f"_carry._v_{c}") for c in columns}
    if list(columns) == [order[0]]:
        # a plain maximum stays in the hash aggregate; a struct would need a sort
        tail, carried = F.max(order[0]).alias("_tail"), {order[0]: F.col("_carry")}
    last = b.groupBy(*key, "_b").agg(tail)
    across = Window.partitionBy(*key).orderBy("_b")
    carry = last.select(*key, "_b", F.lag("_tail").over(across).alias("_carry"))
    inside = Window.partitionBy(*key, "_b").orderBy(*order)
    joined = match_keys(b, carry, [*key, "_b"]).withColumn("_first", F.row_number().over(inside) == 1)
    for c in columns:
        joined = joined.withColumn(prefix + c, F.when(F.col("_first"), carried[c]).otherwise(F.lag(c).over(inside)))
    return joined.drop("_carry", "_first") if keep_slice else joined.drop("_b", "_carry", "_first")


def with_look_back(df: DataFrame, key: Sequence[str], rows: int, block: int = BLOCK_ROWS, index: str = "rn") -> DataFrame:
    """Cut each indexed key into blocks of ``block`` rows and copy the last ``rows``
    rows of a block in front of the next one.

    Windows over ``(key, _blk)`` ordered by the index then see up to ``rows``
    earlier rows. Copies carry ``_ghost = true`` and are dropped afterwards.
    """
    if rows >= block:
        block = 2 * rows
    zero = F.col(index) - 1
    home = F.floor(zero / block)
    copies = F.when(zero % block >= block - rows, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home", home)
        .withColumn("_blk", F.explode(copies))
        .withColumn("_ghost", F.col("_blk") != F.col("_home"))
        .drop("_home")
    )


def block_window(key: Sequence[str], index: str = "rn"):
    return Window.partitionBy(*key, "_blk").orderBy(index)


def running_totals(
    df: DataFrame, key: Sequence[str], order: str, measures: Sequence[str], descending: bool = False
) -> DataFrame:
    """Inclusive running sum ``cum_<m>`` and total ``all_<m>`` of each measure inside each key, in two levels.

    ``df`` has one row per ``(key, order)`` value.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    b = with_slices(df, key, [order], one_number=True)
    sums = b.groupBy(*key, "_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*key).orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    offsets = sums.select(
        *key, "_b", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(*key, "_b").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = match_keys(b, offsets, [*key, "_b"])
    out = out.select("*", *[(F.col(f"_o_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures])
    return out.drop("_b", *[f"_o_{m}" for m in measures])


def prob_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def _rank(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_all") - 1)


def _holds(low: str, high: str, r: Column) -> Column:
    return (F.col(low) <= r) & (r < F.col(high))


def _wanted_bands(bands: DataFrame, key: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """From (key, _b, _n), the slices which hold a wanted rank, with the rows below them (_lo) and in all (_all)."""
    upto = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*key)
    bands = bands.select(
        *key, "_b", F.sum("_n").over(upto).alias("_hi"), F.sum("_n").over(whole).alias("_all"), "_n"
    ).withColumn("_lo", F.col("_hi") - F.col("_n"))
    wanted = F.lit(False)
    for p in probs:
        wanted = wanted | _holds("_lo", "_hi", F.floor(_rank(p))) | _holds("_lo", "_hi", F.ceil(_rank(p)))
    return bands.where(wanted).drop("_n", "_hi")


def _pick_quantiles(counts: DataFrame, key: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """From (key, _b, _v, _n, _lo, _all), the interpolated quantiles."""
    inside = Window.partitionBy(*key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_end", F.col("_lo") + F.sum("_n").over(inside)).withColumn("_start", F.col("_end") - F.col("_n"))
    picks = []
    for i, p in enumerate(probs):
        picks.append(F.max(F.when(_holds("_start", "_end", F.floor(_rank(p))), F.col("_v"))).alias(f"_f{i}"))
        picks.append(F.max(F.when(_holds("_start", "_end", F.ceil(_rank(p))), F.col("_v"))).alias(f"_c{i}"))
    picked = ranked.groupBy(*key).agg(F.max("_all").alias("_all"), *picks)
    lerp = [
        (F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * (_rank(p) - F.floor(_rank(p)))).alias(prob_name(p))
        for i, p in enumerate(probs)
    ]
    return picked.select(*key, *lerp)


def group_quantiles(df: DataFrame, key: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, columns ``p5``, ``p50``, ...

    Rows collapse to (key, value, count) before they travel; only the slices
    which hold a wanted rank are then ordered, each in its own task.
    """
    key = list(key)
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = with_slices(counts, key, ["_v"], one_number=True)
    bands = _wanted_bands(counts.groupBy(*key, "_b").agg(F.sum("_n").alias("_n")), key, probs)
    return _pick_quantiles(match_keys(counts, bands, [*key, "_b"]), key, probs)


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``(keep..., feature, value)`` of numeric columns."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value"
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row ``<column>_p<q>`` of exact quantiles of several columns.

    The first pass counts slices, which shrinks to a few rows per task; the second
    keeps only values in the slices that hold a wanted rank. Those are at most two
    per column and quantile, so they are broadcast and almost no value is shuffled.
    """
    cells = melt(df, [], columns).where(F.col("value").isNotNull()).select("feature", F.col("value").alias("_v"))
    cells = with_slices(cells, ["feature"], ["_v"], one_number=True)
    bands = _wanted_bands(cells.groupBy("feature", "_b").agg(F.count(F.lit(1)).alias("_n")), ["feature"], probs)
    inside = cells.join(F.broadcast(bands), ["feature", "_b"]).groupBy("feature", "_b", "_v", "_lo", "_all").agg(
        F.count(F.lit(1)).alias("_n")
    )
    long = _pick_quantiles(inside, ["feature"], probs)
    names = [prob_name(p) for p in probs]
    return long.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in names]
    )


def by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash partitioning for per-key Python work. The session's partition count is kept as it
    is: merging partitions by their bytes would starve cores when little data needs much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that a task of a fit holds and reads again in every pass.
FIT_ROWS = 1_000_000


def training_rows(df: DataFrame, label: str = "training", rows: int = FIT_ROWS) -> DataFrame:
    """``df`` stored, so that the passes of a fit do not compute it again, in parts of about ``rows`` rows at most."""
    stored = materialize(df, label)
    parts = -(-stored.count() // rows)
    return stored.repartition(parts) if parts > stored.rdd.getNumPartitions() else stored


def spread_small(df: DataFrame) -> DataFrame:
    """More partitions for a small input with fewer of them than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
