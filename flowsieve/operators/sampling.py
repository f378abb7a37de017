"""Deterministic splits, samples and balancing. Order inside a class is the md5 of a row key, so a retry draws the same rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.operators.ordering import attach_row, index_rows, match_keys, store_small
from flowsieve.session import materialize


def row_hash(key: str | Column) -> Column:
    return F.md5((F.col(key) if isinstance(key, str) else key).cast("string"))


def unit_hash(key: str | Column) -> Column:
    """The first 32 bits of the digest as a number in [0, 1)."""
    return F.conv(F.substring(row_hash(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_below(key: str | Column, share: float) -> Column:
    """Whether ``unit_hash`` is below ``share``, by the digits of the digest; NULL for a NULL key."""
    limit = max(0, math.ceil(share * (1 << 32)))
    return row_hash(key) < F.lit("g" if limit >> 32 else f"{limit:08x}")


BAND_DIGITS = 3
#: Bands of about 24 classes; so many are broadcast.
MOST_BANDS = 100_000


def with_bands(df: DataFrame, key: str) -> DataFrame:
    """Adds the digest of the key, ``_h``, and its head, ``_p``, the band of a row."""
    return df.withColumn("_h", row_hash(key)).withColumn("_p", F.substring("_h", 1, BAND_DIGITS))


def rank_by_hash(df: DataFrame, key: str, within: Sequence[str] = (), name: str = "rn", total: str | None = None) -> DataFrame:
    """1-based position inside each class in the order of the digest; ``total`` adds the class size.

    Digests spread evenly, so their heads cut each class into bands without a sample. A row's position is its place in its
    band, after the rows of the bands before it: these are counted and stored, and rows move once, to their band.
    """
    classes = list(within)
    h = with_bands(df, key)
    counted = h.groupBy(*classes, "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*classes)
    size = [F.sum("_n").over(whole).alias(total)] if total else []
    offsets = counted.select(*classes, "_p", (F.sum("_n").over(whole.orderBy("_p")) - F.col("_n")).alias("_off"), *size)
    offsets, few = store_small(offsets, "bands", MOST_BANDS)
    inside = Window.partitionBy("_p", *classes).orderBy("_h", key)
    placed = h.withColumn("_rn", F.row_number().over(inside))
    out = match_keys(placed, F.broadcast(offsets) if few else offsets, [*classes, "_p"], null_safe=True)
    return out.withColumn(name, F.col("_off") + F.col("_rn")).drop("_h", "_p", "_rn", "_off")


def mark_first(df: DataFrame, key: str, within: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """``df`` with a boolean column for each entry of ``wanted``: whether a row is among the first so many of its class in the
    order of the digest. The numbers may use ``class_n``, the rows of the class.

    The table is not ranked: rows are counted by the head of their digest, and only those in the few bands where a
    limit lies are numbered, in slices. All others are compared with the limit. Bands and limits are stored; those of at most
    ``FEW_KEYS`` classes are broadcast, so no row moves however large its class is.
    """
    classes = list(within)
    h = with_bands(df, key)
    counted = h.groupBy(*classes, "_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*classes)
    upto = F.sum("_n").over(whole.orderBy("_p"))
    bands = counted.select(*classes, "_p", "_n", (upto - F.col("_n")).alias("_lo"), F.sum("_n").over(whole).alias("class_n"))
    numbers = {name: F.least(n, F.col("class_n")) for name, n in wanted.items()}
    bands = bands.select("*", *[n.alias(f"_k_{name}") for name, n in numbers.items()])
    holds = F.lit(False)
    for name in wanted:
        holds = holds | ((F.col("_lo") < F.col(f"_k_{name}")) & (F.col(f"_k_{name}") <= F.col("_lo") + F.col("_n")))
    bands, few = store_small(bands.where(holds), "bands")
    own = F.broadcast if few else (lambda x: x)
    inside = materialize(match_keys(h.select(*classes, "_p", "_h", key), own(bands), [*classes, "_p"], null_safe=True), "in-bands")
    place = F.col("_lo") + F.col("_rn")
    ranked = index_rows(inside, [*classes, "_p"], ["_h", key], "_rn", null_safe=True)
    at = F.struct(F.col("_h").alias("h"), F.col(key).alias("key"))
    limits = ranked.groupBy(*classes).agg(*[F.max(F.when(place == F.col(f"_k_{name}"), at)).alias(f"_at_{name}") for name in wanted])
    limits = materialize(limits, "limits")
    out = match_keys(h, own(limits), classes, "left", null_safe=True) if classes else attach_row(h, limits, "_one").select("*", "_one.*").drop("_one")
    for name in wanted:
        out = out.withColumn(name, F.coalesce(at <= F.col(f"_at_{name}"), F.lit(False)))
    return out.drop("_h", "_p", *[f"_at_{name}" for name in wanted])


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """Adds ``split``: train, validation or test with the same shares in every class."""
    train = F.floor(F.col("class_n") * F.lit(1.0 - test - validation))
    upto = F.floor(F.col("class_n") * F.lit(1.0 - test))
    marked = mark_first(df, key, [label], {"_train": train, "_upto": upto})
    return marked.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_upto"), "validation").otherwise("test")).drop("_train", "_upto")


def random_split(df: DataFrame, key: str, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """Adds ``split`` by hash threshold: no shuffle at all."""
    train, upto = hash_below(key, 1.0 - test - validation), hash_below(key, 1.0 - test)
    return df.withColumn("split", F.when(train, "train").when(upto, "validation").otherwise("test"))


def stratified_sample(df: DataFrame, key: str, label: str, size: int = 20000) -> DataFrame:
    """At most about ``size`` rows, each class with its share of the table."""
    share = df.agg(F.least(F.lit(1.0), F.lit(float(size)) / F.greatest(F.count(F.lit(1)), F.lit(1)))).scalar()
    return mark_first(df, key, [label], {"_in": F.floor(F.col("class_n") * share + 0.5)}).where("_in").drop("_in")


def bounded_holdout(df: DataFrame, key: str, share: float = 0.2, size: int | None = None) -> DataFrame:
    """Test rows by hash mask, all of them or the first ``size`` in the order of the digest."""
    held = df.where(hash_below(key, share))
    return held if size is None else mark_first(held, key, [], {"_in": F.lit(size)}).where("_in").drop("_in")


def fold_numbers(df: DataFrame, key: str, k: int, label: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1; with ``label`` every class spreads evenly over the folds."""
    ranked = rank_by_hash(df, key, [label] if label else [])
    return ranked.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn")


def fold_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std) over folds, population std."""
    long = scores.select(*metrics).unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def balanced_oversample(df: DataFrame, key: str, label: str) -> DataFrame:
    """Every class grown to the size of the largest by repeating its rows evenly; ``copy`` counts the repeats."""
    ranked = rank_by_hash(df, key, [label], total="class_n")
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    out = attach_row(ranked, largest, "_m")
    copies = F.floor((F.col("_m.n") - F.col("rn")) / F.col("class_n")) + 1
    # explode in two steps, so that one row with very many copies never needs one huge array
    block = 1024
    out = out.withColumn("_copies", copies).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / block))))
    last = F.least(F.col("_copies"), (F.col("_b") + 1) * block)
    out = out.withColumn("copy", F.explode(F.sequence(F.col("_b") * block + 1, last)))
    return out.drop("rn", "class_n", "_m", "_copies", "_b")


def head_per_file(df: DataFrame, file: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each file in the order of a digest."""
    return mark_first(df, key, [file], {"_in": F.lit(n)}).where("_in").drop("_in")
