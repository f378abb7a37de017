"""Column macros shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Small offsets that keep ratios and logarithms finite.
EPS = 1e-10
MIN_DURATION = 1e-6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable(c: str | Column) -> Column:
    """A double kept to float precision, so that engines which sum in another
    order give the same value."""
    return (F.round(col(c).cast("double"), 9) + F.lit(0.0)).cast("float").cast("double")


def time_bucket(c: str | Column, seconds: float) -> Column:
    """Order-preserving bucket number of an epoch-seconds column."""
    return F.floor(col(c) / F.lit(float(seconds))).cast("long")


def finite_or_null(c: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    x = col(c)
    bad = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(~bad, x)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, with ``default`` where b is 0 or either side is NULL."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(float(default)))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def camel_case(c: str | Column) -> Column:
    """``flow_byte rate`` -> ``flowByteRate``; words are cut at ``_``, ``-`` and blanks."""
    words = F.split(col(c), "[-_ ]")
    tail = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: F.initcap(w))
    return F.concat(F.lower(F.element_at(words, 1)), F.array_join(tail, ""))


def label_text(c: str | Column) -> Column:
    """Label text without outer blanks, inner blanks as underscores."""
    return F.regexp_replace(F.trim(col(c)), " ", "_")


def flow_key(src: str, sport: str, dst: str, dport: str, proto: str) -> Column:
    return F.concat(
        col(src).cast("string"), F.lit(":"), col(sport).cast("string"), F.lit("-"),
        col(dst).cast("string"), F.lit(":"), col(dport).cast("string"), F.lit("-"), col(proto).cast("string"),
    )


def numeric_or_zero(c: str | Column) -> Column:
    """Text to double; what cannot be parsed counts as 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based equal-width bin over [low, high]; the top edge falls in the last
    bin, and a constant column falls in bin 1."""
    raw = F.floor((x - low) / ((high - low) / F.lit(float(bins)))) + F.lit(1)
    return F.when(high > low, F.least(raw, F.lit(bins))).otherwise(F.lit(1)).cast("int")


def first_n_of(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
