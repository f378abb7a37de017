"""Features of a flow that hold across networks: rhythm, size pattern, direction and memory.

Flows with fewer than 10 packets get the default of each feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.functions.columns import EPS, clip, equal_width_bin, safe_divide
from flowsieve.operators.flows import ORDER, iat_with_previous, with_iat, zero
from flowsieve.operators.ordering import (
    block_window, by_key, group_quantiles, index_rows, join_group_stats, join_heavy_stats, with_look_back, with_previous,
)
from flowsieve.operators.spectral import approximate_entropy, gap_spectrum
from flowsieve.session import materialize

# Packets a flow needs, the features the stability score reads, DFA scales, box grids.
MIN_PACKETS = 10
STABLE_FEATURES = [
    "size_sequence_entropy", "size_autocorrelation", "bidirectional_ratio", "conversation_turns",
    "periodicity_strength", "hurst_exponent", "fractal_dimension",
]
DFA_SCALES, DFA_MIN_WINDOW, DFA_MIN_GAPS = 10, 4, 20
BOX_GRIDS = [2, 4, 8, 16]
FFT_LENGTH, FFT_COEFFICIENTS = 20, 10


def _enough(n: str, value: Column, default: float = 0.0, least: int = MIN_PACKETS) -> Column:
    return F.when(F.col(n) >= least, F.coalesce(value, F.lit(float(default)))).otherwise(F.lit(float(default)))


def gap_rhythm(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """CV of the IAT, share of gaps below P10, and time share of gaps above P90."""
    gaps = with_iat(packets, key).select(*key, "pkt_id", "iat")
    sizes = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    q = group_quantiles(gaps, key, "iat", [0.1, 0.9])
    rows = join_group_stats(gaps, sizes.join(q, list(key), "left"), key, ["pkt_id"])
    iat = F.col("iat")
    per = rows.groupBy(*key).agg(
        F.first("n").alias("n"), safe_divide(F.stddev_pop("iat"), F.avg("iat")).alias("cv"),
        F.avg((iat < F.col("p10")).cast("int")).alias("burst"),
        safe_divide(F.sum(F.when(iat > F.col("p90"), iat).otherwise(F.lit(0.0))), F.sum("iat")).alias("idle"),
    )
    return per.select(*key, _enough("n", F.col("cv")).alias("inter_arrival_cv"), _enough("n", F.col("burst")).alias("burst_ratio"),
                      _enough("n", F.col("idle")).alias("idle_time_ratio"))


def size_sequence_entropy(packets: DataFrame, key: Sequence[str] = ("flow_id",), bins: int = 10) -> DataFrame:
    stats = packets.groupBy(*key).agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.lit(1)).alias("rows"))
    rows = join_heavy_stats(packets.select(*key, "size"), stats, key, "rows")
    counts = rows.groupBy(*key, equal_width_bin(F.col("size"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    n = F.sum("c")
    per = counts.groupBy(*key).agg(n.alias("n"), (F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("h"))
    return per.select(*key, _enough("n", F.col("h")).alias("size_sequence_entropy"))


def size_memory(packets: DataFrame, key: Sequence[str] = ("flow_id",), max_lag: int = 10) -> DataFrame:
    """Largest |autocorrelation| of the size over lags 1..max_lag, and R^2 of size against position."""
    rows = with_look_back(index_rows(packets.select(*key, *ORDER, "size"), key, ORDER), key, max_lag)
    w = block_window(key)
    lags = range(1, max_lag + 1)
    rows = rows.select(*key, "rn", "size", "_ghost", *[F.lag("size", k).over(w).alias(f"l{k}") for k in lags])
    per = rows.where(~F.col("_ghost")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.corr("size", "rn").alias("trend"), *[F.corr("size", f"l{k}").alias(f"c{k}") for k in lags]
    )
    best = F.greatest(*[F.abs(F.when(~F.isnan(f"c{k}"), F.col(f"c{k}"))) for k in lags])
    trend = F.when(~F.isnan("trend"), F.col("trend") * F.col("trend"))
    return per.select(*key, _enough("n", best, least=max_lag + 1).alias("size_autocorrelation"), _enough("n", trend).alias("size_trend_strength"))


def direction_balance(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Ratio of the rarest to the most frequent direction, turns, and Gini of bytes over directions."""
    p = with_previous(packets, key, ORDER, ["direction"])
    turn = F.col("prev_direction").isNotNull() & (F.col("direction") != F.col("prev_direction"))
    per = p.groupBy(*key, "direction").agg(
        F.count(F.lit(1)).alias("c"), F.sum("size").alias("b"), F.count_if(turn).alias("turns")
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("b", "direction"))  # over one row per direction
    per = per.withColumn("i", rank)
    k, total = F.count(F.lit(1)), F.sum("b")
    out = per.groupBy(*key).agg(
        F.sum("c").alias("n"), F.when(k > 1, F.min("c") / F.max("c")).otherwise(F.lit(0.0)).alias("ratio"), F.sum("turns").alias("turns"),
        F.when(k < 2, F.lit(1.0)).otherwise(safe_divide(2 * F.sum(F.col("i") * F.col("b")), k * total) - F.when(total != 0, (k + 1) / k).otherwise(F.lit(0.0))).alias("gini"),
    )
    return out.select(*key, _enough("n", F.col("ratio")).alias("bidirectional_ratio"), _enough("n", F.col("turns").cast("double")).alias("conversation_turns"),
                      _enough("n", F.col("gini")).alias("dominance_score"))


def gap_series(packets: DataFrame, key: Sequence[str] = ("flow_id",), keep_short: bool = False) -> DataFrame:
    """(key, pos, iat): gaps of each flow with positions 1..n."""
    rows = with_look_back(index_rows(packets.select(*key, *ORDER), key, ORDER), key, 1)
    rows = rows.withColumn("iat", F.col("t") - F.lag("t").over(block_window(key)))
    return rows.where(~F.col("_ghost") & (F.col("rn") >= 2)).select(*key, (F.col("rn") - 1).alias("pos"), "iat")


def size_series(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    return index_rows(packets.select(*key, *ORDER, "size"), key, ORDER, name="pos").select(*key, "pos", "size")


def periodic_features(packets: DataFrame, key: Sequence[str] = ("flow_id",), limit: int | None = None) -> DataFrame:
    """Periodicity strength, dominant frequency and spectral entropy of the gaps."""
    more = {} if limit is None else {"limit": limit}
    return gap_spectrum(gap_series(packets, key), key, "pos", "iat", **more)


def rhythm_complexity(packets: DataFrame, key: Sequence[str] = ("flow_id",), **options) -> DataFrame:
    return approximate_entropy(gap_series(packets, key), key, "pos", "iat", name="rhythm_complexity", **options)


def size_complexity(packets: DataFrame, key: Sequence[str] = ("flow_id",), **options) -> DataFrame:
    return approximate_entropy(size_series(packets, key), key, "pos", "size", eps=EPS, absolute=True, least=3, name="size_approximate_entropy", **options)


def fft_features(series: DataFrame, key: Sequence[str], value: str, prefix: str, pos: str = "pos") -> DataFrame:
    """Magnitudes of the first 10 coefficients of the first 20 values (zero padded), over the
    largest; sums of constant cosines and sines, so no Python runs."""
    j = F.col(pos) - 1
    inside = series.where(F.col(pos) <= FFT_LENGTH)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in range(FFT_COEFFICIENTS):
        angle = [2 * np.pi * k * i / FFT_LENGTH for i in range(FFT_LENGTH)]
        for name, f in (("c", np.cos), ("s", np.sin)):
            table = F.array(*[F.lit(float(f(a))) for a in angle])
            aggs.append(F.sum(F.col(value) * F.element_at(table, (j + 1).cast("int"))).alias(f"{name}{k}"))
    per = inside.groupBy(*key).agg(*aggs)
    size = [F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")) for k in range(FFT_COEFFICIENTS)]
    top = F.greatest(*size) + EPS
    return per.select(*key, *[F.when(F.col("n") >= 2, m / top).otherwise(F.lit(0.0)).alias(f"{prefix}_{k}") for k, m in enumerate(size)])


def running_deviation(gaps: DataFrame, key: Sequence[str], block: int = 4096) -> DataFrame:
    """Adds ``y``, the running sum of iat - mean(iat), with ``n``, ``mean`` and ``sd`` of the flow, in two levels."""
    key = list(key)
    g = gaps.withColumn("_blk", F.floor((F.col("pos") - 1) / block))
    sums = g.groupBy(*key, "_blk").agg(F.sum("iat").alias("_t"))
    before = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_o"))
    stats = gaps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("iat").alias("mean"), F.stddev_pop("iat").alias("sd"))
    blocks = offsets.join(stats, key)
    inside = Window.partitionBy(*key, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = g.join(blocks, [*key, "_blk"])
    return out.withColumn("y", F.col("_o") + F.sum("iat").over(inside) - F.col("pos") * F.col("mean")).drop("_blk", "_o")


def with_flow_defaults(packets: DataFrame, features: DataFrame, key: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Every flow with its features; the default where a flow has none."""
    flows = packets.select(*key).distinct()
    out = flows.join(features, list(key), "left")
    return out.select(*key, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def hurst_exponent(packets: DataFrame, key: Sequence[str] = ("flow_id",), deviation: DataFrame | None = None) -> DataFrame:
    """log(range of the running deviation / std) / log(n), within [0, 1]; 0.5 without enough gaps."""
    y = running_deviation(gap_series(packets, key), key) if deviation is None else deviation
    per = y.groupBy(*key).agg((F.max("y") - F.min("y")).alias("r"), F.first("sd").alias("sd"), F.first("n").alias("n"))
    ok = (F.col("n") >= MIN_PACKETS) & (F.col("sd") > 0)
    h = F.when(ok, clip(F.log(F.when(F.col("r") > 0, F.col("r") / F.when(F.col("sd") > 0, F.col("sd")))) / F.log(F.col("n")), 0, 1))
    return with_flow_defaults(packets, per.select(*key, h.alias("hurst_exponent")), key, {"hurst_exponent": 0.5})


def fractal_dimension(packets: DataFrame, key: Sequence[str] = ("flow_id",), grids: Sequence[int] = BOX_GRIDS, gaps: DataFrame | None = None) -> DataFrame:
    """``fractal_dimension`` (1 by definition, its grids have one box) and ``box_dimension``,
    the slope of log(occupied boxes) over log(grid), within [1, 2]."""
    gaps = gap_series(packets, key) if gaps is None else gaps
    stats = gaps.groupBy(*key).agg(F.min("iat").alias("lo"), F.max("iat").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = join_heavy_stats(gaps, stats, key, "n").withColumn("g", F.explode(F.array(*[F.lit(g) for g in grids])))
    level = (F.col("iat") - F.col("lo")) / (F.col("hi") - F.col("lo") + EPS)
    boxes = rows.where(F.col("n") >= MIN_PACKETS).select(
        *key, "g", F.floor((F.col("pos") - 1) * F.col("g") / F.col("n")).alias("bx"), F.floor(level * F.col("g")).alias("by")
    ).distinct()
    counts = boxes.groupBy(*key, "g").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(*key).agg(clip(F.regr_slope(F.log("c"), F.log("g")), 1, 2).alias("box_dimension"))
    out = with_flow_defaults(packets, per, key, {"box_dimension": 1.0})
    return out.withColumn("fractal_dimension", F.lit(1.0))


def dfa_windows(n: Column) -> Column:
    """Window sizes of a flow with ``n`` gaps: whole parts of 10 log-spaced values up to n / 4."""
    top = F.log10(F.floor(n / 4).cast("double"))
    at = lambda i: F.floor(F.pow(F.lit(10.0), F.lit(0.5) + i * (top - 0.5) / (DFA_SCALES - 1)) + 1e-9).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(DFA_SCALES - 1)), at)))


def long_range_dependence(packets: DataFrame, key: Sequence[str] = ("flow_id",), aligned: bool = False, deviation: DataFrame | None = None) -> DataFrame:
    """|slope - 0.5| of log fluctuation over log window size, within [0, 1]; needs 20 gaps and 3 scales.

    Fluctuations of windows of at least 4 gaps are set against the window sizes
    counted from the smallest; ``aligned`` sets each against its own size.
    """
    key = list(key)
    y = (running_deviation(gap_series(packets, key), key) if deviation is None else deviation).where(F.col("n") >= DFA_MIN_GAPS)
    sizes = dfa_windows(F.col("n"))
    # little data, much work: a row becomes one per scale
    y = by_key(y.withColumn("_block", F.floor(F.col("pos") / 4096)), [*key, "_block"])
    cells = y.select(*key, "pos", "y", "n", F.posexplode(F.filter(sizes, lambda s: s >= DFA_MIN_WINDOW)).alias("rank", "w"), sizes.alias("sizes"))
    part = F.floor((F.col("pos") - 1) / F.col("w"))
    cells = cells.withColumn("part", part).where(F.col("part") < F.floor(F.col("n") / F.col("w")))
    fits = cells.groupBy(*key, "rank", "w", "part").agg(
        F.greatest(F.regr_syy("y", "pos") - F.regr_sxy("y", "pos") * F.regr_sxy("y", "pos") / F.regr_sxx("y", "pos"), F.lit(0.0)).alias("sse"),
        F.first("sizes").alias("sizes"),
    )
    flucts = fits.groupBy(*key, "rank", "w").agg(F.avg(F.sqrt(F.col("sse") / F.col("w"))).alias("f"), F.first("sizes").alias("sizes"))
    x = F.col("w") if aligned else F.element_at("sizes", F.col("rank") + 1)
    per = flucts.groupBy(*key).agg(
        F.regr_slope(F.log(F.when(F.col("f") > 0, F.col("f"))), F.log(x)).alias("slope"), F.count(F.lit(1)).alias("k")
    )
    lrd = F.when(F.col("k") >= 3, clip(F.abs(F.col("slope") - 0.5), 0, 1))
    return with_flow_defaults(packets, per.select(*key, lrd.alias("long_range_dependence")), key, {"long_range_dependence": 0.0})


def invariance_score(features: DataFrame, names: Sequence[str] = STABLE_FEATURES) -> DataFrame:
    """Mean of 1 / (1 + CV across flows) over the stable features: one value for the table."""
    have = [c for c in names if c in features.columns]
    parts = [F.lit(1.0) / (F.lit(1.0) + F.stddev_pop(c) / (F.avg(c) + EPS)) for c in have]
    acc = parts[0]
    for p in parts[1:]:
        acc = acc + p
    return features.agg((acc / F.lit(float(len(names)))).alias("invariance_score"))


def rhythm_features(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Mean, std, CV and regularity of the gaps; intensity and frequency of bursts (gaps below P25)."""
    rows = iat_with_previous(packets, key).where(F.col("iat").isNotNull())
    q = group_quantiles(rows, key, "iat", [0.25])
    rows = join_group_stats(rows.select(*key, "pkt_id", "iat", "prev_iat"), q, key, ["pkt_id"])
    iat, limit = F.col("iat"), F.col("p25")
    burst = iat < limit
    starts = burst & ~F.coalesce(F.col("prev_iat") < limit, F.lit(False))
    cv = F.stddev_pop("iat") / (F.avg("iat") + EPS)
    n = F.count(F.lit(1))
    return rows.groupBy(*key).agg(
        F.avg("iat").alias("rhythm_mean"), F.stddev_pop("iat").alias("rhythm_std"), cv.alias("rhythm_cv"),
        F.when(n < 3, F.lit(0.0)).otherwise(1.0 / (1.0 + cv)).alias("rhythm_regularity"),
        zero(F.lit(1.0) / (F.avg(F.when(burst, iat)) + EPS)).alias("burst_intensity"),
        (F.count_if(starts) / n).alias("burst_frequency"),
    )


def flow_invariants(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """All invariant features, one row per flow. Packets, gaps and their deviation are stored, as several features read them."""
    key = list(key)
    packets = materialize(packets.select(*key, *ORDER, "size", "direction"), "packets")
    gaps = materialize(gap_series(packets, key), "gaps")
    deviation = materialize(running_deviation(gaps, key), "deviation")
    out = gap_rhythm(packets, key)
    for part in (
        size_sequence_entropy(packets, key), size_memory(packets, key), direction_balance(packets, key),
        with_flow_defaults(packets, periodic_features(packets, key), key, {"periodicity_strength": 0.0, "dominant_frequency": 0.0, "spectral_entropy": 0.0}),
        hurst_exponent(packets, key, deviation), fractal_dimension(packets, key, gaps=gaps).drop("box_dimension"),
        long_range_dependence(packets, key, deviation=deviation),
    ):
        out = out.join(part, key)
    return out
