"""Spectra and pattern matching of per-flow series, at any series length.

Flows up to a stated size are handled one flow per group, with numpy on that
bounded group. Longer flows take an exact distributed way: a two-step Fourier
transform whose groups hold about the square root of the series, and sliced
template matching whose groups hold a fixed number of templates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.operators.boxes import within
from flowsieve.operators.ordering import block_window, by_key, join_group_stats, with_look_back
from flowsieve.session import materialize

FLOW_ROWS = 1 << 18  # largest series handled as one group
MATCH_ROWS = 1 << 16  # largest side of one template-matching group
DIRECT_PAIRS = 1 << 17  # template pairs compared one by one instead of by range counting
MIN_GAPS = 10
PEAK_HEIGHT = 0.1


def split_by_size(series: DataFrame, key: Sequence[str], value: str, limit: int, spread: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short flows, rows of long flows or None); long rows carry ``_n``, ``_mean`` and ``_sd`` of their flow.

    The series is written once: the size check and both ways read it.
    """
    series = materialize(series, "series")
    stats = series.groupBy(*key).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd")
    )
    if stats.where(F.col("_n") > limit).isEmpty():
        return series, None
    rows = join_group_stats(series, stats, key, spread)
    return rows.where(F.col("_n") <= limit).select(*series.columns), rows.where(F.col("_n") > limit)


def _highest_peak(r: np.ndarray) -> float:
    """Highest inner local maximum of at least PEAK_HEIGHT; flat tops count once."""
    c = r[np.concatenate(([True], np.diff(r) != 0))]
    if len(c) < 3:
        return 0.0
    inner = c[1:-1]
    top = inner[(inner > c[:-2]) & (inner > c[2:]) & (inner >= PEAK_HEIGHT)]
    return float(top.max()) if len(top) else 0.0


def _spectrum(x: np.ndarray) -> tuple[float, float, float]:
    """(periodicity strength, dominant frequency, spectral entropy) of one series."""
    n = len(x)
    if n < MIN_GAPS:
        return 0.0, 0.0, 0.0
    f = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    r = np.fft.irfft(f * np.conj(f))[:n]
    strength = _highest_peak((r / r[0] if r[0] != 0 else r)[1:])
    p = np.abs(np.fft.rfft(x - x.mean())) ** 2
    p[1:(n + 1) // 2] *= 2  # one-sided: every frequency but 0 and n/2 stands for two
    total = p.sum()
    q = p[p > 0] / total if total > 0 else p[p > 0]
    return strength, float((np.argmax(p[1:]) + 1) / n), float(-(q * np.log2(q)).sum())


def fourier(rows: DataFrame, key: Sequence[str], inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform per key of (key, j, re, im, bits), length 2^bits, absent j = 0.

    With N = N1 * N2, the series is cut into N2 interleaved columns (one group
    each), turned, and cut into N1 rows (one group each).
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", j bigint, g bigint, re double, im double, bits int"
    sign = 1.0 if inverse else -1.0
    keys = list(key)

    def turn(x: np.ndarray) -> np.ndarray:
        return np.fft.ifft(x) * len(x) if inverse else np.fft.fft(x)

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        bits, j2 = int(pdf["bits"].iloc[0]), int(pdf["g"].iloc[0])
        n1, n2 = 1 << (bits // 2), 1 << (bits - bits // 2)
        x = np.zeros(n1, dtype=complex)
        x[pdf["j"].to_numpy() // n2] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1 = np.arange(n1)
        y = turn(x) * np.exp(sign * 2j * np.pi * ((j2 * k1) % (n1 * n2)) / (n1 * n2))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "j": j2, "g": k1, "re": y.real, "im": y.imag, "bits": bits})

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        bits, k1 = int(pdf["bits"].iloc[0]), int(pdf["g"].iloc[0])
        n1, n2 = 1 << (bits // 2), 1 << (bits - bits // 2)
        x = np.zeros(n2, dtype=complex)
        x[pdf["j"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = turn(x) / (n1 * n2 if inverse else 1)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "j": k1 + n1 * np.arange(n2), "g": k1, "re": y.real, "im": y.imag, "bits": bits})

    cols = rows.select(*keys, "j", F.expr("j % shiftleft(1L, CAST(bits - floor(bits / 2) AS INT))").alias("g"), "re", "im", "bits")
    first = by_key(cols, [*keys, "g"]).groupBy(*keys, "g").applyInPandas(columns, schema)
    return by_key(first, [*keys, "g"]).groupBy(*keys, "g").applyInPandas(lines, schema).drop("g")


def _bits(n: Column) -> Column:
    """Exponent of the smallest power of two >= 2n."""
    return F.ceil(F.log2(n.cast("double") * 2)).cast("int")


def _long_spectrum(long: DataFrame, key: Sequence[str], pos: str, value: str) -> DataFrame:
    keys = list(key)
    sizes = long.groupBy(*keys).agg(F.first("_n").alias("_n"))
    j = (F.col(pos) - 1).cast("long")
    zero = F.lit(0.0)
    # autocorrelation: transform, power, transform back
    x = long.select(*keys, j.alias("j"), F.col(value).alias("re"), zero.alias("im"), _bits(F.col("_n")).alias("bits"))
    power = fourier(x, keys).select(*keys, "j", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), zero.alias("im"), "bits")
    r = join_group_stats(fourier(power, keys, inverse=True), sizes, keys, ["j"]).where(F.col("j") < F.col("_n"))
    top = r.where(F.col("j") == 0).select(*keys, F.col("re").alias("_r0"))
    r = join_group_stats(r.withColumn("rn", F.col("j") + 1), top, keys, ["j"])
    scaled = r.select(*keys, "rn", F.when(F.col("_r0") != 0, F.col("re") / F.col("_r0")).otherwise(F.col("re")).alias("v"), "_n")
    near = with_look_back(scaled, keys, 2)
    w = block_window(keys)
    near = near.withColumn("mid", F.lag("v", 1).over(w)).withColumn("left", F.lag("v", 2).over(w)).where(~F.col("_ghost") & (F.col("rn") >= 4))
    is_peak = (F.col("mid") > F.col("left")) & (F.col("mid") > F.col("v")) & (F.col("mid") >= PEAK_HEIGHT)
    strength = near.groupBy(*keys).agg(F.coalesce(F.max(F.when(is_peak, F.col("mid"))), zero).alias("periodicity_strength"))
    # periodogram of the exact length n as a chirp convolution of power-of-two length
    n = F.col("_n")
    angle = (F.col("j") * F.col("j")) % (2 * n) / n.cast("double") * F.lit(float(np.pi))
    base = long.select(*keys, j.alias("j"), (F.col(value) - F.col("_mean")).alias("x"), "_n", _bits(n).alias("bits")).withColumn("a", angle)
    a = base.select(*keys, "j", (F.col("x") * F.cos("a")).alias("re"), (-F.col("x") * F.sin("a")).alias("im"), "bits")
    mirror = F.expr("shiftleft(1L, bits)") - F.col("j")
    places = F.when(F.col("j") > 0, F.array(F.col("j"), mirror)).otherwise(F.array(F.col("j")))
    b = base.select(*keys, F.explode(places).alias("j"), F.cos("a").alias("re"), F.sin("a").alias("im"), "bits")
    fa, fb = fourier(a, keys), fourier(b, keys).select(*keys, "j", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = fa.join(fb, [*keys, "j"]).select(
        *keys, "j", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"), "bits",
    )
    conv = join_group_stats(fourier(product, keys, inverse=True), sizes, keys, ["j"])
    half = conv.where(F.col("j") <= F.floor(n / 2))
    single = (F.col("j") == 0) | (2 * F.col("j") == n)
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.when(single, 1.0).otherwise(2.0)
    psd = half.select(*keys, "j", p.alias("p"), "_n")
    inner = F.when(F.col("j") > 0, F.struct((-F.col("p")).alias("q"), "j"))
    plogp = F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(zero)
    spec = psd.groupBy(*keys).agg(
        (F.min(inner)["j"] / F.first("_n")).alias("dominant_frequency"),
        (F.log2(F.sum("p")) - F.sum(plogp) / F.sum("p")).alias("spectral_entropy"),
    )
    return strength.join(spec, keys)


def gap_spectrum(series: DataFrame, key: Sequence[str], pos: str, value: str, limit: int = FLOW_ROWS) -> DataFrame:
    """periodicity_strength, dominant_frequency and spectral_entropy per flow of a series with positions 1..n."""
    keys = list(key)
    kinds = dict(series.dtypes)
    short, long = split_by_size(series.select(*keys, pos, value), keys, value, limit, [pos])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(pos)[value].to_numpy(dtype=float)
        s, d, e = _spectrum(x)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "periodicity_strength": [s], "dominant_frequency": [d], "spectral_entropy": [e]})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", periodicity_strength double, dominant_frequency double, spectral_entropy double"
    out = by_key(short, keys).groupBy(*keys).applyInPandas(one, schema)
    return out if long is None else out.unionByName(_long_spectrum(long, keys, pos, value))


def _matches(q: np.ndarray, d: np.ndarray, r: float, weight: np.ndarray | None = None) -> np.ndarray:
    """For each row of ``q`` the weight of the rows of ``d`` within ``r`` in every coordinate; few rows directly, many by range counting."""
    if len(q) * len(d) > DIRECT_PAIRS:
        return within(q, d, r, weight)
    near = (np.abs(q[:, None, :] - d[None, :, :]) <= r).all(axis=2)
    return near.sum(axis=1) if weight is None else near @ weight.astype(float)


def _templates(x: np.ndarray, m: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)


def _long_phi(long: DataFrame, key: Sequence[str], pos: str, value: str, m: int, factor: float, eps: float, rows: int) -> DataFrame:
    """Mean log match fraction per flow. Equal templates are one with a weight. Templates fall into slices of width r;
    each query meets the data of three slices, in groups of at most about rows x rows, which are range counted."""
    keys = list(key)
    ahead = with_look_back(long.withColumn("rn", F.col(pos)), keys, m - 1)
    w = block_window(keys)
    last = m - 1
    coords = [F.lag(value, last - i).over(w) if i < last else F.col(value) for i in range(m)]
    t = ahead.withColumn("_t", F.array(*coords)).where(~F.col("_ghost") & (F.col("rn") >= m))
    t = t.select(*keys, F.col("rn").alias("i"), "_t", (F.col("_sd") * factor).alias("r"), (F.col("_n") - last).alias("total"))
    t = t.groupBy(*keys, "_t", "r", "total").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("w"))
    t = t.withColumn("slice", F.floor(F.element_at("_t", 1) / F.col("r")).cast("long"))
    data = t.select(*keys, F.explode(F.sequence(F.col("slice") - 1, F.col("slice") + 1)).alias("slice"), F.col("i").alias("di"), "_t", "w")

    def pieces(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*keys, "slice").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    plan = pieces(t, "nq").join(pieces(data, "nd"), [*keys, "slice"])
    q = join_group_stats(t, plan, [*keys, "slice"], ["i"])
    d = join_group_stats(data, plan, [*keys, "slice"], ["di"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.select(*keys, "slice", F.pmod(F.xxhash64("i"), F.col("nq")).cast("int").alias("pq"), every("nd").alias("pd"), "i", "_t", "w", "r", "total", F.lit(True).alias("isq"))
    d = d.select(*keys, "slice", every("nq").alias("pq"), F.pmod(F.xxhash64("di"), F.col("nd")).cast("int").alias("pd"), F.col("di").alias("i"), "_t", "w",
                 F.lit(0.0).alias("r"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("isq"))
    kinds = dict(long.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", i bigint, w bigint, total bigint, n bigint"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["isq"]], pdf[~pdf["isq"]]
        if ask.empty or have.empty:
            return pd.DataFrame({**{k: pdf[k].iloc[:0] for k in keys}, **{c: pd.Series([], dtype="int64") for c in ("i", "w", "total", "n")}})
        n = _matches(np.vstack(ask["_t"].to_numpy()), np.vstack(have["_t"].to_numpy()), float(ask["r"].iloc[0]), have["w"].to_numpy())
        return pd.DataFrame({**{k: ask[k].to_numpy() for k in keys}, **{c: ask[c].to_numpy() for c in ("i", "w", "total")}, "n": n.astype(np.int64)})

    parts = [*keys, "slice", "pq", "pd"]
    found = by_key(q.unionByName(d), parts).groupBy(*parts).applyInPandas(count, schema)
    per = found.groupBy(*keys, "i").agg((F.sum("n") / F.first("total")).alias("c"), F.first("w").alias("w"))
    return per.groupBy(*keys).agg((F.sum(F.log(F.col("c") + F.lit(eps)) * F.col("w")) / F.sum("w")).alias(f"phi{m}"))


def approximate_entropy(
    series: DataFrame, key: Sequence[str], pos: str, value: str, m: int = 2, factor: float = 0.2, eps: float = 0.0,
    absolute: bool = False, least: int = MIN_GAPS, limit: int = MATCH_ROWS, name: str = "approximate_entropy",
) -> DataFrame:
    """Approximate entropy phi(m) - phi(m+1) per flow, tolerance ``factor`` * std(population);
    0 below ``least`` values. Negative results become 0, or their amount with ``absolute``."""
    keys = list(key)
    kinds = dict(series.dtypes)
    short, long = split_by_size(series.select(*keys, pos, value), keys, value, limit, [pos])

    def finish(v: float) -> float:
        return abs(v) if absolute else max(0.0, v)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(pos)[value].to_numpy(dtype=float)
        v = 0.0
        if len(x) >= max(least, m + 1):
            r = factor * x.std()
            phi = []
            for d in (m, m + 1):
                t = _templates(x, d)
                phi.append(float(np.log(_matches(t, t, r) / len(t) + eps).mean()))
            v = finish(phi[0] - phi[1])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, name: [v]})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{name}` double"
    out = by_key(short, keys).groupBy(*keys).applyInPandas(one, schema)
    if long is None:
        return out
    flat = long.where(F.col("_sd") == 0).select(*keys).distinct().withColumn(name, F.lit(0.0))
    moving = long.where(F.col("_sd") > 0)
    phis = [_long_phi(moving, keys, pos, value, d, factor, eps, limit) for d in (m, m + 1)]
    diff = F.col(f"phi{m}") - F.col(f"phi{m + 1}")
    both = phis[0].join(phis[1], keys).select(*keys, (F.abs(diff) if absolute else F.greatest(diff, F.lit(0.0))).alias(name))
    return out.unionByName(both).unionByName(flat)
