"""TLS handshake and payload features.

Handshakes come in long form (a row per suite, certificate, extension or
packet), so a flow of any size stays spread over tasks; ``F.explode`` turns
nested records into that form.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsieve.functions.columns import EPS, equal_width_bin
from flowsieve.operators.flows import value_entropy, zero
from flowsieve.operators.ordering import attach_row, index_rows, join_heavy_stats, spread_small
from flowsieve.session import materialize

# Key length by cipher name, names of weak ciphers, key exchanges with forward secrecy.
CIPHER_BITS = [("AES_256", 256), ("AES_128", 128), ("CHACHA20", 256), ("RC4", 128), ("3DES", 112)]
WEAK_CIPHERS = ["RC4", "DES", "3DES", "MD5", "SHA1_ONLY"]
FORWARD_SECRECY = ["DHE", "ECDHE", "ECDH_ANON"]
WEAK_BITS, DEFAULT_BITS = 64, 128
ENTROPY_NAMES = ["cipher_suite_entropy", "certificate_entropy", "extension_entropy"]


def array_entropy(df: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """Entropy of the elements of an array column, per key."""
    long = df.select(key, F.explode(values).alias("_x"))
    return value_entropy(long, [key], {name: "_x"})


def certificate_entropy(
    certs: DataFrame, key: Sequence[str], numbers: Sequence[str], bins: int = 10
) -> DataFrame:
    """Entropy of the density histogram of all z-normalised certificate numbers of a flow; may be negative.

    The bins of the z-scores are the bins of the raw numbers, so only the bin
    width is rescaled. Equal numbers fall in one bin of width 0.1. A certificate travels as one row with
    its numbers, and a flow's bins are counted as columns, so a flow is one row of each aggregate.
    """
    key = list(key)
    certs = certs.select(*key, F.array(*[F.col(c).cast("double") for c in numbers]).alias("_x"))
    stats = certs.select(*key, F.explode("_x").alias("x")).groupBy(*key).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("sd"), F.count("x").alias("total")
    )
    rows = join_heavy_stats(certs, stats, key, "total")
    cells = rows.select(*key, "lo", "hi", "sd", "total", F.explode("_x").alias("x"))
    cells = cells.withColumn("bin", F.coalesce(equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), bins), F.lit(0)))  # 0: no number
    per = cells.groupBy(*key).agg(
        *[F.count_if(F.col("bin") == b).alias(f"_n{b}") for b in range(bins + 1)], *[F.first(c).alias(c) for c in ("lo", "hi", "sd", "total")])
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("sd") / bins).otherwise(F.lit(1.0 / bins))
    entropy = F.lit(0.0)
    for b in range(bins + 1):
        d = F.col(f"_n{b}") / F.col("total") / width
        entropy = entropy + F.when(F.col(f"_n{b}") > 0, d * F.log2(d + F.lit(EPS))).otherwise(F.lit(0.0))
    return per.select(*key, (-entropy).alias("certificate_entropy"))


def handshake_timing(packets: DataFrame, key: Sequence[str], t: str = "ts", size: str = "size") -> DataFrame:
    """Duration, bytes and packet count of a handshake."""
    n = F.count(F.lit(1))
    return packets.groupBy(*key).agg(
        F.when(n >= 2, F.max(t) - F.min(t)).otherwise(F.lit(0.0)).alias("handshake_duration"),
        F.sum(size).alias("handshake_bytes"), n.alias("chain_length"),
    )


def rtt_variance(packets: DataFrame, key: Sequence[str], order: Sequence[str] = ("ts", "pkt_id"),
                 client: str = "client_to_server", server: str = "server_to_client") -> DataFrame:
    """Variance of the positive gaps between the i-th client and the i-th server packet."""
    key = list(key)
    t = order[0]
    i = index_rows(packets.where(F.col("direction").isin(client, server)), [*key, "direction"], order, name="_i")
    ask, answer = F.col("direction") == client, F.col("direction") == server
    pairs = i.groupBy(*key, "_i").agg(
        F.max(F.when(ask, F.col(t))).alias("c"), F.max(F.when(answer, F.col(t))).alias("s")
    )
    gap = F.when(F.col("s") > F.col("c"), F.col("s") - F.col("c"))
    per = pairs.groupBy(*key).agg(
        F.var_pop(gap).alias("v"), F.count(gap).alias("gaps"), F.count("c").alias("asks"), F.count("s").alias("answers")
    )
    ok = (F.col("asks") + F.col("answers") >= 4) & (F.col("asks") >= 2) & (F.col("answers") >= 2) & (F.col("gaps") > 1)
    return per.select(*key, F.when(ok, F.col("v")).otherwise(F.lit(0.0)).alias("rtt_variance"))


def cipher_strength(suite: str | Column, rc4_as_weak: bool = True) -> Column:
    """Key length in bits of the first known cipher name in the suite; names match in any case."""
    raw = F.col(suite) if isinstance(suite, str) else suite
    s = F.upper(raw)
    out = F.when(raw.isNull() | (raw == ""), 0)
    for name, bits in CIPHER_BITS:
        out = out.when(s.contains(name), WEAK_BITS if rc4_as_weak and name == "RC4" else bits)
    for name in WEAK_CIPHERS:
        out = out.when(s.contains(name), WEAK_BITS)
    return out.otherwise(DEFAULT_BITS)


def forward_secrecy(exchange: str | Column) -> Column:
    x = F.upper(F.col(exchange) if isinstance(exchange, str) else exchange)
    found = F.lit(False)
    for name in FORWARD_SECRECY:
        found = found | x.contains(name)
    return F.coalesce(found, F.lit(False))


def anomaly_scores(features: DataFrame) -> DataFrame:
    """Sum of |z| of the three entropies, + 2 for a weak cipher, + 1 without forward secrecy."""
    features = materialize(features, "handshakes")  # read for the statistics and for the scores
    stats = features.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ENTROPY_NAMES], *[F.stddev_pop(c).alias(f"s_{c}") for c in ENTROPY_NAMES]
    )
    score = F.lit(0.0)
    for c in ENTROPY_NAMES:
        std = F.col(f"_s.s_{c}")
        score = score + F.when(std > 0, F.abs((F.col(c) - F.col(f"_s.m_{c}")) / std)).otherwise(F.lit(0.0))
    score = score + F.when(F.col("cipher_strength") < 128, F.lit(2.0)).otherwise(F.lit(0.0))
    score = score + F.when(F.col("perfect_forward_secrecy"), F.lit(0.0)).otherwise(F.lit(1.0))
    return attach_row(features, stats).withColumn("anomaly_score", score).drop("_s")


def tls_anomalies(features: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Flows whose score exceeds ``threshold``, with their features as details."""
    details = F.struct(*[F.col(c) for c in features.columns])
    return anomaly_scores(features).where(F.col("anomaly_score") > threshold).withColumn("details", details)


def byte_counts(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, byte, n): byte histogram per key. Each Arrow batch is reduced to at most
    256 counts per key before anything is shuffled."""
    kind = dict(payloads.dtypes)[key]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            acc: dict = {}
            for k, raw in zip(pdf[key], pdf[payload]):
                if raw:
                    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
                    acc[k] = acc[k] + c if k in acc else c
            for k, c in acc.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({key: [k] * len(at), "byte": at.astype("int32"), "n": c[at].astype("int64")})

    part = spread_small(payloads.select(key, payload)).mapInPandas(count, f"`{key}` {kind}, byte int, n bigint")
    return part.groupBy(key, "byte").agg(F.sum("n").alias("n"))


def payload_entropy(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Byte entropy and randomness 1 / (1 + chi2 / 1000) over all payloads of a key; randomness 0 below 100 bytes."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    expected = total / 256
    # sum over 256 cells of (n - e)^2 / e, with absent bytes counting e each
    chi = F.sum(n * n) / expected - total
    return byte_counts(payloads, key, payload).groupBy(key).agg(
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("byte_entropy"),
        F.when(total >= 100, 1.0 / (1.0 + chi / 1000)).otherwise(F.lit(0.0)).alias("randomness"),
        total.cast("long").alias("total_bytes"),
    )


def payload_sizes(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Entropy, mean and variance of payload sizes."""
    sized = payloads.select(key, F.octet_length(payload).alias("bytes"))
    stats = sized.groupBy(key).agg(F.avg("bytes").alias("size_mean"), F.var_pop("bytes").alias("size_variance"))
    return stats.join(value_entropy(sized, [key], {"size_entropy": "bytes"}), key)


GRAMS = (2, 4, 8)


def _regularity(raw: bytes) -> float | None:
    if raw is None or len(raw) < 16:
        return None
    b = np.frombuffer(raw, dtype=np.uint8)
    score = 0.0
    for g in GRAMS:
        windows = np.lib.stride_tricks.sliding_window_view(b, g).astype(np.uint64)
        code = windows @ (np.uint64(256) ** np.arange(g, dtype=np.uint64))
        code.sort()
        edges = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
        score += int(np.diff(edges).max()) / len(b)
    return score


@F.pandas_udf(T.DoubleType())
def pattern_score(payload: pd.Series) -> pd.Series:
    """Highest count of an n-gram over the length, summed over n = 2, 4, 8; NULL below 16 bytes."""
    return pd.Series([_regularity(p) for p in payload], dtype="float64")


def pattern_regularity(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    scored = spread_small(payloads.select(key, payload)).select(key, pattern_score(payload).alias("s"))
    return scored.groupBy(key).agg(zero(F.avg("s")).alias("pattern_regularity"))


def flow_attributes(packets: DataFrame, key: Sequence[str], texts: Sequence[str], order: Sequence[str], cert: str) -> DataFrame:
    """First non-NULL text per flow (``unknown`` without one) and its certificates with a size above 0."""
    when = F.struct(*order)
    picks = [
        F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), when)), F.lit("unknown")).alias(c) for c in texts
    ]
    return packets.groupBy(*key).agg(
        *picks, F.count_if(F.col(cert) > 0).alias("n_certificates"),
        F.coalesce(F.sum(F.when(F.col(cert) > 0, F.col(cert))), F.lit(0)).alias("certificate_bytes"),
    )
