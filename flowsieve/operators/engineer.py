"""Feature engineering on a flow table (one row per flow).

Quantile-based flags are fitted once: ``fit_flags`` gives a one-row frame of
limits which ``apply_flags`` uses on any table, so new flows are judged by the
limits of the training flows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.functions.columns import EPS, total
from flowsieve.operators.clean import numeric_columns
from flowsieve.operators.flows import with_percentile_ranks
from flowsieve.operators.ordering import attach_row, column_quantiles, prob_name
from flowsieve.operators.scale import apply_scaler, fit_scaler

# Column pairs with a ratio, name parts of column groups, limits of the signatures.
RATIO_PAIRS = [
    ("pktSizeMean", "pktSizeStd"), ("fwdPktCount", "bwdPktCount"), ("iatMean", "iatStd"),
    ("totalBytes", "pktCount"), ("flowDuration", "pktCount"),
]
COLUMN_GROUPS = {"pktSize": ["pktsize", "packetsize"], "iat": ["iat"], "flow": ["flow"], "entropy": ["entropy"]}
FLAG_QUANTILES = {
    "pktsPerSec": [0.95], "pktCount": [0.5, 0.9], "totalBytes": [0.9], "flowDuration": [0.8],
    "pktSizeMean": [0.05, 0.95], "iatMean": [0.05, 0.95], "protocolEntropy": [0.9],
    "activityIntensity": [0.9], "payloadSizeEntropy": [0.75],
}
PORT_LIMIT, RATIO_LIMIT = 10, 2
VERSION_POINTS = {"tlsV1_3": 4, "tlsV1_2": 3, "tlsV1_1": 2, "tlsV1_0": 1}
CIPHER_FLAGS = ["hasAES", "hasGCM", "hasECDHE"]
TOP_INPUTS, TOP_OUTPUTS = 20, 100


def ratio_features(df: DataFrame, pairs: Sequence[tuple[str, str]] = RATIO_PAIRS) -> DataFrame:
    """a / (b + eps) per pair; 0 where the whole column b is (almost) zero."""
    pairs = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    sums = df.agg(*[F.sum(F.abs(F.col(b))).alias(b) for b in sorted({b for _, b in pairs})])
    out = attach_row(df, sums, "_sum")
    made = {}
    for a, b in pairs:
        r = F.when(F.col(f"_sum.{b}") > 1e-6, F.col(a) / (F.col(b) + EPS)).otherwise(F.lit(0.0))
        made[f"ratio_{a}_{b}"] = F.coalesce(r, F.lit(0.0))
    return out.withColumns(made).drop("_sum")


def binned_features(df: DataFrame, columns: Sequence[str], bins: int = 5) -> DataFrame:
    """Quantile bins, right-closed, equal edges merged; a constant column sits in the
    middle of equal-width bins and NULL in bin 0."""
    probs = [i / bins for i in range(bins + 1)]
    out = attach_row(df, column_quantiles(df, columns, probs), "_q")
    made = {}
    for c in columns:
        edges = [F.col(f"_q.{c}_{prob_name(p)}") for p in probs]
        x = F.col(c).cast("double")
        low, high = edges[0], edges[-1]
        below = F.size(F.array_distinct(F.filter(F.array(*edges[1:-1]), lambda e: (e > low) & (e < x))))
        made[f"bin_{c}"] = F.when(x.isNull(), 0).when(low == high, bins // 2).otherwise(below)
    return out.withColumns(made).drop("_q")


def group_aggregates(df: DataFrame, groups: Mapping[str, Sequence[str]] = COLUMN_GROUPS) -> DataFrame:
    """Row-wise mean, max and min over the columns whose name holds a group's words."""
    made = {}
    numeric = numeric_columns(df)
    for name, words in groups.items():
        cols = [F.col(c).cast("double") for c in numeric if any(w in c.lower() for w in words)]
        if not cols:
            made.update({f"{name}_{k}": F.lit(0.0) for k in ("mean", "max", "min")})
            continue
        present = total([c.isNotNull().cast("int") for c in cols])
        mean = total([F.coalesce(c, F.lit(0.0)) for c in cols]) / F.when(present > 0, present)
        high = F.greatest(*cols) if len(cols) > 1 else cols[0]
        low = F.least(*cols) if len(cols) > 1 else cols[0]
        made.update({f"{name}_mean": F.coalesce(mean, F.lit(0.0)), f"{name}_max": F.coalesce(high, F.lit(0.0)),
                     f"{name}_min": F.coalesce(low, F.lit(0.0))})
    return df.withColumns(made)


def fit_flags(df: DataFrame, quantiles: Mapping[str, Sequence[float]] = FLAG_QUANTILES) -> DataFrame:
    """One row of the limits the flags need, from one pass over the table."""
    have = {c: p for c, p in quantiles.items() if c in df.columns}
    probs = sorted({p for ps in have.values() for p in ps})
    row = column_quantiles(df, list(have), probs)
    return row.select(*[f"{c}_{prob_name(p)}" for c, ps in have.items() for p in ps])


def _limit(c: str, p: float) -> Column:
    return F.col(f"_lim.{c}_{prob_name(p)}")


def _flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0))


def attack_flags() -> dict[str, tuple[list[str], Column]]:
    c = F.col
    return {
        "portScanSignature": (["uniquePorts"], _flag(c("uniquePorts") > PORT_LIMIT)),
        "ddosSignature": (["pktsPerSec", "pktCount"], _flag(
            (c("pktsPerSec") > _limit("pktsPerSec", 0.95)) & (c("pktCount") > _limit("pktCount", 0.9)))),
        "exfiltrationSignature": (["totalBytes", "flowDuration"], _flag(
            (c("totalBytes") > _limit("totalBytes", 0.9)) & (c("flowDuration") > _limit("flowDuration", 0.8)))),
        "bruteForceSignature": (["fwdBwdRatio", "pktCount"], _flag(
            (c("fwdBwdRatio") > RATIO_LIMIT) & (c("pktCount") > _limit("pktCount", 0.5)))),
    }


def protocol_flags() -> dict[str, tuple[list[str], Column]]:
    c = F.col

    def outside(name: str) -> Column:
        return _flag((c(name) < _limit(name, 0.05)) | (c(name) > _limit(name, 0.95)))

    return {
        "unusualPktSize": (["pktSizeMean"], outside("pktSizeMean")),
        "unusualIAT": (["iatMean"], outside("iatMean")),
        "protocolEntropyAnomaly": (["protocolEntropy"], _flag(c("protocolEntropy") > _limit("protocolEntropy", 0.9))),
    }


def timing_flags() -> dict[str, tuple[list[str], Column]]:
    c = F.col
    return {
        "timingRegularity": (["iatStd", "iatMean"], F.coalesce(c("iatStd") / (c("iatMean") + EPS), F.lit(0.0))),
        "burstIntensity": (["burstCount", "flowDuration"], F.coalesce(c("burstCount") / (c("flowDuration") + EPS), F.lit(0.0))),
        "activityConcentration": (["activityIntensity"], _flag(c("activityIntensity") > _limit("activityIntensity", 0.9))),
    }


def encryption_flags() -> dict[str, tuple[list[str], Column]]:
    c = F.col
    return {
        "tlsVersionScore": (list(VERSION_POINTS), total([c(n) * p for n, p in VERSION_POINTS.items()])),
        "cipherStrength": (CIPHER_FLAGS, total([c(n) for n in CIPHER_FLAGS])),
        "handshakeCompleteness": (["clientHelloCount", "serverHelloCount"], _flag((c("clientHelloCount") > 0) & (c("serverHelloCount") > 0))),
        "highEntropyPayload": (["payloadSizeEntropy"], _flag(c("payloadSizeEntropy") > _limit("payloadSizeEntropy", 0.75))),
    }


FAMILIES = {"attack": attack_flags, "protocol": protocol_flags, "timing": timing_flags, "encryption": encryption_flags}


def apply_flags(df: DataFrame, limits: DataFrame, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    """Add the flags whose columns are present."""
    made = {}
    for f in families:
        for name, (needs, value) in FAMILIES[f]().items():
            if all(n in df.columns for n in needs):
                made[name] = value
    return attach_row(df, limits, "_lim").withColumns(made).drop("_lim")


def fit_interactions(df: DataFrame, columns: Sequence[str], inputs: int = TOP_INPUTS, outputs: int = TOP_OUTPUTS) -> list[tuple[str, str]]:
    """Pairs to multiply: among the ``inputs`` columns of highest variance, the
    ``outputs`` products of highest variance. Two one-row aggregates reach the driver."""
    var = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    top = sorted(columns, key=lambda c: -(var[c] or 0.0))[:inputs]
    pairs = list(combinations(top, 2))
    spread = df.agg(*[F.var_samp(F.col(a) * F.col(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)]).first()
    ranked = sorted(range(len(pairs)), key=lambda i: -(spread[i] or 0.0))[:outputs]
    return [pairs[i] for i in ranked]


def apply_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


@dataclass
class Engineered:
    """What was learned from the training flows."""

    limits: DataFrame
    pairs: list[tuple[str, str]]
    columns: list[str]
    scaler: DataFrame
    kind: str
    key: list[str] = field(default_factory=list)


def _derive(df: DataFrame, limits: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    out = apply_flags(ratio_features(group_aggregates(df)), limits)
    return apply_interactions(out, pairs)


def fit_engineer(df: DataFrame, key: Sequence[str], kind: str = "standard", inputs: int = TOP_INPUTS, outputs: int = TOP_OUTPUTS) -> Engineered:
    """Learn limits, interaction pairs and scaling from training flows."""
    base = [c for c in numeric_columns(df) if c not in key]
    limits = fit_flags(df)
    pairs = fit_interactions(df, base, inputs, outputs)
    made = _derive(df, limits, pairs)
    columns = [c for c in numeric_columns(made) if c not in key]
    return Engineered(limits, pairs, columns, fit_scaler(made, columns, kind), kind, list(key))


def engineer(df: DataFrame, fitted: Engineered) -> DataFrame:
    """Derived and scaled features of any flow table; what is not finite becomes 0."""
    made = _derive(df, fitted.limits, fitted.pairs)
    scaled = apply_scaler(made.select(*fitted.key, *fitted.columns), fitted.scaler, fitted.columns, fitted.kind)
    finite = {
        c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
        for c in fitted.columns
    }
    return scaled.withColumns(finite)


def simple_features(df: DataFrame, key: str, columns: Sequence[str], burst: float = 0.75, high: float = 0.9, low: float = 0.1, ranked: int = 3) -> DataFrame:
    """Config-driven set: burst flag and ratio, first ratio, ranks, high and low flags."""
    first = columns[0]
    limits = column_quantiles(df, [first], [low, burst, high])
    size = df.agg(F.count(F.lit(1)).alias("n"))
    out = attach_row(attach_row(df, limits, "_q"), size, "_n")
    x = F.col(first)
    q = lambda p: F.col(f"_q.{first}_{prob_name(p)}")
    flag = (x > q(burst)).cast("int")
    out = out.withColumns({
        "burst_count": flag, "burst_ratio": flag / F.col("_n.n"), f"ratio_{first}_{columns[1]}": x / (F.col(columns[1]) + EPS),
        "high_activity": (x > q(high)).cast("int"), "low_activity": (x < q(low)).cast("int"),
    }).drop("_q", "_n")
    names = {c: f"rank_{c}" for c in columns[:ranked]}
    # a row needs a key and one of the ranked values
    kept = out.where(F.col(key).isNotNull() & F.coalesce(*[F.col(c).cast("double") for c in names]).isNotNull())
    return with_percentile_ranks(kept, names, [key])
