"""Packets to flows: one wide row per flow key, from native aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.functions.columns import EPS, MIN_DURATION
from flowsieve.operators.ordering import (
    FEW_KEYS, block_window, group_quantiles, index_rows, join_group_stats, join_heavy_stats, match_keys, melt,
    running_totals, with_look_back, with_previous,
)
from flowsieve.session import materialize

# The names counted per flow.
PROTOCOLS = ["TCP", "UDP", "ICMP", "TLS", "HTTPS"]
TCP_FLAGS = ["SYN", "ACK", "FIN", "RST"]
TLS_VERSIONS = {"tlsV1_0": "TLSv1.0", "tlsV1_1": "TLSv1.1", "tlsV1_2": "TLSv1.2", "tlsV1_3": "TLSv1.3"}
HANDSHAKE_TYPES = {
    "clientHelloCount": "ClientHello", "serverHelloCount": "ServerHello",
    "certificateCount": "Certificate", "keyExchangeCount": "KeyExchange",
}
CIPHER_WORDS = {"hasAES": "AES", "hasGCM": "GCM", "hasECDHE": "ECDHE"}

ORDER = ("t", "pkt_id")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def with_iat(packets: DataFrame, key: Sequence[str] = ("flow_id",), order: Sequence[str] = ORDER) -> DataFrame:
    """Add ``iat``: seconds since the packet before it in the flow, NULL for the first."""
    t = order[0]
    return with_previous(packets, key, order, [t]).withColumn("iat", F.col(t) - F.col(f"prev_{t}")).drop(f"prev_{t}")


# -- aggregate lists: combine any of them in one groupBy -------------------------------------------

def basic_aggs(t: str = "t", size: str = "size") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pktCount"), F.sum(size).alias("totalBytes"), (F.max(t) - F.min(t)).alias("flowDuration"),
        F.avg(size).alias("pktSizeMean"), zero(F.stddev_pop(size)).alias("pktSizeStd"),
        zero(F.avg("iat")).alias("iatMean"), zero(F.stddev_pop("iat")).alias("iatStd"),
    ]


def size_aggs(size: str = "size") -> list[Column]:
    return [
        F.avg(size).alias("sizeMean"), zero(F.stddev_samp(size)).alias("sizeStd"), F.min(size).alias("sizeMin"),
        F.max(size).alias("sizeMax"), zero(F.var_samp(size)).alias("sizeVar"),
    ]


def iat_aggs() -> list[Column]:
    return [
        zero(F.avg("iat")).alias("iatMean"), zero(F.stddev_samp("iat")).alias("iatStd"),
        zero(F.min("iat")).alias("iatMin"), zero(F.max("iat")).alias("iatMax"),
    ]


def direction_aggs() -> list[Column]:
    return [
        F.count_if(F.col("direction") == "forward").alias("fwdPktCount"),
        F.count_if(F.col("direction") == "backward").alias("bwdPktCount"),
    ]


def rate_aggs(t: str = "t", size: str = "size") -> list[Column]:
    seconds = F.greatest(F.max(t) - F.min(t), F.lit(MIN_DURATION))
    return [
        F.sum(size).alias("totalBytes"), (F.sum(size) / seconds).alias("bytesPerSec"),
        (F.count(F.lit(1)) / seconds).alias("pktsPerSec"),
    ]


def protocol_aggs() -> list[Column]:
    return [F.count_if(F.col("protocol") == p).alias(f"proto_{p}") for p in PROTOCOLS]


def flag_aggs() -> list[Column]:
    return [F.count_if(F.col("flags").contains(f)).alias(f"flag_{f}") for f in TCP_FLAGS]


def tls_aggs() -> list[Column]:
    return [
        *[F.count_if(F.col("tls_version") == v).alias(n) for n, v in TLS_VERSIONS.items()],
        *[F.count_if(F.col("handshake_type") == v).alias(n) for n, v in HANDSHAKE_TYPES.items()],
        zero(F.avg("cert_length")).alias("certLengthMean"), zero(F.max("cert_length").cast("double")).alias("certLengthMax"),
        F.count("cert_length").alias("certCount"),
        *[
            F.coalesce(F.max(F.col("cipher_suite").contains(w).cast("int")), F.lit(0)).alias(n)
            for n, w in CIPHER_WORDS.items()
        ],
    ]


def moment_aggs(value: str, prefix: str) -> list[Column]:
    """Biased skew and excess kurtosis, and std(sample) / (mean + eps)."""
    return [
        zero(F.skewness(value)).alias(f"{prefix}Skew"), zero(F.kurtosis(value)).alias(f"{prefix}Kurtosis"),
        zero(F.stddev_samp(value) / (F.avg(value) + EPS)).alias(f"{prefix}CV"),
    ]


def first_of_name(aggs: Sequence[Column]) -> list[Column]:
    """Keep the first aggregate of each output name."""
    seen: dict[str, Column] = {}
    for e in aggs:
        seen.setdefault(str(e).rsplit(" AS ", 1)[-1].rstrip("'>"), e)
    return list(seen.values())


# -- operators -----------------------------------------------------------------------------------

def packets_to_flows(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    return with_iat(packets, key).groupBy(*key).agg(*basic_aggs())


def tls_port_features(packets: DataFrame, key: Sequence[str] = ("flow_id",), port: int = 443) -> DataFrame:
    """Packet count, size mean, size std and size entropy of the TLS packets of a flow."""
    tls = packets.where((F.col("dst_port") == port) | F.col("protocol").isin("TLS", "HTTPS"))
    stats = tls.groupBy(*key).agg(
        F.count(F.lit(1)).alias("tlsPktCount"), F.avg("size").alias("tlsSizeMean"),
        zero(F.stddev_pop("size")).alias("tlsSizeStd"),
    )
    return match_keys(stats, value_entropy(tls, key, {"tlsSizeEntropy": "size"}), key)


def flow_profile(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Every feature that needs no quantile. One pass for the aggregates over ordered
    packets, one over pre-counted values for entropies and distinct counts."""
    p = with_previous(packets, key, ORDER, ["t", "direction"])
    p = p.withColumn("iat", F.col("t") - F.col("prev_t"))
    aggs = [
        *basic_aggs(), *direction_aggs(), *rate_aggs(), *protocol_aggs(), *flag_aggs(), *tls_aggs(),
        *moment_aggs("size", "size"), *moment_aggs("iat", "iat"),
        F.count_if(~F.col("direction").eqNullSafe(F.col("prev_direction"))).alias("directionChanges"),
    ]
    out = p.groupBy(*key).agg(*first_of_name(aggs))
    out = out.withColumn("fwdBwdRatio", F.col("fwdPktCount") / F.greatest(F.col("bwdPktCount"), F.lit(1)))
    values = value_entropy(
        packets, key, {"protocolEntropy": "protocol", "payloadSizeEntropy": "size"},
        distinct={"uniquePorts": "dst_port", "uniqueCiphers": "cipher_suite"},
    )
    return match_keys(out, values, list(key))


def value_entropy(
    df: DataFrame, key: Sequence[str], values: Mapping[str, str], eps: float = 0.0, normalized: bool = False,
    distinct: Mapping[str, str] | None = None, apart: bool = False,
) -> DataFrame:
    """Shannon entropy in bits of each column in ``values`` (output name -> column).

    With ``eps`` the form is ``-sum p*log2(p+eps)``; ``normalized`` adds ``<name>Norm``,
    the entropy over log2(distinct values + eps); ``distinct`` adds distinct counts of
    further columns. Values are counted per (key, value) before anything is gathered per key. ``apart`` counts each column
    in a pass of its own, for tables that are cheap to read: a task then holds the counts of one column.
    """
    distinct = dict(distinct or {})
    columns = {**values, **distinct}
    if apart:
        counts = reduce(lambda a, b: a.unionByName(b), [_value_counts(df, key, {i: c}) for i, c in enumerate(columns.values())])
    else:
        counts = _value_counts(df, key, dict(enumerate(columns.values())), [] if not eps else ["num", "txt"])
    group = [*key, "feature"]
    if eps:
        totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
        spread = [c for c in ("num", "txt") if c in counts.columns]
        counts = join_group_stats(counts, totals, group, spread)
    picks = []
    top = lambda i: F.log2(F.count_if(F.col("feature") == i) + F.lit(EPS))
    for i, name in enumerate(columns):
        mine = F.col("feature") == i
        if name in distinct:
            picks.append(F.count_if(mine).alias(name))
            continue
        n = F.when(mine, F.col("n").cast("double"))
        p = F.when(mine, F.col("n") / F.col("total")) if eps else None
        h = -F.sum(p * F.log2(p + F.lit(eps))) if eps else F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
        picks.append(zero(h).alias(name))
        if normalized:
            picks.append(zero(F.when(top(i) > 0, h / top(i)).otherwise(F.when(F.count_if(mine) > 0, F.lit(0.0)))).alias(f"{name}Norm"))
    return counts.groupBy(*key).agg(*picks) if key else counts.agg(*picks)


def _value_counts(df: DataFrame, key: Sequence[str], columns: Mapping[int, str], keep: Sequence[str] = ()) -> DataFrame:
    """(key, feature, n, and those of num and txt in ``keep``): rows of each value, texts and numbers in a column each, those only that are needed."""
    types = dict(df.dtypes)
    text = {i: types[c] in ("string", "binary", "boolean") for i, c in columns.items()}
    cells = {"num": lambda i: F.lit(None).cast("double") if text[i] else F.col(columns[i]).cast("double"),
             "txt": lambda i: F.col(columns[i]).cast("string") if text[i] else F.lit(None).cast("string")}
    held = [c for c in cells if (c == "txt") in text.values()]
    if len(columns) == 1:
        [i] = columns
        long = df.select(*key, cells[held[0]](i).alias(held[0]))
        counts = long.where(F.col(held[0]).isNotNull()).groupBy(*key, held[0]).agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit(i))
    else:
        parts = [F.struct(F.lit(i).alias("feature"), *[cells[c](i).alias(c) for c in held]) for i in columns]
        long = df.select(*key, F.explode(F.array(*parts)).alias("_e")).select(*key, "_e.*")
        counts = long.where(F.coalesce(*[F.col(c).cast("string") for c in held]).isNotNull()).groupBy(*key, "feature", *held).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*key, "feature", *[c for c in held if c in keep], "n")


def tls_features(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """TLS versions, handshake types, certificates and ciphers per flow."""
    return packets.groupBy(*key).agg(*tls_aggs(), F.count_distinct("cipher_suite").alias("uniqueCiphers"))


def size_moments(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Moments of size and IAT with size quartiles."""
    p = with_iat(packets, key)
    moments = p.groupBy(*key).agg(*moment_aggs("size", "size"), *moment_aggs("iat", "iat"))
    q = group_quantiles(packets, key, "size", [0.25, 0.5, 0.75, 0.9]).withColumn("sizeIQR", F.col("p75") - F.col("p25"))
    renamed = q.select(*key, *[F.col(f"p{n}").alias(f"sizeP{n}") for n in (25, 50, 75, 90)], "sizeIQR")
    return match_keys(moments, renamed, key)


def connection_diversity(df: DataFrame, key: Sequence[str] = ("flow_id",), approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    out = df.groupBy(*key).agg(distinct("src_ip").alias("uniqueSrcIPs"), distinct("dst_ip").alias("uniqueDstIPs"))
    return out.withColumn("ipDiversity", F.col("uniqueSrcIPs") + F.col("uniqueDstIPs"))


def port_scan(df: DataFrame, key: Sequence[str] = ("flow_id",), limit: int = 10) -> DataFrame:
    out = df.groupBy(*key).agg(
        F.count_distinct("dst_port").alias("uniquePorts"), (F.max("dst_port") - F.min("dst_port")).alias("portRange")
    )
    return out.withColumn("portScanIndicator", (F.col("uniquePorts") > limit).cast("int"))


def direction_pattern(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Forward to backward ratio and direction changes (the first packet counts as one)."""
    p = with_previous(packets, key, ORDER, ["direction"])
    out = p.groupBy(*key).agg(
        *direction_aggs(), F.count_if(~F.col("direction").eqNullSafe(F.col("prev_direction"))).alias("directionChanges")
    )
    return out.withColumn("fwdBwdRatio", F.col("fwdPktCount") / F.greatest(F.col("bwdPktCount"), F.lit(1)))


def payload_variation(packets: DataFrame, key: Sequence[str] = ("flow_id",), size: str = "size",
                      spread: Sequence[str] = ("pkt_id",)) -> DataFrame:
    q = group_quantiles(packets, key, size, [0.1, 0.9])
    rows = join_group_stats(packets, q, key, spread)
    return rows.groupBy(*key).agg(
        zero(F.stddev_samp(size) / (F.avg(size) + EPS)).alias("payloadVariation"),
        F.count_if(F.col(size) > F.col("p90")).alias("largePayloadCount"),
        F.count_if(F.col(size) < F.col("p10")).alias("smallPayloadCount"),
    )


def activity(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Active time, packets per second of it, and silences: gaps above mean + 2 std."""
    p = with_iat(packets, key)
    stats = p.groupBy(*key).agg(
        (F.max("t") - F.min("t")).alias("activityDuration"), F.count(F.lit(1)).alias("_n"),
        (F.avg("iat") + 2 * F.stddev_pop("iat")).alias("_limit"),
    )
    rows = join_group_stats(p.select(*key, "pkt_id", "iat"), stats, key, ["pkt_id"])
    return rows.groupBy(*key).agg(
        F.first("activityDuration").alias("activityDuration"),
        (F.first("_n") / F.greatest(F.first("activityDuration"), F.lit(MIN_DURATION))).alias("activityIntensity"),
        F.count_if(F.col("iat") > F.col("_limit")).alias("silencePeriods"),
    )


def graph_stats(edges: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Nodes, edges (repeats counted), density and degree statistics per key."""
    ends = edges.select(*key, F.explode(F.array("src_ip", "dst_ip")).alias("node"))
    degrees = ends.groupBy(*key, "node").agg(F.count(F.lit(1)).alias("degree"))
    out = degrees.groupBy(*key).agg(
        F.count(F.lit(1)).alias("graphNumNodes"), (F.sum("degree") / 2).cast("long").alias("graphNumEdges"),
        F.avg("degree").alias("graphAvgDegree"), F.max("degree").alias("graphMaxDegree"),
        F.stddev_pop("degree").alias("graphDegreeStd"),
    )
    n = F.col("graphNumNodes")
    return out.withColumn("graphDensity", F.col("graphNumEdges") / F.greatest(n * (n - 1) / 2, F.lit(1.0)))


def class_shares(df: DataFrame, by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Count and percent per class, inside each ``within`` group or over all."""
    counts = df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*within)  # over one row per class
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(w))


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count(F.lit(1)).alias("classes"))


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: type, row count, NULLs, infinities; and the number of repeated rows."""
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c, kind in types.items():
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
        inf = F.col(c).isin(float("inf"), float("-inf")) if kind in ("double", "float") else F.lit(False)
        aggs.append(F.count_if(inf).alias(f"inf_{c}"))
    wide = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("type"), F.col("_rows").alias("n_rows"),
            F.col(f"null_{c}").alias("nulls"), F.col(f"inf_{c}").alias("infs"),
        )
        for c, kind in types.items()
    ]
    return wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Three weightings per class: n/(k n_c), the same scaled to sum 1, inverse frequency scaled to sum k."""
    w = Window.partitionBy()  # over one row per class
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    k, total = F.count(F.lit(1)).over(w), F.sum("n").over(w)
    c = c.select(label, "n", (total / (k * F.col("n"))).alias("balanced"), (total / F.col("n")).alias("_inv"), k.alias("_k"))
    return c.select(
        label, "n", "balanced", (F.col("balanced") / F.sum("balanced").over(w)).alias("normalized"),
        (F.col("_inv") / F.sum("_inv").over(w) * F.col("_k")).alias("inverse"),
    )


# -- windows inside a flow -------------------------------------------------------------------------

def rolling_stats(packets: DataFrame, key: Sequence[str] = ("flow_id",), window: int = 10) -> DataFrame:
    """Mean of rolling means and stds, max and min over full windows of ``window`` packets."""
    rows = with_look_back(index_rows(packets, key, ORDER), key, window - 1)
    w = block_window(key).rowsBetween(1 - window, 0)
    rows = rows.select(
        *key, "rn", "_ghost", F.avg("size").over(w).alias("m"), F.stddev_samp("size").over(w).alias("s"),
        F.max("size").over(w).alias("hi"), F.min("size").over(w).alias("lo"),
    )
    return rows.where(~F.col("_ghost") & (F.col("rn") >= window)).groupBy(*key).agg(
        F.avg("m").alias("rollingMean"), F.avg("s").alias("rollingStd"),
        F.max("hi").alias("rollingMax"), F.min("lo").alias("rollingMin"),
    )


def burst_stats(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Bursts: IAT below mean - std(sample)."""
    p = with_iat(packets, key)
    stats = p.groupBy(*key).agg(
        (F.avg("iat") - F.stddev_samp("iat")).alias("_limit"), F.count(F.lit(1)).alias("_n")
    )
    rows = join_group_stats(p.select(*key, "pkt_id", "iat"), stats, key, ["pkt_id"])
    out = rows.groupBy(*key).agg(F.count_if(F.col("iat") < F.col("_limit")).alias("burstCount"), F.first("_n").alias("_n"))
    size = F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_n") / F.greatest(F.col("burstCount"), F.lit(1)))
    return out.select(*key, "burstCount", size.alias("avgBurstSize"))


def iat_with_previous(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Rows with ``iat`` and ``prev_iat``."""
    rows = with_look_back(index_rows(packets, key, ORDER), key, 2)
    w = block_window(key)
    one, two = F.lag("t", 1).over(w), F.lag("t", 2).over(w)
    rows = rows.withColumn("iat", F.col("t") - one).withColumn("prev_iat", one - two)
    return rows.where(~F.col("_ghost")).drop("_ghost", "_blk")


def periodicity(packets: DataFrame, key: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Lag-1 autocorrelation of the IAT; 0 with fewer than 10 gaps."""
    out = iat_with_previous(packets, key).groupBy(*key).agg(
        F.corr("iat", "prev_iat").alias("_c"), F.count("iat").alias("_n")
    )
    c = F.when((F.col("_n") >= 10) & ~F.isnan("_c"), F.col("_c"))
    return out.select(*key, zero(c).alias("periodicity"), zero(F.abs(c)).alias("periodicityStrength"))


def percentile_ranks(df: DataFrame, row_key: str, columns: Sequence[str]) -> DataFrame:
    """Long form (row, feature, rank): average-tie rank over the non-NULL count."""
    cells = melt(df, [row_key], columns).where(F.col("value").isNotNull())
    counts = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, ["feature"], "value", ["n"])
    ranks = cum.select("feature", "value", "n", ((F.col("cum_n") - (F.col("n") - 1) / 2) / F.col("all_n")).alias("rank"))
    ranked = join_heavy_stats(cells, ranks, ["feature", "value"], "n", counts.agg(F.sum("n")))
    return ranked.select(row_key, "feature", "rank")


def with_percentile_ranks(df: DataFrame, names: Mapping[str, str], spread: Sequence[str]) -> DataFrame:
    """``df`` with the average-tie rank over the non-NULL count of each column in ``names`` (column -> rank column), NULL for NULL.

    The ranks of the distinct values are stored. Rows of a column with few of them do not move; those of others meet
    their values once a column.
    """
    counts = melt(df, [], list(names)).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(materialize(counts, "value-counts"), ["feature"], "value", ["n"])
    rank = (F.col("cum_n") - (F.col("n") - 1) / 2) / F.col("all_n")
    ranks = materialize(cum.select("feature", "value", F.col("n").alias("_n"), rank.alias("_rank")), "value-ranks")
    sizes = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}
    out = df
    for c, name in sorted(names.items(), key=lambda x: -sizes.get(x[0], 0)):  # rows move before they have grown
        own = ranks.where(F.col("feature") == c).select(F.col("value").alias("_value"), "_n", F.col("_rank").alias(name))
        out = out.withColumn("_value", F.col(c).cast("double"))
        if sizes.get(c, 0) <= FEW_KEYS:
            out = out.join(F.broadcast(own), "_value", "left")
        else:
            out = join_heavy_stats(out, own, ["_value"], "_n", how="left", spread=spread)
        out = out.drop("_value", "_n")
    return out


def widen(long: DataFrame, key: Sequence[str], names: Mapping[str, str], value: str) -> DataFrame:
    """Long (key, feature, value) to one column per entry of ``names`` (feature -> column name)."""
    return long.groupBy(*key).agg(
        *[F.max(F.when(F.col("feature") == f, F.col(value))).alias(n) for f, n in names.items()]
    )
