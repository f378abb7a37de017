"""Queries for flow aggregation (E) and ordered flow features (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import stable
from flowsieve.operators import flows as fl
from flowsieve.plans import views as v
from flowsieve.plans.registry import query, st, sts


def settle(df, exact=()):
    """Cast counts to long and keep doubles to float precision, for comparison."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name in exact:
            out.append(c)
        elif kind in ("double", "float"):
            out.append(stable(c).alias(name))
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            out.append(c.cast("long").alias(name))
        elif kind.startswith("decimal"):
            out.append(stable(c).alias(name))
        else:
            out.append(c)
    return df.select(*out)


@query("E01_packets_to_flows", f"""WITH {v.IAT}
SELECT flow_id, count(*) AS "pktCount", {sts('sum(size) AS "totalBytes"', 'max(t)-min(t) AS "flowDuration"', 'avg(size) AS "pktSizeMean"',
 'coalesce(stddev_pop(size),0) AS "pktSizeStd"', 'coalesce(avg(iat),0) AS "iatMean"', 'coalesce(stddev_pop(iat),0) AS "iatStd"')}
FROM iat GROUP BY flow_id""")
def e01(spark, sf):
    return settle(fl.packets_to_flows(v.packets(spark, sf)))


ENTROPY = """SELECT flow_id, sum(-(n / total) * log2(n / total + {eps})) AS h, count(*) AS distinct_values
 FROM (SELECT flow_id, {col} AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY flow_id) AS DOUBLE) AS total
       FROM {rel} WHERE {col} IS NOT NULL GROUP BY 1, 2) GROUP BY flow_id"""


@query("E02_tls_flow_features", f"""WITH {v.PACKETS}, tls AS (SELECT * FROM packets WHERE dst_port = 443 OR protocol IN ('TLS','HTTPS')),
ent AS ({ENTROPY.format(eps='0', col='size', rel='tls')})
SELECT flow_id, count(*) AS "tlsPktCount", {sts('avg(size) AS "tlsSizeMean"', 'stddev_pop(size) AS "tlsSizeStd"', 'any_value(h) AS "tlsSizeEntropy"')}
FROM tls JOIN ent USING (flow_id) GROUP BY flow_id""")
def e02(spark, sf):
    return settle(fl.tls_port_features(v.packets(spark, sf)))


@query("E03_packet_size_stats", f"""WITH {v.PACKETS} SELECT flow_id, {sts('avg(size) AS "sizeMean"', 'coalesce(stddev_samp(size),0) AS "sizeStd"',
 'min(size) AS "sizeMin"', 'max(size) AS "sizeMax"', 'coalesce(var_samp(size),0) AS "sizeVar"')} FROM packets GROUP BY 1""")
def e03(spark, sf):
    return settle(v.packets(spark, sf).groupBy("flow_id").agg(*fl.size_aggs()))


@query("E04_iat_stats", f"""WITH {v.IAT} SELECT flow_id, count(*) AS "pktCount", {sts('max(t)-min(t) AS "flowDuration"', 'coalesce(avg(iat),0) AS "iatMean"',
 'coalesce(stddev_samp(iat),0) AS "iatStd"', 'coalesce(min(iat),0) AS "iatMin"', 'coalesce(max(iat),0) AS "iatMax"')} FROM iat GROUP BY 1""")
def e04(spark, sf):
    return settle(fl.with_iat(v.packets(spark, sf)).groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("pktCount"), (F.max("t") - F.min("t")).alias("flowDuration"), *fl.iat_aggs()))


@query("E05_direction_counts", f"""WITH {v.PACKETS} SELECT flow_id, count(*) FILTER (direction = 'forward') AS "fwdPktCount",
 count(*) FILTER (direction = 'backward') AS "bwdPktCount" FROM packets GROUP BY 1""")
def e05(spark, sf):
    return settle(v.packets(spark, sf).groupBy("flow_id").agg(*fl.direction_aggs()))


@query("E06_flow_rates", f"""WITH {v.PACKETS} SELECT flow_id, {sts('sum(size) AS "totalBytes"', 'sum(size)/greatest(max(t)-min(t),1e-6) AS "bytesPerSec"',
 'count(*)/greatest(max(t)-min(t),1e-6) AS "pktsPerSec"')} FROM packets GROUP BY 1""")
def e06(spark, sf):
    return settle(v.packets(spark, sf).groupBy("flow_id").agg(*fl.rate_aggs()))


@query("E07_protocol_counts", f"""WITH {v.PACKETS} SELECT flow_id, {', '.join(f'''count(*) FILTER (protocol = '{p}') AS "proto_{p}"''' for p in fl.PROTOCOLS)}
FROM packets GROUP BY 1""")
def e07(spark, sf):
    return settle(v.packets(spark, sf).groupBy("flow_id").agg(*fl.protocol_aggs()))


@query("E08_tcp_flag_counts", f"""WITH {v.PACKETS} SELECT flow_id, {', '.join(f'''count(*) FILTER (flags LIKE '%{p}%') AS "flag_{p}"''' for p in fl.TCP_FLAGS)}
FROM packets GROUP BY 1""")
def e08(spark, sf):
    return settle(v.packets(spark, sf).groupBy("flow_id").agg(*fl.flag_aggs()))


@query("E09_tls_attributes", f"""WITH {v.PACKETS} SELECT flow_id,
 {', '.join(f'''count(*) FILTER (tls_version = '{t}') AS "{n}"''' for n, t in fl.TLS_VERSIONS.items())},
 {', '.join(f'''count(*) FILTER (handshake_type = '{t}') AS "{n}"''' for n, t in fl.HANDSHAKE_TYPES.items())},
 {sts('coalesce(avg(cert_length),0) AS "certLengthMean"', 'coalesce(max(cert_length),0) AS "certLengthMax"')}, count(cert_length) AS "certCount",
 count(DISTINCT cipher_suite) AS "uniqueCiphers",
 {', '.join(f'''CAST(coalesce(max(CAST(cipher_suite LIKE '%{t}%' AS INTEGER)),0) AS BIGINT) AS "{n}"''' for n, t in fl.CIPHER_WORDS.items())}
FROM packets GROUP BY 1""")
def e09(spark, sf):
    return settle(fl.tls_features(v.packets(spark, sf)))


@query("E10_shannon_entropy", f"""WITH {v.PACKETS}, a AS ({ENTROPY.format(eps='0', col='size', rel='packets')}), b AS ({ENTROPY.format(eps='1e-10', col='size', rel='packets')}),
c AS ({ENTROPY.format(eps='0', col='tls_version', rel='packets')})
SELECT flow_id, {st('a.h')} AS entropy, {st('b.h')} AS entropy_eps, {st('coalesce(c.h,0)')} AS version_entropy
FROM a JOIN b USING (flow_id) LEFT JOIN c USING (flow_id)""")
def e10(spark, sf):
    p = v.packets(spark, sf)
    exact = fl.value_entropy(p, ["flow_id"], {"entropy": "size", "version_entropy": "tls_version"})
    return settle(exact.join(fl.value_entropy(p, ["flow_id"], {"entropy_eps": "size"}, eps=fl.EPS), "flow_id"))


@query("E11_normalized_entropy", f"""WITH {v.PACKETS}, a AS ({ENTROPY.format(eps='0', col='protocol', rel='packets')})
SELECT flow_id, {st('h')} AS protocol_entropy, {st('CASE WHEN log2(distinct_values + 1e-10) > 0 THEN h / log2(distinct_values + 1e-10) ELSE 0 END')} AS "protocol_entropyNorm" FROM a""")
def e11(spark, sf):
    return settle(fl.value_entropy(v.packets(spark, sf), ["flow_id"], {"protocol_entropy": "protocol"}, normalized=True))


@query("E12_entropy_family", f"""WITH {v.IAT}, a AS ({ENTROPY.format(eps='1e-10', col='size', rel='iat')}), b AS ({ENTROPY.format(eps='1e-10', col='iat', rel='iat')}),
c AS ({ENTROPY.format(eps='1e-10', col='protocol', rel='iat')}), d AS ({ENTROPY.format(eps='1e-10', col='dst_port', rel='iat')})
SELECT flow_id, {st('a.h')} AS "sizeEntropy", {st('coalesce(b.h,0)')} AS "iatEntropy", {st('c.h')} AS "protocolEntropy", {st('d.h')} AS "portEntropy"
FROM a LEFT JOIN b USING (flow_id) JOIN c USING (flow_id) JOIN d USING (flow_id)""")
def e12(spark, sf):
    return settle(fl.value_entropy(fl.with_iat(v.packets(spark, sf)), ["flow_id"], {
        "sizeEntropy": "size", "iatEntropy": "iat", "protocolEntropy": "protocol", "portEntropy": "dst_port"}, eps=fl.EPS))


def _moments(rel: str, c: str, name: str) -> str:
    return f"""(SELECT flow_id, coalesce(avg(pow({c}-mu,3))/nullif(pow(stddev_pop({c}),3),0),0) AS {name}_skew,
 coalesce(avg(pow({c}-mu,4))/nullif(pow(stddev_pop({c}),4),0)-3,0) AS {name}_kurt,
 coalesce(stddev_samp({c})/(avg({c})+1e-10),0) AS {name}_cv FROM (SELECT *, avg({c}) OVER (PARTITION BY flow_id) AS mu FROM {rel}) GROUP BY 1)"""


@query("E13_size_moments", f"""WITH {v.IAT}, a AS {_moments('iat', 'size', 's')}, b AS {_moments('iat', 'iat', 'i')},
c AS (SELECT flow_id, quantile_cont(size,0.25) AS q25, quantile_cont(size,0.5) AS q50, quantile_cont(size,0.75) AS q75, quantile_cont(size,0.9) AS q90 FROM iat GROUP BY 1)
SELECT flow_id, {sts('s_skew AS "sizeSkew"', 's_kurt AS "sizeKurtosis"', 's_cv AS "sizeCV"', 'i_skew AS "iatSkew"', 'i_kurt AS "iatKurtosis"', 'i_cv AS "iatCV"',
 'q25 AS "sizeP25"', 'q50 AS "sizeP50"', 'q75 AS "sizeP75"', 'q90 AS "sizeP90"', 'q75-q25 AS "sizeIQR"')}
FROM a JOIN b USING (flow_id) JOIN c USING (flow_id)""")
def e13(spark, sf):
    return settle(fl.size_moments(v.packets(spark, sf)))


@query("E14_connection_diversity", f"""WITH {v.EDGES} SELECT flow_id, count(DISTINCT src_ip) AS "uniqueSrcIPs", count(DISTINCT dst_ip) AS "uniqueDstIPs",
 count(DISTINCT src_ip) + count(DISTINCT dst_ip) AS "ipDiversity" FROM edges GROUP BY 1""")
def e14(spark, sf):
    return settle(fl.connection_diversity(v.edges(spark, sf)))


@query("E15_port_scan", f"""WITH {v.PACKETS} SELECT flow_id, count(DISTINCT dst_port) AS "uniquePorts", CAST(max(dst_port)-min(dst_port) AS BIGINT) AS "portRange",
 CAST(count(DISTINCT dst_port) > 10 AS BIGINT) AS "portScanIndicator" FROM packets GROUP BY 1""")
def e15(spark, sf):
    return settle(fl.port_scan(v.packets(spark, sf)))


@query("E16_direction_pattern", f"""WITH {v.PACKETS}, d AS (SELECT *, direction IS DISTINCT FROM lag(direction) OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS ch FROM packets)
SELECT flow_id, count(*) FILTER (direction='forward') AS "fwdPktCount", count(*) FILTER (direction='backward') AS "bwdPktCount",
 count(*) FILTER (ch) AS "directionChanges", {st("count(*) FILTER (direction='forward') / greatest(count(*) FILTER (direction='backward'), 1)")} AS "fwdBwdRatio"
FROM d GROUP BY 1""")
def e16(spark, sf):
    return settle(fl.direction_pattern(v.packets(spark, sf)))


@query("E17_payload_variation", f"""WITH {v.PACKETS}, q AS (SELECT flow_id, quantile_cont(size,0.1) AS lo, quantile_cont(size,0.9) AS hi FROM packets GROUP BY 1)
SELECT flow_id, {st('coalesce(stddev_samp(size)/(avg(size)+1e-10),0)')} AS "payloadVariation", count(*) FILTER (size > hi) AS "largePayloadCount",
 count(*) FILTER (size < lo) AS "smallPayloadCount" FROM packets JOIN q USING (flow_id) GROUP BY 1""")
def e17(spark, sf):
    return settle(fl.payload_variation(v.packets(spark, sf)))


@query("E18_activity_silence", f"""WITH {v.IAT}, s AS (SELECT flow_id, avg(iat) + 2 * stddev_pop(iat) AS lim FROM iat GROUP BY 1)
SELECT flow_id, {st('max(t)-min(t)')} AS "activityDuration", {st('count(*)/greatest(max(t)-min(t),1e-6)')} AS "activityIntensity",
 count(*) FILTER (iat > lim) AS "silencePeriods" FROM iat JOIN s USING (flow_id) GROUP BY 1""")
def e18(spark, sf):
    return settle(fl.activity(v.packets(spark, sf)))


@query("E19_graph_stats", f"""WITH {v.EDGES}, deg AS (SELECT flow_id, node, count(*) AS d FROM
 (SELECT flow_id, src_ip AS node FROM edges UNION ALL SELECT flow_id, dst_ip FROM edges) GROUP BY 1, 2)
SELECT flow_id, count(*) AS "graphNumNodes", CAST(sum(d)/2 AS BIGINT) AS "graphNumEdges", {st('avg(d)')} AS "graphAvgDegree", max(d) AS "graphMaxDegree",
 {st('stddev_pop(d)')} AS "graphDegreeStd", {st('(sum(d)/2)/greatest(count(*)*(count(*)-1)/2, 1)')} AS "graphDensity" FROM deg GROUP BY 1""")
def e19(spark, sf):
    return settle(fl.graph_stats(v.edges(spark, sf)))


@query("E20_class_distribution", f"""WITH {v.FLOWS} SELECT scenario, label, count(*) AS n, {st('count(*)*100.0/sum(count(*)) OVER (PARTITION BY scenario)')} AS percent
FROM flows GROUP BY 1, 2""")
def e20(spark, sf):
    return settle(fl.class_shares(v.flow_table(spark, sf), ["label"], ["scenario"]))


@query("E20_imbalance_ratio", f"""WITH {v.FLOWS}, c AS (SELECT label, count(*) AS n FROM flows GROUP BY 1)
SELECT {st('max(n)/min(n)')} AS imbalance_ratio, count(*) AS classes FROM c""")
def e20b(spark, sf):
    return settle(fl.imbalance_ratio(v.flow_table(spark, sf), "label"))


_PROFILED = {"row_id": "string", "label": "string", "scenario": "string", "quantity": "double", "price": "double", "tax": "double", "kind": "string"}


@query("E21_table_profile", f"WITH {v.DIRTY} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls,
 {f'count(*) FILTER (isinf({c}))' if k == 'double' else '0'} AS infs FROM dirty""" for c, k in _PROFILED.items()))
def e21(spark, sf):
    return settle(fl.table_profile(v.dirty_flows(spark, sf)))


@query("E21_duplicate_count", f"""WITH {v.FLOWS} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM
 (SELECT quantity, discount, tax, label, count(*) AS n FROM flows GROUP BY 1, 2, 3, 4)""")
def e21b(spark, sf):
    return settle(fl.duplicate_count(v.flow_table(spark, sf).select("quantity", "discount", "tax", "label")))


@query("E22_class_weights", f"""WITH {v.FLOWS}, c AS (SELECT label, count(*) AS n FROM flows GROUP BY 1),
w AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) AS b, sum(n) OVER () / n AS inv, count(*) OVER () AS k FROM c)
SELECT label, n, {st('b')} AS balanced, {st('b / sum(b) OVER ()')} AS normalized, {st('inv / sum(inv) OVER () * k')} AS inverse FROM w""")
def e22(spark, sf):
    return settle(fl.class_weights(v.flow_table(spark, sf), "label"))


@query("F01_rolling_stats", f"""WITH {v.IAT}, r AS (SELECT flow_id, rn, avg(size) OVER w AS m, stddev_samp(size) OVER w AS s, max(size) OVER w AS hi, min(size) OVER w AS lo
 FROM iat WINDOW w AS (PARTITION BY flow_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT flow_id, {sts('avg(m) AS "rollingMean"', 'avg(s) AS "rollingStd"', 'max(hi) AS "rollingMax"', 'min(lo) AS "rollingMin"')} FROM r WHERE rn >= 10 GROUP BY 1""")
def f01(spark, sf):
    return settle(fl.rolling_stats(v.packets(spark, sf)))


@query("F02_burst_stats", f"""WITH {v.IAT}, s AS (SELECT flow_id, avg(iat) - stddev_samp(iat) AS lim FROM iat GROUP BY 1),
b AS (SELECT flow_id, count(*) AS n, count(*) FILTER (iat < lim) AS c FROM iat JOIN s USING (flow_id) GROUP BY 1)
SELECT flow_id, c AS "burstCount", {st('CASE WHEN n < 2 THEN 0 ELSE n / greatest(c, 1) END')} AS "avgBurstSize" FROM b""")
def f02(spark, sf):
    return settle(fl.burst_stats(v.packets(spark, sf)))


@query("F03_iat_periodicity", f"""WITH {v.IAT}, p AS (SELECT *, lag(iat) OVER (PARTITION BY flow_id ORDER BY rn) AS prev FROM iat),
c AS (SELECT flow_id, count(iat) AS n, corr(iat, prev) FILTER (prev IS NOT NULL) AS r FROM p GROUP BY 1)
SELECT flow_id, {st('CASE WHEN n >= 10 AND NOT isnan(r) THEN coalesce(r,0) ELSE 0 END')} AS periodicity,
 {st('CASE WHEN n >= 10 AND NOT isnan(r) THEN abs(coalesce(r,0)) ELSE 0 END')} AS "periodicityStrength" FROM c""")
def f03(spark, sf):
    return settle(fl.periodicity(v.packets(spark, sf)))


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


@query("F04_percentile_ranks", f"""WITH {v.FLOWS} SELECT row_id, {st(_rank_sql('quantity'))} AS rank_quantity, {st(_rank_sql('price'))} AS rank_price,
 {st(_rank_sql('tax'))} AS rank_tax FROM flows""")
def f04(spark, sf):
    cols = ["quantity", "price", "tax"]
    long = fl.percentile_ranks(v.flow_table(spark, sf), "row_id", cols)
    return settle(fl.widen(long, ["row_id"], {c: f"rank_{c}" for c in cols}, "rank"))


@query("F05_global_sort", f"""WITH {v.PACKETS} SELECT pkt_id, row_number() OVER (ORDER BY t, pkt_id) AS position FROM packets""")
def f05(spark, sf):
    from flowsieve.operators.ordering import index_rows

    return settle(index_rows(v.packets(spark, sf), [], fl.ORDER, name="position").select("pkt_id", "position"))


@query("F06_top_k", f"""WITH {v.FLOWS} SELECT row_id, price FROM flows ORDER BY price DESC, row_id LIMIT 25""")
def f06(spark, sf):
    return v.flow_table(spark, sf).orderBy(F.desc("price"), "row_id").limit(25).select("row_id", "price")


@query("F07_top_values", """SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def f07(spark, sf):
    return (v.table(spark, sf, "part").groupBy(F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(10))
