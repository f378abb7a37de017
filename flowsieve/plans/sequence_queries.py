"""Queries for sequence datasets (G) and TLS and payload features (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import stable
from flowsieve.operators import flows as fl, sequences as sq, tls
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import ENTROPY, settle
from flowsieve.plans.registry import query, st, sts

ORDER = ["t", "pkt_id"]
FEATURES = ["size", "dst_port"]


def _digest(column: str):
    """Sums of a sequence array, with the position as weight in the second."""
    size = F.transform(column, lambda r: r[0])
    port = F.transform(column, lambda r: r[1])

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    return [
        total(size).alias("sum_size"),
        total(F.transform(size, lambda x, i: x * (i + 1))).alias("weighted_size"),
        total(F.transform(port, lambda x, i: x * (i + 1))).alias("weighted_port"),
        F.size(column).alias("length"),
    ]


def _digest_sql(size: str = "ls", port: str = "lp") -> str:
    w = "list_sum(list_transform({c}, lambda x, i: x * i))"
    return sts(f"list_sum({size}) AS sum_size", f"{w.format(c=size)} AS weighted_size", f"{w.format(c=port)} AS weighted_port") + f", CAST(len({size}) AS BIGINT) AS length"


def _windows(w: int, part: str = "", extra: str = "") -> str:
    return f"""SELECT {part + ', ' if part else ''}row_number() OVER o AS rn, label, list(size) OVER f AS ls, list(CAST(dst_port AS DOUBLE)) OVER f AS lp{extra} FROM packets
 WINDOW o AS ({'PARTITION BY ' + part if part else ''} ORDER BY t, pkt_id), f AS ({'PARTITION BY ' + part if part else ''} ORDER BY t, pkt_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"""


@query("G01_sliding_windows", f"""WITH {v.PACKETS}, w AS ({_windows(10)})
SELECT (rn - 10) // 3 AS window_id, CAST(label AS BIGINT) AS label, {_digest_sql()} FROM w WHERE rn >= 10 AND (rn - 10) % 3 = 0""")
def g01(spark, sf):
    w = sq.sliding_windows(v.packets(spark, sf), FEATURES, "label", ORDER, 10, 3)
    return settle(w.select("window_id", "label", *_digest("sequences")))


@query("G02_grouped_windows", f"""WITH {v.PACKETS}, w AS ({_windows(20, 'flow_id')})
SELECT flow_id, rn - 20 AS window_id, CAST(label AS BIGINT) AS label, {_digest_sql()} FROM w WHERE rn >= 20""")
def g02(spark, sf):
    w = sq.sliding_windows(v.packets(spark, sf), FEATURES, "label", ORDER, 20, 1, ["flow_id"])
    return settle(w.select("flow_id", "window_id", "label", *_digest("sequences")))


@query("G03_multi_scale_windows", f"WITH {v.PACKETS} " + " UNION ALL ".join(
    f"SELECT CAST({w} AS BIGINT) AS window_size, flow_id, rn - {w} AS window_id, CAST(label AS BIGINT) AS label, {_digest_sql()} FROM ({_windows(w, 'flow_id')}) WHERE rn >= {w}" for w in sq.WINDOW_SIZES))
def g03(spark, sf):
    w = sq.multi_scale_windows(v.packets(spark, sf), FEATURES, "label", ORDER, key=["flow_id"])
    return settle(w.select("window_size", "flow_id", "window_id", "label", *_digest("sequences")))


@query("G04_context_windows", f"""WITH {v.PACKETS}, w AS ({_windows(12, '', ', list(label) OVER f AS ly')})
SELECT (rn - 12) // 2 AS window_id, CAST(ly[9] AS BIGINT) AS label, {sts('list_sum(ls[1:4]) AS past_size', 'list_sum(ls[5:9]) AS main_size', 'list_sum(ls[10:12]) AS future_size')}
FROM w WHERE rn >= 12 AND (rn - 12) % 2 = 0""")
def g04(spark, sf):
    w = sq.context_windows(v.packets(spark, sf), FEATURES, "label", ORDER, 4, 5, 3, 2)
    return settle(w.select("window_id", "label", *[_digest(c)[0].alias(f"{c}_size") for c in ("past", "main", "future")]))


@query("G05_reshape_features", f"""WITH {v.FLOWS} SELECT row_id, {sts('quantity AS a11', 'price AS a12', 'discount AS a21', 'tax AS a22', 'line AS a31')}, CAST(0 AS DOUBLE) AS a32 FROM flows""")
def g05(spark, sf):
    r = sq.reshape_features(v.flow_table(spark, sf), ["quantity", "price", "discount", "tax", "line"], 3)
    return settle(r.select("row_id", *[F.element_at(F.element_at("sequence", i), j).alias(f"a{i}{j}") for i in (1, 2, 3) for j in (1, 2)]))


@query("G06_sequence_summary", f"""WITH {v.PACKETS}, w AS ({_windows(5, 'flow_id')}), k AS (SELECT * FROM w WHERE rn >= 5), x AS (SELECT unnest(list_concat(ls, lp)) AS x FROM k)
SELECT (SELECT count(*) FROM k) AS n_sequences, CAST(5 AS BIGINT) AS window, CAST(2 AS BIGINT) AS features, {st('(SELECT avg(CAST(label <> 0 AS INTEGER)) FROM k)')} AS positive_share,
 {sts('avg(x) AS mean', 'stddev_pop(x) AS std', 'min(x) AS min', 'max(x) AS max')} FROM x""")
def g06(spark, sf):
    w = sq.sliding_windows(v.packets(spark, sf), FEATURES, "label", ORDER, 5, 1, ["flow_id"])
    return settle(sq.sequence_summary(w))


@query("A09_flatten_sequences", f"""WITH {v.PACKETS}, w AS ({_windows(3, 'flow_id')}) SELECT flow_id, rn - 3 AS window_id, {sts(*[f'{a}[{i + 1}] AS ts_{i}_{j}' for i in range(3) for j, a in enumerate(('ls', 'lp'))])}
FROM w WHERE rn >= 3""")
def a09(spark, sf):
    from flowsieve.session import scratch_path

    w = sq.sliding_windows(v.packets(spark, sf), FEATURES, "label", ORDER, 3, 1, ["flow_id"])
    path = scratch_path(spark, "sequences")
    w.write.parquet(path)
    return settle(sq.flatten_sequences(spark.read.parquet(path), 3, 2).drop("label"))


@query("H01_suite_entropy", f"""WITH {v.TLS_LINES}, a AS ({ENTROPY.format(eps='0', col='suite', rel='tls')}), b AS ({ENTROPY.format(eps='0', col='ext', rel='tls')})
SELECT flow_id, {st('a.h')} AS cipher_suite_entropy, {st('b.h')} AS extension_entropy FROM a JOIN b USING (flow_id)""")
def h01(spark, sf):
    return settle(fl.value_entropy(v.tls_lines(spark, sf), ["flow_id"], {"cipher_suite_entropy": "suite", "extension_entropy": "ext"}, apart=True))


@query("H01_array_entropy", f"""WITH w AS (SELECT doc_id AS flow_id, unnest(string_split(text, ' ')) AS x FROM documents), a AS ({ENTROPY.format(eps='0', col='x', rel='w')})
SELECT flow_id AS doc_id, {st('h')} AS word_entropy FROM a""")
def h01b(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    return settle(tls.array_entropy(d, "doc_id", "words", "word_entropy"))


CERT = """cc AS (SELECT flow_id, unnest([CAST(cert_size AS DOUBLE), CAST(length(issuer) AS DOUBLE), CAST(validity_days AS DOUBLE)]) AS x FROM tls),
cs AS (SELECT flow_id, min(x) AS lo, max(x) AS hi, stddev_pop(x) AS sd, count(*) AS total FROM cc GROUP BY 1),
cb AS (SELECT flow_id, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 10)) + 1, 10) ELSE 1 END AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
  any_value(sd) AS sd, any_value(total) AS total FROM cc JOIN cs USING (flow_id) GROUP BY 1, 2),
cert AS (SELECT flow_id, -sum(d * log2(d + 1e-10)) AS certificate_entropy FROM
 (SELECT flow_id, n / total / CASE WHEN hi > lo THEN (hi - lo) / sd / 10 ELSE 0.1 END AS d FROM cb) GROUP BY 1)"""


def _cert(spark, sf):
    lines = v.tls_lines(spark, sf).withColumn("issuer_length", F.length("issuer"))
    return tls.certificate_entropy(lines, ["flow_id"], ["cert_size", "issuer_length", "validity_days"])


@query("H02_certificate_entropy", f"WITH {v.TLS_LINES}, {CERT} SELECT flow_id, {st('certificate_entropy')} AS certificate_entropy FROM cert")
def h02(spark, sf):
    return settle(_cert(spark, sf))


@query("H03_handshake_duration", f"WITH {v.TLS_LINES} SELECT flow_id, {st('CASE WHEN count(*) >= 2 THEN max(ts) - min(ts) ELSE 0 END')} AS handshake_duration FROM tls GROUP BY 1")
def h03(spark, sf):
    return settle(tls.handshake_timing(v.tls_lines(spark, sf), ["flow_id"]).select("flow_id", "handshake_duration"))


@query("H04_rtt_variance", f"""WITH {v.TLS_LINES}, i AS (SELECT *, row_number() OVER (PARTITION BY flow_id, direction ORDER BY ts, pkt_id) AS i FROM tls),
p AS (SELECT flow_id, i, max(ts) FILTER (direction = 'client_to_server') AS c, max(ts) FILTER (direction = 'server_to_client') AS s FROM i GROUP BY 1, 2),
g AS (SELECT flow_id, var_pop(s - c) FILTER (s > c) AS v, count(*) FILTER (s > c) AS gaps, count(c) AS nc, count(s) AS ns FROM p GROUP BY 1)
SELECT flow_id, {st('CASE WHEN nc + ns >= 4 AND nc >= 2 AND ns >= 2 AND gaps > 1 THEN v ELSE 0 END')} AS rtt_variance FROM g""")
def h04(spark, sf):
    return settle(tls.rtt_variance(v.tls_lines(spark, sf), ["flow_id"]))


@query("H05_chain_and_bytes", f"WITH {v.TLS_LINES} SELECT flow_id, count(*) AS chain_length, {st('sum(size)')} AS handshake_bytes FROM tls GROUP BY 1")
def h05(spark, sf):
    return settle(tls.handshake_timing(v.tls_lines(spark, sf), ["flow_id"]).select("flow_id", "chain_length", "handshake_bytes"))


_SUITE = "coalesce(cipher_suite, CASE k % 3 WHEN 0 THEN 'TLS_DHE_3DES_EDE' WHEN 1 THEN 'TLS_NULL_md5' ELSE 'OTHER' END)"


def _suite():
    return F.coalesce("cipher_suite", F.when(F.col("k") % 3 == 0, "TLS_DHE_3DES_EDE").when(F.col("k") % 3 == 1, "TLS_NULL_md5").otherwise("OTHER"))


_BITS = ("CASE WHEN s IS NULL OR s = '' THEN 0 WHEN upper(s) LIKE '%AES\\_256%' ESCAPE '\\' THEN 256 WHEN upper(s) LIKE '%AES\\_128%' ESCAPE '\\' THEN 128 WHEN upper(s) LIKE '%CHACHA20%' THEN 256 "
         "WHEN upper(s) LIKE '%RC4%' THEN 64 WHEN upper(s) LIKE '%3DES%' THEN 112 WHEN upper(s) LIKE '%DES%' OR upper(s) LIKE '%MD5%' OR upper(s) LIKE '%SHA1\\_ONLY%' ESCAPE '\\' THEN 64 ELSE 128 END")
_PFS = "coalesce(upper(s) LIKE '%DHE%' OR upper(s) LIKE '%ECDH\\_ANON%' ESCAPE '\\', false)"


@query("H06_cipher_strength", f"WITH {v.PACKETS}, c AS (SELECT pkt_id, {_SUITE} AS s FROM packets) SELECT pkt_id, CAST({_BITS} AS BIGINT) AS bits FROM c")
def h06(spark, sf):
    return settle(v.packets(spark, sf).select("pkt_id", tls.cipher_strength(_suite()).alias("bits")))


@query("H07_forward_secrecy", f"WITH {v.PACKETS}, c AS (SELECT pkt_id, {_SUITE} AS s FROM packets) SELECT pkt_id, {_PFS} AS pfs FROM c")
def h07(spark, sf):
    return v.packets(spark, sf).select("pkt_id", tls.forward_secrecy(_suite()).alias("pfs"))


HAND = f"""{v.TLS_LINES}, {CERT}, a AS ({ENTROPY.format(eps='0', col='suite', rel='tls')}), b AS ({ENTROPY.format(eps='0', col='ext', rel='tls')}),
hf AS (SELECT flow_id, a.h AS e1, certificate_entropy AS e2, b.h AS e3, CASE WHEN flow_id % 4 = 0 THEN 64 ELSE 256 END AS bits, flow_id % 3 = 0 AS pfs FROM a JOIN b USING (flow_id) JOIN cert USING (flow_id)),
z AS (SELECT avg(e1) AS m1, stddev_pop(e1) AS s1, avg(e2) AS m2, stddev_pop(e2) AS s2, avg(e3) AS m3, stddev_pop(e3) AS s3 FROM hf),
hs AS (SELECT flow_id, abs((e1-m1)/s1) + abs((e2-m2)/s2) + abs((e3-m3)/s3) + CASE WHEN bits < 128 THEN 2 ELSE 0 END + CASE WHEN pfs THEN 0 ELSE 1 END AS score FROM hf, z)"""


def _handshake_features(spark, sf):
    e = fl.value_entropy(v.tls_lines(spark, sf), ["flow_id"], {"cipher_suite_entropy": "suite", "extension_entropy": "ext"}, apart=True)
    suite = F.when(F.col("flow_id") % 4 == 0, "TLS_RC4").otherwise("TLS_AES_256_GCM")
    exchange = F.when(F.col("flow_id") % 3 == 0, "ecdhe").otherwise("RSA")
    return e.join(_cert(spark, sf), "flow_id").withColumns(
        {"cipher_strength": tls.cipher_strength(suite), "perfect_forward_secrecy": tls.forward_secrecy(exchange)})


@query("H08_tls_anomaly_score", f"WITH {HAND} SELECT flow_id, {st('score')} AS anomaly_score FROM hs")
def h08(spark, sf):
    return settle(tls.anomaly_scores(_handshake_features(spark, sf)).select("flow_id", "anomaly_score"))


@query("H09_tls_anomalies", f"WITH {HAND} SELECT flow_id, {st('score')} AS anomaly_score FROM hs WHERE score > 4")
def h09(spark, sf):
    return settle(tls.tls_anomalies(_handshake_features(spark, sf), 4.0).select("flow_id", "anomaly_score"))


BYTES = f"""{v.PAYLOADS}, hx AS (SELECT flow_id, hex(payload) AS h FROM payloads), bt AS (SELECT flow_id, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, i * 2 + 1, 2))) AS b FROM hx),
bc AS (SELECT flow_id, b, CAST(count(*) AS DOUBLE) AS n FROM bt GROUP BY 1, 2), bs AS (SELECT flow_id, sum(n) AS total, sum(n * log2(n)) AS nl, sum(n * n) AS nn FROM bc GROUP BY 1)"""


@query("H10_byte_entropy", f"WITH {BYTES} SELECT flow_id, {st('log2(total) - nl / total')} AS byte_entropy, CAST(total AS BIGINT) AS total_bytes FROM bs")
def h10(spark, sf):
    return settle(tls.payload_entropy(v.payloads(spark, sf), "flow_id").select("flow_id", "byte_entropy", "total_bytes"))


@query("H11_payload_sizes", f"""WITH {v.PAYLOADS}, z AS (SELECT flow_id, octet_length(payload) AS bytes FROM payloads), e AS ({ENTROPY.format(eps='0', col='bytes', rel='z')})
SELECT flow_id, {sts('avg(bytes) AS size_mean', 'var_pop(bytes) AS size_variance', 'any_value(h) AS size_entropy')} FROM z JOIN e USING (flow_id) GROUP BY 1""")
def h11(spark, sf):
    return settle(tls.payload_sizes(v.payloads(spark, sf), "flow_id"))


@query("H12_randomness", f"WITH {BYTES} SELECT flow_id, {st('CASE WHEN total >= 100 THEN 1 / (1 + (nn / (total / 256) - total) / 1000) ELSE 0 END')} AS randomness FROM bs")
def h12(spark, sf):
    return settle(tls.payload_entropy(v.payloads(spark, sf), "flow_id").select("flow_id", "randomness"))


@query("H13_pattern_regularity", f"""WITH {v.PAYLOADS}, hx AS (SELECT payload_id, flow_id, hex(payload) AS h, octet_length(payload) AS l FROM payloads WHERE octet_length(payload) >= 16),
g AS (SELECT payload_id, n, unnest(list_transform(range(0, l - n + 1), lambda i: substr(h, i * 2 + 1, n * 2))) AS x FROM hx, (VALUES (2), (4), (8)) v(n)),
c AS (SELECT payload_id, n, x, count(*) AS c FROM g GROUP BY ALL), m AS (SELECT payload_id, n, max(c) AS c FROM c GROUP BY 1, 2),
s AS (SELECT payload_id, sum(c / l) AS s FROM m JOIN hx USING (payload_id) GROUP BY 1)
SELECT p.flow_id, {st('coalesce(avg(s), 0)')} AS pattern_regularity FROM payloads p LEFT JOIN s USING (payload_id) GROUP BY 1""")
def h13(spark, sf):
    return settle(tls.pattern_regularity(v.payloads(spark, sf), "flow_id"))


@query("H14_flow_attributes", f"""WITH {v.PACKETS} SELECT flow_id, coalesce(min_by(tls_version, (t, pkt_id)) FILTER (tls_version IS NOT NULL), 'unknown') AS tls_version,
 coalesce(min_by(cipher_suite, (t, pkt_id)) FILTER (cipher_suite IS NOT NULL), 'unknown') AS cipher_suite, count(*) FILTER (cert_length > 0) AS n_certificates,
 CAST(coalesce(sum(cert_length) FILTER (cert_length > 0), 0) AS BIGINT) AS certificate_bytes FROM packets GROUP BY 1""")
def h14(spark, sf):
    return settle(tls.flow_attributes(v.packets(spark, sf), ["flow_id"], ["tls_version", "cipher_suite"], ORDER, "cert_length"))
