"""Queries for feature engineering (J), feature selection (K) and sampling (L)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from flowsieve.operators import engineer as en, flows as fl, gram as gr, metrics as me, sampling as sa, select as se
from flowsieve.operators.ordering import match_keys
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts
from flowsieve.session import materialize

Q = '"{}"'.format

FEAT = v.IAT + """,
fl0 AS (SELECT flow_id, avg(iat) - stddev_samp(iat) AS lim FROM iat GROUP BY 1),
pe AS (SELECT flow_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS "protocolEntropy" FROM (SELECT flow_id, protocol, CAST(count(*) AS DOUBLE) AS n FROM packets GROUP BY 1, 2) GROUP BY 1),
se AS (SELECT flow_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS "payloadSizeEntropy" FROM (SELECT flow_id, size, CAST(count(*) AS DOUBLE) AS n FROM packets GROUP BY 1, 2) GROUP BY 1),
f0 AS (SELECT flow_id, count(*) AS "pktCount", sum(size) AS "totalBytes", max(t) - min(t) AS "flowDuration", avg(size) AS "pktSizeMean", stddev_pop(size) AS "pktSizeStd",
 avg(iat) AS "iatMean", stddev_pop(iat) AS "iatStd", count(*) FILTER (direction = 'forward') AS "fwdPktCount", count(*) FILTER (direction = 'backward') AS "bwdPktCount",
 count(*) / greatest(max(t) - min(t), 1e-6) AS "pktsPerSec", count(DISTINCT dst_port) AS "uniquePorts",
 count(*) FILTER (direction = 'forward') / greatest(count(*) FILTER (direction = 'backward'), 1) AS "fwdBwdRatio", count(*) FILTER (iat < lim) AS "burstCount",
 count(*) / greatest(max(t) - min(t), 1e-6) AS "activityIntensity", count(*) FILTER (tls_version = 'TLSv1.0') AS "tlsV1_0", count(*) FILTER (tls_version = 'TLSv1.1') AS "tlsV1_1",
 count(*) FILTER (tls_version = 'TLSv1.2') AS "tlsV1_2", count(*) FILTER (tls_version = 'TLSv1.3') AS "tlsV1_3",
 CAST(bool_or(cipher_suite LIKE '%AES%') AS INTEGER) AS "hasAES", CAST(bool_or(cipher_suite LIKE '%GCM%') AS INTEGER) AS "hasGCM", CAST(bool_or(cipher_suite LIKE '%ECDHE%') AS INTEGER) AS "hasECDHE",
 count(*) FILTER (handshake_type = 'ClientHello') AS "clientHelloCount", count(*) FILTER (handshake_type = 'ServerHello') AS "serverHelloCount"
 FROM iat JOIN fl0 USING (flow_id) GROUP BY 1),
feat AS (SELECT * FROM f0 JOIN pe USING (flow_id) JOIN se USING (flow_id))"""

FEATURE_COLUMNS = ["pktCount", "totalBytes", "flowDuration", "pktSizeMean", "pktSizeStd", "iatMean", "iatStd", "fwdPktCount", "bwdPktCount", "pktsPerSec", "uniquePorts",
                   "fwdBwdRatio", "burstCount", "activityIntensity", "tlsV1_0", "tlsV1_1", "tlsV1_2", "tlsV1_3", "hasAES", "hasGCM", "hasECDHE", "clientHelloCount",
                   "serverHelloCount", "protocolEntropy", "payloadSizeEntropy"]


def flow_features(spark, sf):
    """Flow features, written once: fitting and applying both read them."""
    p = v.packets(spark, sf)
    prof = fl.flow_profile(p).withColumn("activityIntensity", F.col("pktsPerSec"))
    prof = prof.join(fl.burst_stats(p).select("flow_id", "burstCount"), "flow_id")
    return materialize(prof.select("flow_id", *FEATURE_COLUMNS), "flow-features")


def _ratio_sql(a: str, b: str) -> str:
    return f'CASE WHEN (SELECT sum(abs({Q(b)})) FROM feat) > 1e-6 THEN {Q(a)} / ({Q(b)} + 1e-10) ELSE 0 END'


@query("J01_ratio_features", f"WITH {FEAT} SELECT flow_id, {', '.join(f'{st(_ratio_sql(a, b))} AS {Q(f'ratio_{a}_{b}')}' for a, b in en.RATIO_PAIRS)} FROM feat")
def j01(spark, sf):
    return settle(en.ratio_features(flow_features(spark, sf)).select("flow_id", *[f"ratio_{a}_{b}" for a, b in en.RATIO_PAIRS]))


def _bin_sql(c: str) -> str:
    inner = ", ".join(f"{c}{i}" for i in (1, 2, 3, 4))
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN {c}0 = {c}5 THEN 2 ELSE len(list_distinct(list_filter([{inner}], lambda e: e > {c}0 AND e < {c}))) END"


@query("J02_binned_features", f"""WITH {v.FLOWS}, q AS (SELECT {', '.join(f'quantile_cont({c}, {i / 5}) AS {c}{i}' for c in ('quantity', 'price', 'discount', 'tax') for i in range(6))} FROM flows)
SELECT row_id, {', '.join(f'CAST({_bin_sql(c)} AS BIGINT) AS bin_{c}' for c in ('quantity', 'price', 'discount', 'tax'))} FROM flows, q""")
def j02(spark, sf):
    cols = v.FLOW_NUMERIC
    return settle(en.binned_features(v.flow_table(spark, sf), cols).select("row_id", *[f"bin_{c}" for c in cols]))


@query("J03_group_aggregates", f"""WITH {FEAT} SELECT flow_id, {sts('("pktSizeMean" + "pktSizeStd") / 2 AS "pktSize_mean"', 'greatest("pktSizeMean", "pktSizeStd") AS "pktSize_max"', 'least("pktSizeMean", "pktSizeStd") AS "pktSize_min"',
 '("iatMean" + "iatStd") / 2 AS iat_mean', '"flowDuration" AS flow_max', '("protocolEntropy" + "payloadSizeEntropy") / 2 AS entropy_mean')} FROM feat""")
def j03(spark, sf):
    f = flow_features(spark, sf).withColumnRenamed("flow_id", "id")
    return settle(en.group_aggregates(f).select(F.col("id").alias("flow_id"), "pktSize_mean", "pktSize_max", "pktSize_min", "iat_mean", "flow_max", "entropy_mean"))


_LIM = "lim AS (SELECT " + ", ".join(f'quantile_cont({Q(c)}, {p}) AS "{c}_{int(p * 100)}"' for c, ps in en.FLAG_QUANTILES.items() for p in ps) + " FROM feat)"


def _flags(families):
    def run(spark, sf, names):
        f = flow_features(spark, sf)
        return settle(en.apply_flags(f, en.fit_flags(f), families).select("flow_id", *names))
    return run


@query("J04_attack_signatures", f"""WITH {FEAT}, {_LIM} SELECT flow_id, CAST("uniquePorts" > 10 AS BIGINT) AS "portScanSignature",
 CAST("pktsPerSec" > "pktsPerSec_95" AND "pktCount" > "pktCount_90" AS BIGINT) AS "ddosSignature", CAST("totalBytes" > "totalBytes_90" AND "flowDuration" > "flowDuration_80" AS BIGINT) AS "exfiltrationSignature",
 CAST("fwdBwdRatio" > 2 AND "pktCount" > "pktCount_50" AS BIGINT) AS "bruteForceSignature" FROM feat, lim""")
def j04(spark, sf):
    return _flags(["attack"])(spark, sf, list(en.attack_flags()))


@query("J05_protocol_anomalies", f"""WITH {FEAT}, {_LIM} SELECT flow_id, CAST("pktSizeMean" < "pktSizeMean_5" OR "pktSizeMean" > "pktSizeMean_95" AS BIGINT) AS "unusualPktSize",
 CAST("iatMean" < "iatMean_5" OR "iatMean" > "iatMean_95" AS BIGINT) AS "unusualIAT", CAST("protocolEntropy" > "protocolEntropy_90" AS BIGINT) AS "protocolEntropyAnomaly" FROM feat, lim""")
def j05(spark, sf):
    return _flags(["protocol"])(spark, sf, list(en.protocol_flags()))


@query("J06_timing_features", f"""WITH {FEAT}, {_LIM} SELECT flow_id, {sts('"iatStd" / ("iatMean" + 1e-10) AS "timingRegularity"', '"burstCount" / ("flowDuration" + 1e-10) AS "burstIntensity"')},
 CAST("activityIntensity" > "activityIntensity_90" AS BIGINT) AS "activityConcentration" FROM feat, lim""")
def j06(spark, sf):
    return _flags(["timing"])(spark, sf, list(en.timing_flags()))


@query("J07_encryption_features", f"""WITH {FEAT}, {_LIM} SELECT flow_id, CAST("tlsV1_3" * 4 + "tlsV1_2" * 3 + "tlsV1_1" * 2 + "tlsV1_0" AS BIGINT) AS "tlsVersionScore", CAST("hasAES" + "hasGCM" + "hasECDHE" AS BIGINT) AS "cipherStrength",
 CAST("clientHelloCount" > 0 AND "serverHelloCount" > 0 AS BIGINT) AS "handshakeCompleteness", CAST("payloadSizeEntropy" > "payloadSizeEntropy_75" AS BIGINT) AS "highEntropyPayload" FROM feat, lim""")
def j07(spark, sf):
    return _flags(["encryption"])(spark, sf, list(en.encryption_flags()))


_PAIRS = [("price", "quantity"), ("price", "line"), ("quantity", "line")]


@query("J08_interactions", f"""WITH {v.FLOWS}, p AS (SELECT row_id, {', '.join(f'CAST({a} AS DOUBLE) * {b} AS {a}_x_{b}' for a, b in _PAIRS)} FROM flows),
l AS ({' UNION ALL '.join(f"SELECT row_id, '{a}_x_{b}' AS feature, {a}_x_{b} AS value FROM p" for a, b in _PAIRS)}),
top AS (SELECT feature FROM l GROUP BY 1 ORDER BY var_samp(value) DESC LIMIT 2)
SELECT row_id, feature, {st('value')} AS value FROM l SEMI JOIN top USING (feature)""")
def j08(spark, sf):
    f = v.flow_table(spark, sf).select("row_id", "quantity", "price", "discount", "tax", "line")
    pairs = en.fit_interactions(f, ["quantity", "price", "discount", "tax", "line"], inputs=3, outputs=2)
    names = [f"{a}_x_{b}" for a, b in pairs]
    return settle(en.apply_interactions(f, pairs).unpivot(["row_id"], names, "feature", "value"))


def _z(e: str) -> str:
    return f"({e} - avg({e}) OVER ()) / coalesce(nullif(stddev_pop({e}) OVER (), 0), 1)"


@query("J09_engineered_features", f"""WITH {FEAT}, {_LIM}, e AS (SELECT flow_id, "totalBytes" / ("pktCount" + 1e-10) AS r, ("pktSizeMean" + "pktSizeStd") / 2 AS g, "iatStd" / ("iatMean" + 1e-10) AS tr,
 CAST("pktSizeMean" < "pktSizeMean_5" OR "pktSizeMean" > "pktSizeMean_95" AS INTEGER) AS u, "pktCount" AS n, CAST("uniquePorts" > 10 AS INTEGER) AS s FROM feat, lim)
SELECT flow_id, {st(_z('r'))} AS "ratio_totalBytes_pktCount", {st(_z('g'))} AS "pktSize_mean", {st(_z('tr'))} AS "timingRegularity", {st(_z('u'))} AS "unusualPktSize", {st(_z('n'))} AS "pktCount",
 {st(_z('s'))} AS "portScanSignature" FROM e""")
def j09(spark, sf):
    f = flow_features(spark, sf)
    fitted = en.fit_engineer(f, ["flow_id"], inputs=5, outputs=4)
    return settle(en.engineer(f, fitted).select("flow_id", "ratio_totalBytes_pktCount", "pktSize_mean", "timingRegularity", "unusualPktSize", "pktCount", "portScanSignature"))


def _rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


@query("J10_simple_features", f"""WITH {v.FLOWS}, q AS (SELECT quantile_cont(price, 0.1) AS q10, quantile_cont(price, 0.75) AS q75, quantile_cont(price, 0.9) AS q90, count(*) AS n FROM flows)
SELECT row_id, CAST(price > q75 AS BIGINT) AS burst_count, {st('CAST(price > q75 AS INTEGER) / n')} AS burst_ratio, {st('price / (quantity + 1e-10)')} AS ratio_price_quantity,
 CAST(price > q90 AS BIGINT) AS high_activity, CAST(price < q10 AS BIGINT) AS low_activity, {st(_rank_sql('price'))} AS rank_price, {st(_rank_sql('quantity'))} AS rank_quantity, {st(_rank_sql('tax'))} AS rank_tax FROM flows, q""")
def j10(spark, sf):
    out = en.simple_features(v.flow_table(spark, sf), "row_id", ["price", "quantity", "tax"])
    return settle(out.select("row_id", "burst_count", "burst_ratio", "ratio_price_quantity", "high_activity", "low_activity", "rank_price", "rank_quantity", "rank_tax"))


NUM = ["quantity", "price", "discount", "tax", "line"]


def _union(f):
    return " UNION ALL ".join(f(c) for c in NUM)


@query("K01_variance_threshold", f"WITH {v.FLOWS} " + _union(lambda c: f"SELECT '{c}' AS feature, {st(f'var_pop({c})')} AS score, var_pop({c}) > 0.01 AS selected FROM flows"))
def k01(spark, sf):
    return settle(se.variance_scores(v.flow_table(spark, sf), NUM))


ANOVA = "an AS (" + _union(lambda c: f"""SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM
 (SELECT label, CAST(count(*) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM flows) AS g FROM flows GROUP BY 1)""") + ")"


@query("K02_anova_top_k", f"WITH {v.FLOWS}, {ANOVA} SELECT feature, {st('score')} AS score FROM an ORDER BY an.score DESC LIMIT 3")
def k02(spark, sf):
    return settle(se.top_features(se.anova_scores(v.flow_table(spark, sf), NUM, "label"), 3))


@query("K03_mutual_information", f"WITH {v.FLOWS}, mi AS (" + _union(lambda c: f"""SELECT '{c}' AS feature, sum(n / a * ln(n * a / (x * y))) AS score FROM (SELECT n, sum(n) OVER (PARTITION BY b) AS x, sum(n) OVER (PARTITION BY label) AS y, sum(n) OVER () AS a FROM
 (SELECT label, least(floor(({c} - lo) / ((hi - lo) / CAST(10 AS DOUBLE))) + 1, 10) AS b, CAST(count(*) AS DOUBLE) AS n FROM flows, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM flows) GROUP BY 1, 2))""")
       + f") SELECT feature, {st('score')} AS score FROM mi ORDER BY mi.score DESC LIMIT 3")
def k03(spark, sf):
    return settle(se.top_features(se.mutual_information(v.flow_table(spark, sf), NUM, "label"), 3))


def _with_copies(spark, sf):
    return v.flow_table(spark, sf).withColumns({"gross": F.col("price") * (1 + F.col("tax")), "net": F.col("quantity") * 2 + F.col("tax")})


_COPY = ["quantity", "price", "gross", "net"]
_CORR = """cf AS (SELECT quantity, price, price * (1 + tax) AS gross, quantity * 2 + tax AS net FROM flows),
cr AS (SELECT 'quantity' AS feature, CAST(0 AS DOUBLE) AS score UNION ALL SELECT 'price', abs(corr(quantity, price)) FROM cf UNION ALL SELECT 'gross', greatest(abs(corr(quantity, gross)), abs(corr(price, gross))) FROM cf
 UNION ALL SELECT 'net', greatest(abs(corr(quantity, net)), abs(corr(price, net)), abs(corr(gross, net))) FROM cf)"""


@query("K07_correlation_pruning", f"WITH {v.FLOWS}, {_CORR} SELECT feature, {st('score')} AS score, score <= 0.95 AS selected FROM cr")
def k07(spark, sf):
    return settle(se.correlation_pruning(_with_copies(spark, sf), _COPY))


@query("K08_selection_vote", f"""WITH {v.FLOWS}, {_CORR}, va AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, var_pop({c}) > 100 AS selected FROM cf" for c in _COPY)}),
an AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM
 (SELECT label, CAST(count(*) AS DOUBLE) AS n, avg({c}) AS m, var_pop({c}) AS v, any_value(g) AS g FROM (SELECT label, {e} AS {c}, avg({e}) OVER () AS g FROM flows) GROUP BY 1)''' for c, e in
 (('quantity', 'quantity'), ('price', 'price'), ('gross', 'price * (1 + tax)'), ('net', '(quantity * 2 + tax)')))}),
v AS (SELECT feature, selected FROM va UNION ALL SELECT feature, score <= 0.95 FROM cr UNION ALL SELECT feature, row_number() OVER (ORDER BY score DESC, feature) <= 2 FROM an)
SELECT feature, CAST(count(*) FILTER (selected) AS BIGINT) AS votes FROM v GROUP BY 1 HAVING count(*) FILTER (selected) / 3 >= 0.5""")
def k08(spark, sf):
    f = _with_copies(spark, sf)
    return settle(se.vote([se.variance_scores(f, _COPY, 100.0), se.correlation_pruning(f, _COPY), se.mark_top(se.anova_scores(f, _COPY, "label"), 2)]))


@query("K04_tree_importance")
def k04(spark, sf):
    return se.tree_importance(_with_copies(spark, sf), [*NUM, "gross", "net"], "attack", trees=10)


@query("K04_boosted_importance")
def k04b(spark, sf):
    return se.tree_importance(_with_copies(spark, sf), NUM, "attack", "gbt", "mean", 3, trees=3, depth=3)


@query("K05_recursive_elimination")
def k05(spark, sf):
    return se.recursive_elimination(_with_copies(spark, sf), NUM, "attack", 3, trees=5)


@query("K06_lasso_selection")
def k06(spark, sf):
    return se.lasso_selection(_with_copies(spark, sf), NUM, "price", "row_id")


@query("K06_lasso_path")
def k06b(spark, sf):
    return gr.cross_validated_lasso(_with_copies(spark, sf), NUM, "price", "row_id")[1]


# quantity is missing on some rows, so pairs have unlike numbers of rows
_HOLES = ["quantity", "price", "tax", "gross"]


@query("K07_gram_matrix", f"""WITH {v.FLOWS}, h AS (SELECT CASE WHEN line <> 3 THEN quantity END AS quantity, price, CASE WHEN line <> 4 THEN tax END AS tax, price * (1 + tax) AS gross FROM flows)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, CAST(regr_count({a}, {b}) AS BIGINT) AS n, {sts(f'regr_avgy({a}, {b}) AS mean_first', f'regr_avgx({a}, {b}) AS mean_second', f'covar_samp({a}, {b}) AS covariance', f'corr({a}, {b}) AS corr')} FROM h"
    for i, a in enumerate(_HOLES) for b in _HOLES[i:]))
def k07b(spark, sf):
    f = _with_copies(spark, sf).withColumns({"quantity": F.when(F.col("line") != 3, F.col("quantity")), "tax": F.when(F.col("line") != 4, F.col("tax"))})
    return settle(gr.gram_matrix(f, _HOLES))


@query("K09_pca_components")
def k09(spark, sf):
    out = se.pca_components(_with_copies(spark, sf), [*NUM, "gross", "net"], "row_id", 3)
    return out.select("row_id", *[F.round(F.get("components", F.lit(i)), 4).alias(f"c{i}") for i in range(3)])


_RANKED = "SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM flows"


@query("L01_stratified_split", f"""WITH {v.FLOWS}, r AS ({_RANKED})
SELECT row_id, CASE WHEN rn <= floor(n * (1.0::DOUBLE - 0.15 - 0.15)) THEN 'train' WHEN rn <= floor(n * (1.0::DOUBLE - 0.15)) THEN 'validation' ELSE 'test' END AS split FROM r""")
def l01(spark, sf):
    return sa.stratified_split(v.flow_table(spark, sf), "row_id", "label").select("row_id", "split")


_UNIT = "(CAST('0x' || substr(md5(row_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


@query("L02_random_split", f"""WITH {v.FLOWS} SELECT row_id, CASE WHEN {_UNIT} < 1.0::DOUBLE - 0.15 - 0.15 THEN 'train' WHEN {_UNIT} < 1.0::DOUBLE - 0.15 THEN 'validation' ELSE 'test' END AS split FROM flows""")
def l02(spark, sf):
    return sa.random_split(v.flow_table(spark, sf), "row_id").select("row_id", "split")


@query("L03_stratified_sample", f"WITH {v.FLOWS}, r AS ({_RANKED}) SELECT row_id, label FROM r WHERE rn <= floor(n * least(1.0::DOUBLE, 5000.0::DOUBLE / total) + 0.5)")
def l03(spark, sf):
    return sa.stratified_sample(v.flow_table(spark, sf), "row_id", "label", 5000).select("row_id", "label")


@query("L04_bounded_holdout", f"WITH {v.FLOWS} SELECT row_id FROM flows WHERE {_UNIT} < 0.2 ORDER BY md5(row_id), row_id LIMIT 2000")
def l04(spark, sf):
    return sa.bounded_holdout(v.flow_table(spark, sf), "row_id", 0.2, 2000).select("row_id")


@query("L05_stratified_folds", f"WITH {v.FLOWS}, r AS ({_RANKED}) SELECT row_id, CAST((rn - 1) % 5 AS BIGINT) AS fold FROM r")
def l05(spark, sf):
    return settle(sa.fold_numbers(v.flow_table(spark, sf), "row_id", 5, "label").select("row_id", "fold"))


@query("L05_plain_folds", f"WITH {v.FLOWS} SELECT row_id, (row_number() OVER (ORDER BY md5(row_id), row_id) - 1) % 5 AS fold FROM flows")
def l05b(spark, sf):
    return settle(sa.fold_numbers(v.flow_table(spark, sf), "row_id", 5).select("row_id", "fold"))


@query("L05_fold_summary", f"""WITH {v.PRED}, r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(row_id), row_id) - 1) % 5 AS fold FROM pred),
m AS (SELECT fold, avg(CAST(y = pred AS INTEGER)) AS accuracy, 2 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)) AS f1 FROM r GROUP BY 1)
SELECT 'accuracy' AS metric, {sts('avg(accuracy) AS mean', 'stddev_pop(accuracy) AS std')} FROM m UNION ALL SELECT 'f1', {sts('avg(f1) AS mean', 'stddev_pop(f1) AS std')} FROM m""")
def l05c(spark, sf):
    p = sa.fold_numbers(v.predictions(spark, sf), "row_id", 5, "label")
    rep = me.class_report(me.contingency(p, by=["fold"]), ["fold"]).where(F.col("cls") == 1).select("fold", "f1")
    acc = me.basic_metrics(p, by=["fold"]).select("fold", "accuracy")
    return settle(sa.fold_summary(acc.join(rep, "fold"), ["accuracy", "f1"]))


@query("L06_balanced_oversample", """WITH r AS (SELECT event_id, CASE WHEN value > 60 THEN 'big' WHEN value > 25 THEN 'mid' ELSE 'small' END AS label FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM r), m AS (SELECT max(n) AS m FROM k)
SELECT event_id, label, unnest(range(1, CAST((m - rn) // n + 2 AS BIGINT))) AS copy FROM k, m""")
def l06(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", F.when(F.col("value") > 60, "big").when(F.col("value") > 25, "mid").otherwise("small").alias("label"))
    return settle(sa.balanced_oversample(e, "event_id", "label").select("event_id", "label", "copy"))


@query("A12_head_per_file", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 10")
def a12(spark, sf):
    return sa.head_per_file(v.table(spark, sf, "documents"), "source", "doc_id", 10).select("doc_id", "source")
