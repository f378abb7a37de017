"""Queries for cleaning (P), scaling (C) and combining (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import columns as fc
from flowsieve.operators import clean as cl, combine as cb, flows as fl, scale as sc
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts

NUM = ["quantity", "price", "tax"]


@query("P01_standard_names", """SELECT CAST(l_suppkey AS BIGINT) AS "srcIP", CAST(l_partkey AS BIGINT) AS "dstIP", CAST(l_linenumber AS BIGINT) AS "srcPort",
 l_returnflag AS label, l_quantity AS "flowDuration", l_tax AS other FROM lineitem""")
def p01(spark, sf):
    raw = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias(" Source IP"), F.col("l_partkey").alias("daddr"), F.col("l_linenumber").alias("sport "),
        F.col("l_returnflag").alias("attack_cat"), F.col("l_quantity").alias("dur"), F.col("l_tax").alias(" other"))
    return settle(cl.standard_names(raw), exact=("flowDuration", "other"))


@query("P02_camel_case", """WITH t AS (SELECT p_partkey, string_split(replace(replace(p_name || ' ' || p_brand || '-' || p_type || '_x', '-', '_'), ' ', '_'), '_') AS w FROM part)
SELECT p_partkey, lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') AS name FROM t""")
def p02(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", fc.camel_case(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit("-"), "p_type", F.lit("_x"))).alias("name"))


@query("P03_drop_columns", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def p03(spark, sf):
    return cl.drop_columns(v.table(spark, sf, "lineitem"), [
        "l_partkey", " l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"])


@query("P04_keep_numeric", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_brand AS label FROM part")
def p04(spark, sf):
    return settle(cl.keep_numeric(v.table(spark, sf, "part").withColumnRenamed("p_brand", "label")), exact=("p_retailprice",))


@query("P05_coerce_numeric", """SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS DOUBLE) AS k,
 CAST(CASE WHEN event_type = 'click' THEN value ELSE 0 END AS DOUBLE) AS x FROM events""")
def p05(spark, sf):
    e = v.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "click", F.col("value").cast("string")).otherwise(F.col("event_type")).alias("x"))
    return cl.coerce_numeric(e, ["k", "x"])


@query("P06_drop_non_finite", f"WITH {v.DIRTY} SELECT row_id, quantity, price, tax FROM blank WHERE quantity IS NOT NULL AND price IS NOT NULL AND tax IS NOT NULL")
def p06(spark, sf):
    return cl.mark_missing(v.dirty_flows(spark, sf)).select("row_id", *NUM).dropna()


@query("P07_fill_mean", f"""WITH {v.DIRTY} SELECT row_id, {', '.join(f"{st(f'coalesce({c}, (SELECT avg({c}) FROM blank))')} AS {c}" for c in NUM)} FROM blank""")
def p07a(spark, sf):
    return settle(cl.fill_missing(v.dirty_flows(spark, sf), "mean").select("row_id", *NUM))


@query("P07_fill_median", f"""WITH {v.DIRTY} SELECT row_id, {', '.join(f"{st(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM blank))')} AS {c}" for c in NUM)} FROM blank""")
def p07b(spark, sf):
    return settle(cl.fill_missing(v.dirty_flows(spark, sf), "median").select("row_id", *NUM))


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM blank WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("P07_fill_mode", f"""WITH {v.DIRTY} SELECT row_id, {', '.join(f"{st(f'coalesce({c}, {_mode(c)})')} AS {c}" for c in NUM)},
 coalesce(kind, {_mode('kind')}) AS kind FROM blank""")
def p07c(spark, sf):
    return settle(cl.fill_missing(v.dirty_flows(spark, sf), "mode", [*NUM, "kind"]).select("row_id", *NUM, "kind"))


@query("P07_fill_zero", f"""WITH {v.DIRTY} SELECT row_id, {', '.join(f"{st(f'coalesce({c}, 0)')} AS {c}" for c in NUM)} FROM blank""")
def p07d(spark, sf):
    return settle(cl.fill_missing(v.dirty_flows(spark, sf), "zero").select("row_id", *NUM))


@query("P07_fill_drop", f"WITH {v.DIRTY} SELECT row_id, kind FROM blank WHERE quantity IS NOT NULL AND price IS NOT NULL AND tax IS NOT NULL AND kind IS NOT NULL")
def p07e(spark, sf):
    return cl.fill_missing(v.dirty_flows(spark, sf), "drop").select("row_id", "kind")


@query("P08_drop_sparse_rows", f"""WITH {v.DIRTY} SELECT row_id FROM blank WHERE
 (CAST(quantity IS NULL AS INTEGER) + CAST(price IS NULL AS INTEGER) + CAST(tax IS NULL AS INTEGER) + CAST(kind IS NULL AS INTEGER)) / 4 < 0.3""")
def p08(spark, sf):
    return cl.drop_sparse_rows(cl.mark_missing(v.dirty_flows(spark, sf)), 0.3, [*NUM, "kind"]).select("row_id")


@query("P09_approximate_median", f"""WITH {v.DIRTY} SELECT row_id, {', '.join(f"{st(f'coalesce({c}, (SELECT quantile_disc({c}, 0.5) FROM blank))')} AS {c}" for c in ('quantity', 'tax'))} FROM blank""")
def p09(spark, sf):
    return settle(cl.impute_approximate_median(v.dirty_flows(spark, sf), ["quantity", "tax"]).select("row_id", "quantity", "tax"))


@query("P10_drop_duplicates", f"WITH {v.FLOWS} SELECT DISTINCT quantity, discount, tax, label FROM flows")
def p10(spark, sf):
    return cl.drop_duplicate_rows(v.flow_table(spark, sf).select("quantity", "discount", "tax", "label"))


def _iqr(c: str, rel: str, t: str) -> str:
    return f"""(SELECT f.* FROM {rel} f, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {rel})
 WHERE {c} >= a - {t} * (b - a) AND {c} <= b + {t} * (b - a))"""


@query("P11_iqr_sequential", f"""WITH {v.FLOWS}, p AS (SELECT row_id, price * price AS price, exp(quantity / 10) AS quantity FROM flows),
a AS {_iqr('price', 'p', '0.5')}, b AS {_iqr('quantity', 'a', '0.5')} SELECT row_id FROM b""")
def p11(spark, sf):
    f = v.flow_table(spark, sf).select("row_id", (F.col("price") * F.col("price")).alias("price"), F.exp(F.col("quantity") / 10).alias("quantity"))
    return cl.iqr_filter(f, ["price", "quantity"], 0.5).select("row_id")


@query("P11_iqr_one_pass", f"""WITH {v.FLOWS}, p AS (SELECT row_id, price * price AS price, exp(quantity / 10) AS quantity FROM flows),
a AS {_iqr('price', 'p', '0.5')}, b AS {_iqr('quantity', 'p', '0.5')} SELECT row_id FROM a SEMI JOIN b USING (row_id)""")
def p11b(spark, sf):
    f = v.flow_table(spark, sf).select("row_id", (F.col("price") * F.col("price")).alias("price"), F.exp(F.col("quantity") / 10).alias("quantity"))
    return cl.iqr_filter(f, ["price", "quantity"], 0.5, sequential=False).select("row_id")


@query("P12_zscore_filter", f"""WITH {v.FLOWS}, s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(quantity) AS mq, stddev_pop(quantity) AS sq FROM flows)
SELECT row_id FROM flows, s WHERE abs((price - mp) / sp) < 1.5 AND abs((quantity - mq) / sq) < 1.5""")
def p12(spark, sf):
    return cl.zscore_filter(v.flow_table(spark, sf), ["price", "quantity"], 1.5).select("row_id")


@query("P13_label_column", f"WITH {v.FLOWS} SELECT row_id, label AS y FROM flows")
def p13(spark, sf):
    f = v.flow_table(spark, sf)
    return f.select("row_id", F.col(cl.label_column(f.columns)).alias("y"))


_BENIGN_SQL = ", ".join(f"'{b}'" for b in cl.BENIGN)


@query("P14_binary_label", f"""SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 'BENIGN' WHEN 'view' THEN 'Normal' WHEN 'signup' THEN '0' ELSE event_type END
 NOT IN ({_BENIGN_SQL}) AS BIGINT) AS attack FROM events""")
def p14(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "click", "BENIGN").when(kind == "view", "Normal").when(kind == "signup", "0").otherwise(kind)
    return settle(v.table(spark, sf, "events").select("event_id", cl.binary_label(text).alias("attack")))


_FILE = "CASE {k} % 5 WHEN 0 THEN 'Scenario A1-VPN.arff' WHEN 1 THEN 'TimeBased-no-vpn.arff' WHEN 2 THEN 'flows_noVPN.csv' WHEN 3 THEN 'AllinOne.arff' ELSE 'other/Scenario A1 x.csv' END"


def _file_name(key):
    k = F.col(key) % 5
    return (F.when(k == 0, "Scenario A1-VPN.arff").when(k == 1, "TimeBased-no-vpn.arff").when(k == 2, "flows_noVPN.csv")
            .when(k == 3, "AllinOne.arff").otherwise("other/Scenario A1 x.csv"))


@query("P15_vpn_label", f"""SELECT doc_id, CAST(CASE WHEN f LIKE '%no-vpn%' OR f LIKE '%novpn%' THEN 0 WHEN f LIKE '%vpn%' THEN 1 WHEN f LIKE '%allinone%' THEN -1 ELSE 0 END AS BIGINT) AS vpn,
 CAST(f LIKE '%vpn%' AS BIGINT) AS text_vpn FROM (SELECT doc_id, lower({_FILE.format(k='doc_id')}) AS f FROM documents)""")
def p15(spark, sf):
    return settle(v.table(spark, sf, "documents").select(
        "doc_id", cl.vpn_label(_file_name("doc_id")).alias("vpn"), cl.vpn_text_label(_file_name("doc_id")).alias("text_vpn")))


@query("P16_encryption_flag", f"""SELECT doc_id, flag FROM (SELECT doc_id, CAST(CASE WHEN f LIKE '%no-vpn%' OR f LIKE '%no_vpn%' OR f LIKE '%novpn%' THEN 0
 WHEN f LIKE '%vpn%' THEN 1 WHEN f LIKE '%scenario a1%' THEN 1 ELSE -1 END AS BIGINT) AS flag
 FROM (SELECT doc_id, lower({_FILE.format(k='doc_id')}) AS f FROM documents)) WHERE flag >= 0""")
def p16(spark, sf):
    out = v.table(spark, sf, "documents").select("doc_id", cl.encryption_flag(_file_name("doc_id")).alias("flag"))
    return settle(out.where(F.col("flag") >= 0))


@query("P17_label_text", "SELECT p_partkey, replace(trim('  ' || p_name || ' '), ' ', '_') AS label FROM part")
def p17(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", fc.label_text(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("label"))


@query("P18_flow_id", f"WITH {v.PACKETS} SELECT pkt_id, src_ip || ':' || k || '-' || dst_ip || ':' || dst_port || '-' || protocol AS flow_key FROM packets")
def p18(spark, sf):
    return v.packets(spark, sf).select("pkt_id", fc.flow_key("src_ip", "k", "dst_ip", "dst_port", "protocol").alias("flow_key"))


@query("P19_label_encode", """WITH c AS (SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 25))
SELECT p_partkey, CAST(coalesce(code, -1) AS BIGINT) AS code FROM part LEFT JOIN c ON p_name || CASE WHEN p_size = 50 THEN 'x' ELSE '' END = name""")
def p19(spark, sf):
    part = v.table(spark, sf, "part")
    codes = cl.fit_label_codes(part.where(F.col("p_size") <= 25), "p_name")
    seen = part.withColumn("p_name", F.concat("p_name", F.when(F.col("p_size") == 50, "x").otherwise("")))
    return settle(cl.apply_label_codes(seen, codes, "p_name", ["p_partkey"], "code").select("p_partkey", "code"))


@query("P20_rare_classes", """SELECT c_custkey, c_nationkey FROM (SELECT *, count(*) OVER (PARTITION BY floor(c_acctbal / 10)) AS n FROM customer) WHERE n >= 2""")
def p20(spark, sf):
    c = v.table(spark, sf, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 10))
    return cl.drop_rare_classes(c, "band", ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("P21_label_remap", "SELECT doc_id, CAST(CASE WHEN quality = 0 THEN 2 ELSE quality END AS BIGINT) AS label FROM labels")
def p21(spark, sf):
    x = F.when(F.col("quality") == 0, -1).otherwise(F.col("quality"))
    return settle(v.table(spark, sf, "labels").select("doc_id", cl.remap_label(x).alias("label")))


@query("P22_float32", f"WITH {v.FLOWS} SELECT row_id, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, CAST(CAST(tax AS FLOAT) AS DOUBLE) AS tax FROM flows")
def single_precision(spark, sf):
    f = cl.to_float32(v.flow_table(spark, sf))
    return f.select("row_id", F.col("price").cast("double").alias("price"), F.col("tax").cast("double").alias("tax"))


@query("C01_minmax_scale", f"""WITH {v.FLOWS}, s AS (SELECT min(price) AS a, max(price) AS b, min(tax) AS c, max(tax) AS d FROM flows)
SELECT row_id, {st('(price-a)/(b-a)')} AS price, {st('(tax-c)/(d-c)')} AS tax FROM flows, s""")
def c01(spark, sf):
    return settle(sc.scale(v.flow_table(spark, sf), ["price", "tax"], "minmax").select("row_id", "price", "tax"))


@query("C02_standard_scale", f"""WITH {v.FLOWS}, s AS (SELECT avg(price) AS a, stddev_pop(price) AS b, avg(tax) AS c, stddev_pop(tax) AS d FROM flows)
SELECT row_id, {st('(price-a)/b')} AS price, {st('(tax-c)/d')} AS tax, CAST(0 AS DOUBLE) AS flat FROM flows, s""")
def c02(spark, sf):
    f = v.flow_table(spark, sf).withColumn("flat", F.lit(7.0))
    return settle(sc.scale(f, ["price", "tax", "flat"], "standard").select("row_id", "price", "tax", "flat"))


@query("C03_robust_scale", f"""WITH {v.FLOWS}, s AS (SELECT quantile_cont(price, 0.5) AS a, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS b,
 quantile_cont(tax, 0.5) AS c, quantile_cont(tax, 0.75) - quantile_cont(tax, 0.25) AS d FROM flows)
SELECT row_id, {st('(price-a)/b')} AS price, {st('(tax-c)/d')} AS tax FROM flows, s""")
def c03(spark, sf):
    return settle(sc.scale(v.flow_table(spark, sf), ["price", "tax"], "robust").select("row_id", "price", "tax"))


@query("C04_log_scale", f"WITH {v.FLOWS} SELECT row_id, {st('ln(1 + abs(price))')} AS price FROM flows")
def c04(spark, sf):
    return settle(v.flow_table(spark, sf).select("row_id", sc.log_scale("price").alias("price")))


@query("C05_sqrt_scale", f"WITH {v.FLOWS} SELECT row_id, {st('sqrt(abs(price))')} AS price FROM flows")
def c05(spark, sf):
    return settle(v.flow_table(spark, sf).select("row_id", sc.sqrt_scale("price").alias("price")))


@query("C06_bounded_minmax", f"""WITH {v.DIRTY}, n AS (SELECT row_id, CASE WHEN price IS NULL OR isnan(price) THEN 0 WHEN isinf(price) THEN 1 ELSE price END AS price,
 coalesce(quantity, 0) AS quantity FROM dirty), s AS (SELECT min(price) AS a, max(price) AS b, min(quantity) AS c, max(quantity) AS d FROM n)
SELECT row_id, {st('(price-a)/(b-a)')} AS price, {st('(quantity-c)/(d-c)')} AS quantity FROM n, s""")
def c06(spark, sf):
    return settle(sc.scale(v.dirty_flows(spark, sf), ["price", "quantity"], "unit").select("row_id", "price", "quantity"))


@query("C07_fit_then_transform", f"""WITH {v.FLOWS}, s AS (SELECT avg(price) AS a, stddev_pop(price) AS b FROM flows WHERE scenario = 'F')
SELECT row_id, {st('(price-a)/b')} AS price FROM flows, s WHERE scenario = 'O'""")
def c07(spark, sf):
    f = v.flow_table(spark, sf)
    fitted = sc.fit_scaler(f.where(F.col("scenario") == "F"), ["price"], "standard")
    return settle(sc.apply_scaler(f.where(F.col("scenario") == "O"), fitted, ["price"]).select("row_id", "price"))


_KEYS = ["src_ip", "k", "dst_ip", "dst_port"]


@query("D01_enrich_flows", f"""WITH {v.PACKETS}, f AS (SELECT src_ip, k, dst_ip, dst_port, count(*) AS n, sum(size) AS bytes FROM packets GROUP BY ALL),
s AS (SELECT src_ip, k, dst_ip, dst_port, count(*) AS "tlsPktCount", avg(size) AS "tlsSizeMean" FROM packets WHERE protocol = 'TLS' GROUP BY ALL)
SELECT src_ip, k, dst_ip, dst_port, n, {st('bytes')} AS bytes, coalesce("tlsPktCount", 0) AS "tlsPktCount", {st('coalesce("tlsSizeMean", 0)')} AS "tlsSizeMean"
FROM f LEFT JOIN s USING (src_ip, k, dst_ip, dst_port)""")
def d01(spark, sf):
    p = v.packets(spark, sf)
    f = p.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    tls = p.where(F.col("protocol") == "TLS").groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("tlsPktCount"), F.avg("size").alias("tlsSizeMean"))
    return settle(cb.enrich_flows(f, tls, _KEYS))


@query("D02_label_features", f"""WITH {v.PACKETS}, f AS (SELECT flow_id, sum(size) AS bytes FROM packets WHERE direction = 'forward' GROUP BY 1),
l AS (SELECT flow_id, label FROM packets QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY t, pkt_id) = 1)
SELECT flow_id, {st('bytes')} AS bytes, CAST(label AS BIGINT) AS label FROM f JOIN l USING (flow_id)""")
def d02(spark, sf):
    p = v.packets(spark, sf)
    f = p.where(F.col("direction") == "forward").groupBy("flow_id").agg(F.sum("size").alias("bytes"))
    return settle(cb.label_features(f, p, "flow_id", "label", ["t", "pkt_id"]))


@query("D03_align_features", f"""WITH {v.PACKETS}, a AS (SELECT flow_id, count(*) AS n, min(size) AS lo FROM packets WHERE direction = 'forward' GROUP BY 1),
b AS (SELECT flow_id, max(size) AS hi FROM packets WHERE protocol = 'TLS' AND size > 20 GROUP BY 1)
SELECT flow_id, n, lo, hi FROM a FULL JOIN b USING (flow_id)""")
def d03(spark, sf):
    p = v.packets(spark, sf)
    a = p.where(F.col("direction") == "forward").groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"))
    b = p.where((F.col("protocol") == "TLS") & (F.col("size") > 20)).groupBy("flow_id").agg(F.max("size").alias("hi"), F.count(F.lit(1)).alias("n"))
    return cb.align_features([a, b], "flow_id")


@query("D04_stack_tables", """SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier""")
def d04(spark, sf):
    c = v.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = v.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return cb.stack_tables([c, s])


@query("D05_compare_labels", """WITH a AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT role AS label, count(*) AS n FROM conversations GROUP BY 1 UNION ALL SELECT 'click', count(*) FROM conversations WHERE turn = 0)
SELECT label, count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS n_rows, count(*) = 2 AS common FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def d05(spark, sf):
    e = v.table(spark, sf, "events").select("value", F.col("event_type").alias("label"))
    c = v.table(spark, sf, "conversations")
    c = c.select("turn", F.col("role").alias("label")).unionByName(c.where(F.col("turn") == 0).select("turn", F.lit("click").alias("label")))
    return settle(cb.compare_labels({"events": e, "conversations": c}))


@query("D05_dataset_profiles", f"""SELECT 'flows' AS dataset, count(*) AS n_rows, CAST(9 AS BIGINT) AS n_cols, 'label' AS label_column, count(DISTINCT l_returnflag) AS n_labels FROM lineitem
 UNION ALL SELECT 'documents', count(*), 5, 'n_chars', count(DISTINCT n_chars) FROM documents""")
def d05b(spark, sf):
    return settle(cb.dataset_profiles({"flows": v.flow_table(spark, sf), "documents": v.table(spark, sf, "documents")}))
