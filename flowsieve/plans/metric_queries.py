"""Queries for prediction combination (N), evaluation (O) and thresholds (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import stable
from flowsieve.operators import alerts as al, metrics as me, thresholds as th
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _votes(spark, sf):
    p = v.predictions(spark, sf)
    third = (F.col("quantity") > 25).cast("int")
    return p.select("row_id", F.explode(F.array("pred", "pred2", third)).alias("cls"))


@query("N01_majority_vote", f"""WITH {v.PRED}, s AS (SELECT row_id, pred + pred2 + CAST(quantity > 25 AS INTEGER) AS k FROM pred)
SELECT row_id, CAST(k >= 2 AS BIGINT) AS pred, CAST(greatest(k, 3 - k) AS BIGINT) AS votes FROM s""")
def n01(spark, sf):
    return settle(al.majority_vote(_votes(spark, sf), "row_id"))


def _two_models(spark, sf):
    p = v.predictions(spark, sf)
    return p.withColumns({"a": F.array(1 - F.col("p"), F.col("p")), "b": F.array(1 - F.col("p2"), F.col("p2"))})


@query("N02_average_probabilities", f"""WITH {v.PRED}, m AS (SELECT row_id, (1-p)*0.5 + (1-p2)*0.5 AS m0, p*0.5 + p2*0.5 AS m1, (1-p)*0.75 + (1-p2)*0.25 AS w0, p*0.75 + p2*0.25 AS w1 FROM pred)
SELECT row_id, {st('m1')} AS mean_p1, {st('w1')} AS weighted_p1 FROM m""")
def n02(spark, sf):
    d = _two_models(spark, sf)
    return settle(d.select("row_id", F.element_at(al.average_probabilities(["a", "b"]), 2).alias("mean_p1"),
                           F.element_at(al.average_probabilities(["a", "b"], [3.0, 1.0]), 2).alias("weighted_p1")))


@query("N02_average_long", f"""WITH {v.PRED}, m AS (SELECT row_id, ((1-p)*3 + (1-p2)*1)/4 AS m0, (p*3 + p2*1)/4 AS m1 FROM pred)
SELECT row_id, {st('greatest(m0, m1)')} AS confidence FROM m""")
def n02b(spark, sf):
    d = _two_models(spark, sf)
    models = F.array(F.struct(F.lit(3.0).alias("w"), F.col("a").alias("proba")), F.struct(F.lit(1.0).alias("w"), F.col("b").alias("proba")))
    long = d.select("row_id", F.explode(models).alias("m")).select("row_id", "m.*")
    return settle(al.average_long(long, "row_id", "w").select("row_id", "confidence"))


_CONF = "greatest({p}, 1 - {p})"


@query("N03_agree_or_surer", f"""WITH {v.PRED}, c AS (SELECT *, {_CONF.format(p='p')} AS c1, {_CONF.format(p='p2')} AS c2 FROM pred)
SELECT row_id, CAST(CASE WHEN pred = pred2 OR c1 >= c2 THEN pred ELSE pred2 END AS BIGINT) AS cls,
 {st('CASE WHEN pred = pred2 THEN (c1 + c2) / 2 ELSE greatest(c1, c2) END')} AS confidence FROM c""")
def n03(spark, sf):
    p = v.predictions(spark, sf).withColumns({"c1": F.greatest(F.col("p"), 1 - F.col("p")), "c2": F.greatest(F.col("p2"), 1 - F.col("p2"))})
    cls, conf = al.agree_or_surer("pred", "c1", "pred2", "c2")
    return settle(p.select("row_id", cls.alias("cls"), conf.alias("confidence")))


@query("N04_confidence_gate", f"""WITH {v.CLASS_PRED} SELECT row_id, CAST(CASE WHEN greatest(a, b, c) >= 0.5 THEN pred ELSE -1 END AS BIGINT) AS gated FROM cls""")
def n04(spark, sf):
    return settle(v.class_predictions(spark, sf).select("row_id", al.confidence_gate("proba", 0.5).alias("gated")))


_RISK = "CASE WHEN {s} >= 0.8 THEN 'critical' WHEN {s} >= 0.6 THEN 'high' WHEN {s} >= 0.3 THEN 'medium' ELSE 'low' END"


@query("N05_risk_level", f"""WITH {v.PRED} SELECT row_id, {_RISK.format(s='p')} AS risk_level,
 CASE WHEN p < 0.5 THEN 'Monitor traffic' ELSE 'Block connection' END AS recommendation FROM pred""")
def n05(spark, sf):
    return al.with_risk(v.predictions(spark, sf), "p").select("row_id", "risk_level", "recommendation")


@query("N06_alert_rows", f"WITH {v.PRED} SELECT row_id, {_RISK.format(s='p')} AS risk_level, {st('p')} AS p FROM pred WHERE p >= 0.6")
def n06(spark, sf):
    return settle(al.alert_rows(al.with_risk(v.predictions(spark, sf), "p")).select("row_id", "risk_level", "p"))


@query("N07_fingerprint_reuse", f"""WITH {v.PACKETS}, f AS (SELECT pkt_id, md5('u' || flow_id || ':' || 5 || '-' || dst_ip || ':' || 443 || '-' || 1) AS fingerprint, t,
 floor(t / 3600) AS w FROM packets)
SELECT pkt_id, fingerprint, row_number() OVER (PARTITION BY fingerprint, w ORDER BY t, pkt_id) > 1 AS reused,
 first_value(pkt_id) OVER (PARTITION BY fingerprint, w ORDER BY t, pkt_id) AS source_row FROM f""")
def n07(spark, sf):
    p = v.packets(spark, sf).withColumns({"src": F.concat(F.lit("u"), "flow_id"), "sport": F.lit(5), "dport": F.lit(443)})
    f = p.withColumn("fingerprint", al.flow_fingerprint("src", "sport", "dst_ip", "dport", F.lit(1)))
    return al.reuse_results(f, "fingerprint", "t", "pkt_id", 3600).select("pkt_id", "fingerprint", "reused", "source_row")


@query("N08_traffic_mix", f"""WITH {v.PACKETS} SELECT protocol, count(*) AS n, count(*) FILTER (label <> 0) AS threats, {sts('avg(size) AS size_mean', 'min(size) AS size_min', 'max(size) AS size_max',
 'count(*) * 100.0 / sum(count(*)) OVER () AS percent', 'count(*) FILTER (label <> 0) / count(*) AS threat_rate')} FROM packets GROUP BY 1""")
def n08(spark, sf):
    return settle(al.traffic_mix(v.packets(spark, sf), "protocol", "size", "label"))


@query("N08_size_summary", f"WITH {v.PACKETS} SELECT {sts('avg(size) AS mean', 'min(size) AS min', 'max(size) AS max', 'median(size) AS median')} FROM packets")
def n08b(spark, sf):
    return settle(al.size_summary(v.packets(spark, sf), "size"))


@query("N09_model_agreement", f"WITH {v.PRED} SELECT count(*) AS n, count(*) FILTER (pred = pred2) AS agreements, {st('avg(CAST(pred = pred2 AS INTEGER))')} AS agreement_rate FROM pred")
def n09(spark, sf):
    return settle(al.model_agreement(v.predictions(spark, sf), "pred", "pred2"))


@query("N09_model_summary", f"""WITH {v.PRED}, l AS (SELECT 'first' AS model, pred AS cls, {_CONF.format(p='p')} AS c FROM pred UNION ALL SELECT 'second', pred2, {_CONF.format(p='p2')} FROM pred)
SELECT model, CAST(cls AS BIGINT) AS cls, count(*) AS n, {st('avg(c)')} AS mean_confidence FROM l GROUP BY 1, 2""")
def n09b(spark, sf):
    p = v.predictions(spark, sf)
    long = p.select(F.explode(F.array(
        F.struct(F.lit("first").alias("model"), F.col("pred").alias("cls"), F.greatest(F.col("p"), 1 - F.col("p")).alias("c")),
        F.struct(F.lit("second").alias("model"), F.col("pred2").alias("cls"), F.greatest(F.col("p2"), 1 - F.col("p2")).alias("c")),
    )).alias("m")).select("m.*")
    return settle(al.model_summary(long, "model", "cls", "c"))


# per-class report of the three-class predictions
REPORT = """rep0 AS (SELECT {by} k AS cls, count(*) FILTER (y = k) AS support, count(*) FILTER (pred = k) AS predicted, count(*) FILTER (y = k AND pred = k) AS tp, count(*) AS total
  FROM cls, (VALUES (0), (1), (2)) v(k) GROUP BY ALL),
rep AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rep0)"""

_WEIGHTED = [f"sum({m} * support) / sum(support) AS {m}_weighted" for m in ("precision", "recall", "f1")]
_MACRO = [f"avg({m}) AS {m}_macro" for m in ("precision", "recall", "f1")]


@query("O01_basic_metrics", f"WITH {v.CLASS_PRED}, {REPORT.format(by='')} SELECT {sts('sum(tp) / sum(support) AS accuracy', *_MACRO, *_WEIGHTED)} FROM rep")
def o01(spark, sf):
    return settle(me.basic_metrics(v.class_predictions(spark, sf)))


_BIN = """b AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn,
 count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn FROM pred)"""


@query("O02_confusion_rates", f"""WITH {v.PRED}, {_BIN} SELECT tp, tn, fp, fn, {sts('tp/(tp+fn) AS tpr', 'tn/(tn+fp) AS tnr', 'fp/(fp+tn) AS fpr', 'fn/(fn+tp) AS fnr')} FROM b""")
def o02(spark, sf):
    return settle(me.confusion_rates(v.predictions(spark, sf)))


@query("O02_confusion_shares", f"""WITH {v.CLASS_PRED} SELECT CAST(y AS BIGINT) AS true, CAST(pred AS BIGINT) AS pred, count(*) AS n,
 {st('count(*) / sum(count(*)) OVER (PARTITION BY y)')} AS share FROM cls GROUP BY y, pred""")
def o02b(spark, sf):
    return settle(me.confusion_shares(v.class_predictions(spark, sf)))


_MCC = "(CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn) / (sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn))"


@query("O03_ids_metrics", f"""WITH {v.PRED}, {_BIN} SELECT {sts('tp/(tp+fn) AS detection_rate', 'fp/(fp+tn) AS false_alarm_rate', 'fn/(fn+tp) AS miss_rate', 'tp/(tp+fp) AS attack_precision',
 'tn/(tn+fp) AS specificity', _MCC + ' AS mcc', 'sqrt(tp/(tp+fn) * (tn/(tn+fp))) AS g_mean')} FROM b""")
def o03(spark, sf):
    return settle(me.ids_metrics(v.predictions(spark, sf)))


@query("O03_class_rates", f"""WITH {v.CLASS_PRED}, {REPORT.format(by='')} SELECT CAST(cls AS BIGINT) AS cls, tp, predicted - tp AS fp, support - tp AS fn, total - predicted - support + tp AS tn,
 {st('recall')} AS detection_rate, {st('(predicted - tp) / (total - support)')} AS false_alarm_rate FROM rep""")
def o03b(spark, sf):
    return settle(me.class_rates(v.class_predictions(spark, sf)))


CURVE = """d AS (SELECT p AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM pred GROUP BY 1),
curve0 AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM d WINDOW w AS (ORDER BY threshold DESC)),
curve AS (SELECT threshold, pos, neg, ap, an, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(ap - tp AS BIGINT) AS fn, CAST(an - fp AS BIGINT) AS tn FROM curve0)"""


@query("O04_roc_curve", f"""WITH {v.PRED}, {CURVE} SELECT {st('threshold')} AS threshold, {st('fp/an')} AS fpr, {st('tp/ap')} AS tpr FROM curve
 UNION ALL SELECT CAST(9 AS DOUBLE), 0, 0""")
def o04(spark, sf):
    return settle(me.roc_curve(v.predictions(spark, sf)).withColumn("threshold", F.least("threshold", F.lit(9.0))))


@query("O04_auc", f"""WITH {v.PRED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pred)
SELECT {st('(sum(r) FILTER (y = 1) - CAST(count(*) FILTER (y = 1) AS DOUBLE) * (count(*) FILTER (y = 1) + 1) / 2) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0))')} AS auc FROM r""")
def o04b(spark, sf):
    return settle(me.auc_scores(v.predictions(spark, sf)).select("auc"))


@query("O05_pr_curve", f"WITH {v.PRED}, {CURVE} SELECT {sts('threshold AS threshold', 'tp/(tp+fp) AS precision', 'tp/ap AS recall')} FROM curve")
def o05(spark, sf):
    return settle(me.pr_curve(v.predictions(spark, sf)))


@query("O05_average_precision", f"WITH {v.PRED}, {CURVE} SELECT {st('sum(pos / ap * (tp / (tp + fp)))')} AS average_precision FROM curve")
def o05b(spark, sf):
    return settle(me.auc_scores(v.predictions(spark, sf)).select("average_precision"))


@query("O06_multiclass_auc", f"""WITH {v.CLASS_PRED}, l AS (SELECT k, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS p, CAST(y = k AS INTEGER) AS hit FROM cls, (VALUES (0), (1), (2)) v(k)),
r AS (SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2 AS r FROM l),
u AS (SELECT k, CAST(count(*) FILTER (hit = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (hit = 0) AS DOUBLE) AS n0, sum(r) FILTER (hit = 1) AS s FROM r GROUP BY 1),
a AS (SELECT (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc, n1 FROM u)
SELECT {sts('avg(auc) AS auc_macro', 'sum(auc * n1) / sum(n1) AS auc_weighted', 'min(auc) AS auc_min', 'max(auc) AS auc_max')} FROM a""")
def o06(spark, sf):
    return settle(me.multiclass_auc(v.class_predictions(spark, sf)))


@query("O07_robustness", f"""WITH {v.PRED} SELECT {sts('avg(CAST(y = pred AS INTEGER)) AS clean_accuracy', 'avg(CAST(y = pred2 AS INTEGER)) AS adversarial_accuracy',
 'avg(CAST(y = pred2 AS INTEGER)) / avg(CAST(y = pred AS INTEGER)) AS robustness_score', 'count(*) FILTER (y = pred AND y <> pred2) / count(*) FILTER (y = pred) AS attack_success_rate',
 'avg(CAST(y = pred AS INTEGER)) - avg(CAST(y = pred2 AS INTEGER)) AS robustness_gap')} FROM pred""")
def o07(spark, sf):
    return settle(me.robustness_metrics(v.predictions(spark, sf), "y", "pred", "pred2"))


@query("O08_generalisation", f"""WITH {v.CLASS_PRED}, {REPORT.format(by='scenario,')}, m AS (SELECT scenario, sum(tp) / sum(support) AS acc, avg(f1) AS f1 FROM rep GROUP BY 1),
o AS (SELECT max(acc) FILTER (scenario = 'F') AS s, max(acc) FILTER (scenario = 'O') AS t, max(f1) FILTER (scenario = 'F') AS sf, max(f1) FILTER (scenario = 'O') AS tf,
 avg(f1) AS mf, stddev_pop(f1) AS sd, var_pop(f1) AS vr FROM m)
SELECT {sts('s AS source_accuracy', 't AS target_accuracy', 's - t AS accuracy_drop', 'sf - tf AS f1_drop', 't / s AS generalisation_ratio', '1 - abs(s - t) / s AS consistency',
 'mf AS cross_dataset_f1', '1 / (1 + sd / (mf + 1e-10)) AS cv_score', 'vr AS dataset_variance')} FROM o""")
def o08(spark, sf):
    return settle(me.generalisation(v.class_predictions(spark, sf), "scenario", "F", "O"))


@query("O09_latency_summary", f"""SELECT {sts('avg(value)*1000 AS avg_latency_ms', 'quantile_cont(value, 0.5)*1000 AS median_latency_ms', 'quantile_cont(value, 0.95)*1000 AS p95_latency_ms',
 'quantile_cont(value, 0.99)*1000 AS p99_latency_ms', 'max(value)*1000 AS max_latency_ms', 'min(value)*1000 AS min_latency_ms')} FROM events""")
def o09(spark, sf):
    return settle(me.latency_summary(v.table(spark, sf, "events"), "value"))


@query("O09_throughput_summary", f"""WITH r AS (SELECT (user_id + 1) / value AS rate FROM events)
SELECT {sts('avg(rate) AS avg_throughput', 'max(rate) AS max_throughput', 'min(rate) AS min_throughput', 'quantile_cont(rate, 0.5) AS median_throughput')} FROM r""")
def o09b(spark, sf):
    return settle(me.throughput_summary(v.table(spark, sf, "events").withColumn("n", F.col("user_id") + 1), "n", "value"))


KPI_CORE = REPORT.format(by="") + """,
kw AS (SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
 sum(f1 * support) / sum(support) AS f1_score, CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c,
 sum(CAST(support AS DOUBLE) * predicted) AS tp_, sum(CAST(predicted AS DOUBLE) * predicted) AS pp, sum(CAST(support AS DOUBLE) * support) AS tt FROM rep),
kr AS (SELECT count(*) FILTER (y <> 0 AND pred <> 0) / count(*) FILTER (y <> 0) AS detection_rate, count(*) FILTER (y = 0 AND pred <> 0) / count(*) FILTER (y = 0) AS false_positive_rate FROM cls),
ka AS (SELECT (sum(r) FILTER (hit) - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc_roc FROM
 (SELECT y <> 0 AS hit, rank() OVER (ORDER BY 1 - a) + (count(*) OVER (PARTITION BY 1 - a) - 1) / 2 AS r,
  CAST(count(*) FILTER (y <> 0) OVER () AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) OVER () AS DOUBLE) AS n0 FROM cls) GROUP BY n1, n0)"""


@query("O10_kpi_core", f"""WITH {v.CLASS_PRED}, {KPI_CORE}
SELECT {sts('accuracy AS accuracy', 'precision AS precision', 'recall AS recall', 'f1_score AS f1_score', '(c * s - tp_) / (sqrt(s*s - pp) * sqrt(s*s - tt)) AS mcc',
 'detection_rate AS detection_rate', 'false_positive_rate AS false_positive_rate', 'auc_roc AS auc_roc')} FROM kw, kr, ka""")
def o10(spark, sf):
    return settle(me.kpi_core(v.class_predictions(spark, sf)))


@query("O11_kpi_score", f"""WITH {v.CLASS_PRED}, {REPORT.format(by='scenario,')}, m AS (SELECT scenario, sum(f1 * support) / sum(support) AS f1 FROM rep GROUP BY 1),
r AS (SELECT scenario, count(*) FILTER (y <> 0 AND pred <> 0) / count(*) FILTER (y <> 0) AS dr, count(*) FILTER (y = 0 AND pred <> 0) / count(*) FILTER (y = 0) AS fpr,
 avg(CAST(y = pred AS INTEGER)) AS adv, avg(a) * 400 AS lat FROM cls GROUP BY 1),
k AS (SELECT *, avg(f1) OVER () AS cf FROM m JOIN r USING (scenario))
SELECT scenario, {st('''0.25 * least(dr / 0.95, 1) + 0.20 * CASE WHEN fpr <= 0.02 THEN 1 ELSE greatest(0, 1 - (fpr - 0.02) / 0.1) END + 0.20 * least(adv / 0.9, 1)
 + 0.15 * least(cf / 0.85, 1) + 0.10 * least(f1 / 0.9, 1) + 0.10 * CASE WHEN lat <= 100 THEN 1 ELSE greatest(0, 1 - (lat - 100) / 100) END''')} AS overall_score,
 dr >= 0.95 AS ok_detection_rate, fpr <= 0.02 AS ok_false_positive_rate, lat <= 100 AS ok_average_latency_ms,
 dr >= 0.95 AND fpr <= 0.02 AND f1 >= 0.9 AND adv >= 0.9 AND cf >= 0.85 AND lat <= 100 AS ok_overall FROM k""")
def o11(spark, sf):
    from pyspark.sql import Window

    c = v.class_predictions(spark, sf)
    core = me.kpi_core(c, by=["scenario"])
    rest = c.groupBy("scenario").agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("adversarial_detection_rate"),
                                     (F.avg(F.element_at("proba", 1)) * 400).alias("average_latency_ms"))
    m = core.join(rest, "scenario").withColumn("cross_dataset_f1", F.avg("f1_score").over(Window.partitionBy()))
    return settle(me.kpi_score(m).select("scenario", "overall_score", "ok_detection_rate", "ok_false_positive_rate", "ok_average_latency_ms", "ok_overall"))


@query("O12_class_report", f"""WITH {v.CLASS_PRED}, {REPORT.format(by='scenario,')} SELECT scenario, CAST(cls AS BIGINT) AS cls, support, {sts('precision AS precision', 'recall AS recall', 'f1 AS f1')} FROM rep""")
def o12(spark, sf):
    c = v.class_predictions(spark, sf)
    return settle(me.class_report(me.contingency(c, by=["scenario"]), ["scenario"]).select("scenario", "cls", "support", "precision", "recall", "f1"))


@query("O13_split_distribution", f"WITH {v.FLOWS} SELECT label, count(*) FILTER (scenario = 'F') AS \"F\", count(*) FILTER (scenario = 'O') AS \"O\" FROM flows GROUP BY 1")
def o13(spark, sf):
    return settle(me.split_distribution(v.flow_table(spark, sf), "scenario", "label", ["F", "O"]))


@query("O14_melt_metrics", f"""WITH {v.CLASS_PRED}, {REPORT.format(by='scenario,')}, m AS (SELECT scenario, {sts('sum(tp) / sum(support) AS accuracy', 'avg(f1) AS f1_macro')} FROM rep GROUP BY 1)
SELECT scenario, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT scenario, 'f1_macro', f1_macro FROM m""")
def o14(spark, sf):
    return settle(me.melt_metrics(me.basic_metrics(v.class_predictions(spark, sf), by=["scenario"]), "scenario", ["accuracy", "f1_macro"]))


@query("O15_histogram", f"""WITH {v.PACKETS}, r AS (SELECT min(size) AS lo, max(size) AS hi FROM packets),
h AS (SELECT CAST(least(floor((size - lo) / ((hi - lo) / 30)) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM packets, r GROUP BY 1)
SELECT b AS bin, {st('lo + (hi - lo) / 30 * (b - 1)')} AS low, coalesce(n, 0) AS n FROM (SELECT CAST(range AS BIGINT) AS b FROM range(1, 31)) CROSS JOIN r LEFT JOIN h ON bin = b""")
def o15(spark, sf):
    return settle(me.histogram(v.packets(spark, sf), "size", 30))


METRICS_SQL = """, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr"""
_SHOW = "tp, fp, fn, tn, " + sts("threshold AS threshold", "precision AS precision", "recall AS recall", "f1 AS f1", "fpr AS fpr")
_COLS = ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"]


@query("T01_best_f1", f"WITH {v.PRED}, {CURVE}, m AS (SELECT * {METRICS_SQL} FROM curve) SELECT {_SHOW} FROM m ORDER BY m.f1 DESC, m.threshold LIMIT 1")
def t01(spark, sf):
    return settle(th.best_f1(v.predictions(spark, sf)).select(*_COLS))


@query("T02_best_for_recall", f"WITH {v.PRED}, {CURVE}, m AS (SELECT * {METRICS_SQL} FROM curve) SELECT {_SHOW} FROM m WHERE m.recall >= 0.7 ORDER BY m.precision DESC, m.threshold LIMIT 1")
def t02a(spark, sf):
    return settle(th.best_for_recall(v.predictions(spark, sf), 0.7).select(*_COLS))


@query("T02_best_for_precision", f"WITH {v.PRED}, {CURVE}, m AS (SELECT * {METRICS_SQL} FROM curve) SELECT {_SHOW} FROM m WHERE m.precision >= 0.33 ORDER BY m.recall DESC, m.threshold LIMIT 1")
def t02b(spark, sf):
    return settle(th.best_for_precision(v.predictions(spark, sf), 0.33).select(*_COLS))


@query("T02_best_for_fpr", f"WITH {v.PRED}, {CURVE}, m AS (SELECT * {METRICS_SQL} FROM curve) SELECT {_SHOW} FROM m WHERE m.fpr <= 0.2 ORDER BY m.recall DESC, m.threshold LIMIT 1")
def t02c(spark, sf):
    return settle(th.best_for_fpr(v.predictions(spark, sf), 0.2).select(*_COLS))


SWEEP = """cuts AS (SELECT CASE WHEN range = 100 THEN CAST(1 AS DOUBLE) ELSE range * CAST(0.01 AS DOUBLE) END AS threshold FROM range(0, 101)),
dist AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM pred GROUP BY 1),
tot AS (SELECT sum(pos) AS ap, sum(neg) AS an FROM dist),
sw0 AS (SELECT threshold, CAST(coalesce(sum(pos), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg), 0) AS BIGINT) AS fp FROM cuts LEFT JOIN dist ON p >= threshold GROUP BY 1),
sw1 AS (SELECT threshold, tp, fp, CAST(ap - tp AS BIGINT) AS fn, CAST(an - fp AS BIGINT) AS tn FROM sw0, tot),
sweep AS (SELECT * """ + METRICS_SQL + " FROM sw1)"
_SECURITY = "(0.7 * recall + 0.3 * specificity) * CASE WHEN recall < 0.95 THEN 0.5 ELSE 1 END * CASE WHEN fpr > 0.02 THEN 0.5 ELSE 1 END"


@query("T03_security_sweep", f"WITH {v.PRED}, {SWEEP} SELECT {_SHOW}, {st(_SECURITY)} AS score FROM sweep")
def t03(spark, sf):
    return settle(th.sweep_with_score(v.predictions(spark, sf), "security").select(*_COLS, "score"))


@query("T03_best_security", f"WITH {v.PRED}, {SWEEP}, z AS (SELECT *, round({_SECURITY}, 12) AS sc FROM sweep) SELECT {_SHOW} FROM z ORDER BY z.sc DESC, z.threshold LIMIT 1")
def t03b(spark, sf):
    p = v.predictions(spark, sf)
    return settle(th.best_of_sweep(p, F.round(th.security_score(), 12)).select(*_COLS))


@query("T04_sweep_by_metric", f"WITH {v.PRED}, {SWEEP}, a AS (SELECT 'f1' AS objective, * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1), b AS (SELECT 'recall' AS objective, * FROM sweep ORDER BY recall DESC, threshold LIMIT 1),"
       f" c AS (SELECT 'precision' AS objective, * FROM sweep ORDER BY precision DESC, threshold LIMIT 1) SELECT objective, {_SHOW} FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)")
def t04(spark, sf):
    p = v.predictions(spark, sf)
    parts = [th.best_of_sweep(p, o).select(F.lit(o).alias("objective"), *_COLS) for o in ("f1", "recall", "precision")]
    return settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("T05_metrics_at_threshold", f"""WITH {v.PRED}, b AS (SELECT CAST(0.35 AS DOUBLE) AS threshold, count(*) FILTER (y = 1 AND p >= 0.35) AS tp, count(*) FILTER (y = 0 AND p >= 0.35) AS fp,
 count(*) FILTER (y = 1 AND p < 0.35) AS fn, count(*) FILTER (y = 0 AND p < 0.35) AS tn FROM pred), m AS (SELECT * {METRICS_SQL} FROM b)
SELECT {_SHOW}, {sts('(tp+tn)/(tp+tn+fp+fn) AS accuracy', _MCC + ' AS mcc')} FROM m""")
def t05(spark, sf):
    return settle(th.metrics_at(v.predictions(spark, sf), 0.35).select(*_COLS, "accuracy", "mcc"))


@query("T05_apply_threshold", f"WITH {v.PRED} SELECT row_id, CAST(p >= 0.7 AS BIGINT) AS flagged FROM pred")
def t05b(spark, sf):
    return settle(th.apply_threshold(v.predictions(spark, sf), 0.7, "p", "flagged").select("row_id", "flagged"))


@query("T06_find_threshold", f"""WITH {v.PRED}, {CURVE}, m AS (SELECT * {METRICS_SQL} FROM curve), a AS (SELECT 'f1' AS objective, * FROM m ORDER BY f1 DESC, threshold LIMIT 1),
 b AS (SELECT 'recall' AS objective, * FROM m WHERE recall >= 0.95 ORDER BY precision DESC, threshold LIMIT 1) SELECT objective, {_SHOW} FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def t06(spark, sf):
    p = v.predictions(spark, sf)
    a = th.find_threshold(p, "f1").select(F.lit("f1").alias("objective"), *_COLS)
    return settle(a.unionByName(th.find_threshold(p, "recall").select(F.lit("recall").alias("objective"), *_COLS)))
