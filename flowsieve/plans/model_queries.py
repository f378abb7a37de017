"""Queries for streaming and change detection (S), robustness (R) and models (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import alerts as al, models as mo, reuse as ru, robustness as ro, stacking as sk
from flowsieve.operators.sampling import random_split
from flowsieve.plans import views as v
from flowsieve.plans.flow_queries import settle
from flowsieve.plans.registry import query, st, sts
from flowsieve.session import scratch_path
from flowsieve.streaming import change as ch, flows as sf_, keyed as ke, patterns as pa

ORDER = ["t", "pkt_id"]
IDLE = 7200

SESSIONS = f"""sn AS (SELECT *, sum(CASE WHEN iat IS NULL OR iat > {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS session FROM iat),
sess AS (SELECT flow_id, session, count(*) AS "pktCount", sum(size) AS "totalBytes", min(t) AS start, max(t) AS last FROM sn GROUP BY 1, 2)"""
_SESS = f'flow_id, "pktCount", {sts("""\"totalBytes\" AS "totalBytes\"""", "start AS start", "last AS last")}'


@query("S01_batch_sessions", f"WITH {v.IAT}, {SESSIONS} SELECT {_SESS} FROM sess")
def s01(spark, sf):
    return settle(sf_.batch_flows(v.packets(spark, sf), ["flow_id"], IDLE).drop("session"))


@query("S01_stream_sessions", f"WITH {v.IAT}, {SESSIONS} SELECT {_SESS} FROM sess")
def s01b(spark, sf):
    flows, _ = ke.run_to_end(spark, v.packet_stream(spark, sf), lambda p: sf_.stream_flows(p, ["flow_id"], IDLE), scratch_path(spark, "stream-flows"))
    return settle(flows)


_DRIFT = 24  # samples of a window

# segments: from one drift to the next; a segment's reference is the window that ended the one before
@query("S02_stream_drift", f"""WITH RECURSIVE {v.PACKETS}, r AS (SELECT flow_id, t, pkt_id, label, row_number() OVER w AS rn, sum(label) OVER w AS c FROM packets WINDOW w AS (PARTITION BY flow_id ORDER BY t, pkt_id)),
seg AS (SELECT flow_id, 0 AS s, CAST({_DRIFT // 2} AS BIGINT) AS from_rn, CAST(c AS BIGINT) AS wrong, CAST({_DRIFT // 2} AS BIGINT) AS counted FROM r WHERE rn = {_DRIFT // 2}
 UNION ALL SELECT flow_id, rn, rn + {_DRIFT // 2} - 1, wrong, counted FROM (
  SELECT j.flow_id, min(j.rn) AS rn, CAST(arg_min(j.inside, j.rn) AS BIGINT) AS wrong, CAST(arg_min(j.n, j.rn) AS BIGINT) AS counted FROM (
   SELECT seg.flow_id, seg.s, r.rn, r.c - coalesce(b.c, 0) AS inside, r.rn - greatest(seg.s, r.rn - {_DRIFT}) AS n, seg.wrong / seg.counted AS ref
   FROM seg JOIN r ON r.flow_id = seg.flow_id AND r.rn > seg.from_rn LEFT JOIN r b ON b.flow_id = r.flow_id AND b.rn = greatest(seg.s, r.rn - {_DRIFT})) j
  WHERE abs(j.inside / j.n - j.ref) > 0.2 GROUP BY j.flow_id, j.s)),
ends AS (SELECT *, lead(s) OVER (PARTITION BY flow_id ORDER BY s) AS hit FROM seg),
judged AS (SELECT r.*, e.s, e.hit, e.from_rn, abs((r.c - coalesce(b.c, 0)) / (r.rn - greatest(e.s, r.rn - {_DRIFT})) - e.wrong / e.counted) AS gap
 FROM r LEFT JOIN ends e ON e.flow_id = r.flow_id AND r.rn > e.s AND (e.hit IS NULL OR r.rn <= e.hit) LEFT JOIN r b ON b.flow_id = r.flow_id AND b.rn = greatest(e.s, r.rn - {_DRIFT}))
SELECT flow_id, t, pkt_id, label, coalesce(rn = hit, false) AS drift_now, coalesce(s > 0 OR rn = hit, false) AS drift,
 coalesce(rn > from_rn AND (hit IS NULL OR rn < hit) AND gap > 0.1, false) AS warning FROM judged""")
def s02(spark, sf):
    drift, _ = ke.run_to_end(spark, v.packet_stream(spark, sf), lambda p: ke.ordered_drift(p, "flow_id", "ts", ORDER, "label", _DRIFT, 0.2, 0.1), scratch_path(spark, "drift"))
    return drift


_W = 100


@query("S03_adjacent_window_drift", f"""WITH {v.PACKETS}, r AS (SELECT pkt_id, row_number() OVER (ORDER BY t, pkt_id) AS rn, avg(label) OVER (ORDER BY t, pkt_id ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW) AS cur,
 avg(label) OVER (ORDER BY t, pkt_id ROWS BETWEEN {2 * _W - 1} PRECEDING AND {_W} PRECEDING) AS ref FROM packets)
SELECT pkt_id, {sts('cur AS current_rate', 'ref AS reference_rate')}, round(abs(cur - ref), 9) > 0.1 AS drift FROM r WHERE rn >= {2 * _W}""")
def s03(spark, sf):
    out = ch.adjacent_window_drift(v.packets(spark, sf), ORDER, "label", _W)
    drift = F.round(F.abs(F.col("current_rate") - F.col("reference_rate")), 9) > 0.1
    return settle(out.withColumn("drift", drift).select("pkt_id", "current_rate", "reference_rate", "drift"))


_ADAPT = """fr AS (SELECT flow_id, pkt_id, rn, size, avg(size) OVER w + 3 * stddev_pop(size) OVER w AS f FROM iat WINDOW w AS (PARTITION BY flow_id ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
th AS (SELECT a.pkt_id, any_value(a.size) AS size, sum(CASE WHEN b.rn = 10 THEN 1 ELSE 0.1 END * b.f * pow(0.9, a.rn - b.rn)) AS threshold FROM fr a JOIN fr b ON a.flow_id = b.flow_id AND b.rn <= a.rn AND b.rn >= 10 WHERE a.rn >= 10 GROUP BY 1)"""


@query("S04_adaptive_threshold", f"WITH {v.IAT}, {_ADAPT} SELECT pkt_id, {st('threshold')} AS threshold, size > threshold AS anomaly FROM th UNION ALL SELECT pkt_id, NULL, false FROM iat WHERE rn < 10")
def s04(spark, sf):
    out = ch.adaptive_threshold(v.packets(spark, sf), ["flow_id"], ORDER, "size", size=20, least=10)
    return settle(out.select("pkt_id", "threshold", "anomaly"))


@query("S04_stream_threshold", f"WITH {v.IAT}, {_ADAPT} SELECT pkt_id, {st('threshold')} AS threshold, size > threshold AS anomaly FROM th UNION ALL SELECT pkt_id, NULL, false FROM iat WHERE rn < 10")
def s04b(spark, sf):
    work = lambda p: ke.ordered_threshold(p, "flow_id", "ts", ORDER, "size", size=20, least=10)
    out, _ = ke.run_to_end(spark, v.packet_stream(spark, sf), work, scratch_path(spark, "threshold"))
    return settle(out.select("pkt_id", "threshold", "anomaly"))


@query("S05_novelty_flags", "SELECT event_id, value > (SELECT quantile_cont(value, 0.95) FROM events WHERE event_type = 'click') AS novel FROM events")
def s05(spark, sf):
    e = v.table(spark, sf, "events")
    return ch.novelty_flags(e, e.where(F.col("event_type") == "click"), "value").select("event_id", "novel")


@query("S05_reconstruction_novelty")
def s05b(spark, sf):
    e = v.table(spark, sf, "embeddings")
    train, scored = ch.reconstruction_error(e.where(F.col("label") != 0), e, "embedding", 8)
    return ch.novelty_flags(scored, train, "error").select("vec_id", F.round("error", 6).alias("error"), "novel")


@query("S06_pattern_flags", """WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
c AS (SELECT label AS k, i, avg(e) AS c FROM x GROUP BY 1, 2), d AS (SELECT vec_id, k, sqrt(sum((e - c) * (e - c))) AS d FROM x JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, CAST(CAST(round(min(d), 9) + 0.0 AS FLOAT) AS DOUBLE) AS min_distance, min(d) > avg(d) + 2 * stddev_pop(d) AS new_pattern FROM d GROUP BY 1""")
def s06(spark, sf):
    e = v.table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("c"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("c")).orderBy("label").collect()
    out = ch.pattern_flags(e, "embedding", [[x["c"] for x in r["c"]] for r in rows])
    return settle(out.select("vec_id", "min_distance", "new_pattern"))


@query("S06_fitted_patterns")
def s06b(spark, sf):
    e = v.table(spark, sf, "embeddings")
    return ch.pattern_flags(e, "embedding", ch.fit_patterns(e, "embedding", 10)).select("vec_id", F.round("min_distance", 6).alias("min_distance"), "new_pattern")


@query("S06_stream_patterns")
def s06c(spark, sf):
    stream = v.table_stream(spark, sf, "embeddings")
    samples, _ = pa.watch_patterns(stream, "embedding", ["vec_id"], ["vec_id"], scratch_path(spark, "patterns"))
    return samples.select("vec_id", "window", F.round("min_distance", 6).alias("min_distance"), "new_pattern")


@query("S07_combined_flag", """SELECT event_id, CAST(value > 30 AS INTEGER) + CAST(event_type = 'error' AS INTEGER) + coalesce(CAST(CASE WHEN user_id % 2 = 0 THEN value > 50 END AS INTEGER), 0)
 >= floor((2 + CAST(user_id % 2 = 0 AS INTEGER)) / 2) AS flag FROM events""")
def s07(spark, sf):
    e = v.table(spark, sf, "events").withColumns({
        "a": F.col("value") > 30, "b": F.col("event_type") == "error", "c": F.when(F.col("user_id") % 2 == 0, F.col("value") > 50)})
    return e.select("event_id", ch.combined_flag(["a", "b", "c"]).alias("flag"))


_SCORE = "least(size / 100, 1)"


@query("S08_stream_alerts", f"""WITH {v.PACKETS} SELECT pkt_id, flow_id, {st(_SCORE)} AS threat_score, CASE WHEN {_SCORE} >= 0.8 THEN 'critical' ELSE 'high' END AS risk_level, 'Block connection' AS recommendation
FROM packets WHERE {_SCORE} >= 0.6""")
def s08(spark, sf):
    scored = sf_.score_stream(v.packet_stream(spark, sf), F.least(F.col("size") / 100, F.lit(1.0)), ["pkt_id", "flow_id"])
    return settle(sf_.run_and_read(spark, sf_.alerts_of(scored), scratch_path(spark, "alerts")))


_WINDOWS = f"SELECT CAST(floor(t / 3600) * 3600 AS BIGINT) AS window_start, protocol, count(*) AS requests, {st('avg(size)')} AS mean_latency, {st('quantile_disc(size, 0.95)')} AS p95_latency, {st('count(*) / 3600')} AS requests_per_second FROM packets GROUP BY 1, 2"


@query("S09_traffic_counters", f"WITH {v.PACKETS} {_WINDOWS}")
def s09(spark, sf):
    p = v.packets_of(v.table(spark, sf, "events"))
    return settle(sf_.traffic_counters(p, ["protocol"], "1 hour"))


@query("S09_stream_counters", f"WITH {v.PACKETS}, w AS ({_WINDOWS}) SELECT * FROM w")
def s09b(spark, sf):
    w, _ = ke.run_to_end(spark, v.packet_stream(spark, sf), lambda p: sf_.traffic_counters(p, ["protocol"], "1 hour", "10 minutes"), scratch_path(spark, "counters"))
    return settle(w)


@query("S10_flush_results", f"WITH {v.PACKETS} SELECT pkt_id, {st(_SCORE)} AS threat_score, CASE WHEN {_SCORE} >= 0.8 THEN 'critical' WHEN {_SCORE} >= 0.6 THEN 'high' WHEN {_SCORE} >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM packets")
def s10(spark, sf):
    scored = sf_.score_stream(v.packet_stream(spark, sf), F.least(F.col("size") / 100, F.lit(1.0)), ["pkt_id"])
    return settle(sf_.run_and_read(spark, scored, scratch_path(spark, "results"), "json").drop("recommendation"))


@query("N07_stream_reuse", f"""WITH {v.PACKETS} SELECT DISTINCT md5(concat_ws(':', src_ip, dst_ip, dst_port)) AS fingerprint,
 CAST(floor(t / {sf_.REUSE_SECONDS}) AS BIGINT) AS reuse_window FROM packets""")
def n07b(spark, sf):
    p = v.packet_stream(spark, sf).withColumn("fingerprint", F.md5(F.concat_ws(":", "src_ip", "dst_ip", "dst_port")))
    computed = sf_.run_and_read(spark, sf_.first_in_ttl(p.select("pkt_id", "fingerprint", "ts"), "fingerprint"), scratch_path(spark, "reuse"))
    return computed.select("fingerprint", F.floor(F.unix_micros("ts") / F.lit(sf_.REUSE_SECONDS * 1000000)).alias("reuse_window"))


_REUSE = f"""f AS (SELECT pkt_id, flow_id, t, row_number() OVER (PARTITION BY flow_id ORDER BY t, pkt_id) AS rn FROM packets),
chain AS (SELECT flow_id, t, rn FROM f WHERE rn = 1
 UNION ALL SELECT c.flow_id, min(f.t), min(f.rn) FROM chain c JOIN f ON f.flow_id = c.flow_id AND f.t >= c.t + 40000 GROUP BY c.flow_id)
SELECT f.pkt_id, c.rn <> f.rn AS reused, s.pkt_id AS source_row FROM f ASOF JOIN chain c ON c.flow_id = f.flow_id AND c.rn <= f.rn JOIN f s ON s.flow_id = c.flow_id AND s.rn = c.rn"""


@query("N07_sliding_reuse", f"WITH RECURSIVE {v.PACKETS}, {_REUSE}")
def n07c(spark, sf):
    return ru.sliding_reuse(v.packets(spark, sf), "flow_id", "t", "pkt_id", 40_000).select("pkt_id", "reused", "source_row")


@query("N07_stream_sliding_reuse", f"WITH RECURSIVE {v.PACKETS}, {_REUSE}")
def n07d(spark, sf):
    p = v.packet_stream(spark, sf)
    out, _ = ke.run_to_end(spark, p, lambda p: ke.ordered_reuse(p, "flow_id", "ts", "pkt_id", 40_000), scratch_path(spark, "sliding-reuse"))
    return out.select("pkt_id", "reused", "source_row")


# -- robustness: fixed weights over features in [0, 1] ---------------------------------------------

FEATURES = ["x1", "x2", "x3"]
W, BIAS = [1.5, -2.0, 0.75], 0.1
LIN = v.FLOWS + ", lin AS (SELECT row_id, attack AS y, quantity / CAST(50 AS DOUBLE) AS x1, discount * CAST(10 AS DOUBLE) AS x2, tax * CAST(12.5 AS DOUBLE) AS x3 FROM flows)"


def _lin(spark, sf):
    return v.flow_table(spark, sf).select("row_id", F.col("attack").alias("y"), (F.col("quantity") / 50.0).alias("x1"), (F.col("discount") * 10.0).alias("x2"), (F.col("tax") * 12.5).alias("x3"))


def _moved(e: float) -> str:
    return ", ".join(f"least(greatest({x} + CASE WHEN y = 1 THEN -1 ELSE 1 END * CAST({e * ((w > 0) - (w < 0))} AS DOUBLE), 0), 1) AS {x}_adv" for x, w in zip(FEATURES, W))


def _z(suffix: str = "") -> str:
    return " + ".join(f"{x}{suffix} * CAST({w} AS DOUBLE)" for x, w in zip(FEATURES, W)) + f" + CAST({BIAS} AS DOUBLE)"


@query("R01_fgsm", f"WITH {LIN}, m AS (SELECT row_id, {_moved(0.05)} FROM lin) SELECT row_id, {sts(*[f'{x}_adv AS {x}_adv' for x in FEATURES])} FROM m")
def r01(spark, sf):
    return settle(ro.attack(_lin(spark, sf), FEATURES, ro.fgsm(FEATURES, W, "y", 0.05)).select("row_id", *[f"{x}_adv" for x in FEATURES]))


@query("R02_pgd", f"WITH {LIN}, m AS (SELECT row_id, {_moved(0.03)} FROM lin) SELECT row_id, {sts(*[f'{x}_adv AS {x}_adv' for x in FEATURES])} FROM m")
def r02(spark, sf):
    return settle(ro.attack(_lin(spark, sf), FEATURES, ro.pgd(FEATURES, W, "y", 0.05, 0.01, 3)).select("row_id", *[f"{x}_adv" for x in FEATURES]))


_HIT = f"avg(CAST(CAST({_z('_adv')} >= 0 AS INTEGER) = y AS INTEGER))"


# ten steps of a quarter of epsilon end at epsilon, so both attacks move a row equally far
@query("R03_epsilon_sweep", f"WITH {LIN} " + " UNION ALL ".join(
    f"SELECT {st(str(e))} AS epsilon, {st('f.a')} AS fgsm_accuracy, {st('p.a')} AS pgd_accuracy, {st('(f.a + p.a) / 2')} AS robustness_score"
    f" FROM (SELECT {_HIT} AS a FROM (SELECT y, {_moved(e)} FROM lin)) f, (SELECT {_HIT} AS a FROM (SELECT y, {_moved(min(10 * 0.25 * e, e))} FROM lin)) p" for e in ro.EPSILONS))
def r03(spark, sf):
    return settle(ro.epsilon_sweep(_lin(spark, sf), FEATURES, W, BIAS, "y"))


@query("R03_fitted_sweep")
def r03b(spark, sf):
    train, rest = _split(_lin(spark, sf))
    return settle(ro.epsilon_sweep(rest, FEATURES, *ro.fitted_weights(mo.fit_model(train, FEATURES, "y", "lr", standardize=True, maxIter=10)), "y"))


@query("R05_certified_radius")
def r05b(spark, sf):
    return settle(ro.certified_radius(_lin(spark, sf), "row_id", FEATURES, W, BIAS, 0.1, 200).select("row_id", "y", "votes", "smoothed_pred", "radius"))


@query("R04_perturbation_summary", f"""WITH {LIN}, m AS (SELECT *, {_moved(0.05)} FROM lin), s AS (SELECT avg(CAST(CAST({_z()} >= 0 AS INTEGER) = y AS INTEGER)) AS c, avg(CAST(CAST({_z('_adv')} >= 0 AS INTEGER) = y AS INTEGER)) AS a,
 avg(sqrt({' + '.join(f'pow({x}_adv - {x}, 2)' for x in FEATURES)})) AS ap, max(sqrt({' + '.join(f'pow({x}_adv - {x}, 2)' for x in FEATURES)})) AS mp FROM m)
SELECT {sts('c AS clean_accuracy', 'a AS adversarial_accuracy', 'ap AS avg_perturbation', 'mp AS max_perturbation', 'c - a AS robustness_gap', '1 - a AS success_rate')} FROM s""")
def r04(spark, sf):
    return settle(ro.perturbation_summary(_lin(spark, sf), FEATURES, ro.fgsm(FEATURES, W, "y", 0.05), W, BIAS, "y"))


@query("R05_smoothed_accuracy")
def r05(spark, sf):
    return ro.smoothed_accuracy(_lin(spark, sf), "row_id", FEATURES, W, BIAS, "y", 0.1, 20)


# -- models ----------------------------------------------------------------------------------------

NUM = ["quantity", "price", "discount", "tax", "line"]


def _labelled(spark, sf):
    """Flow records with a class that the features can tell apart in part."""
    f = v.flow_table(spark, sf)
    hard = (F.col("quantity") > 30) & (F.col("discount") < 0.06)
    return f.withColumns({"y": (hard | (F.col("tax") > 0.07)).cast("int"), "encrypted": (F.col("scenario") == "O").cast("int"), "cls": F.when(hard, 2).otherwise(F.col("attack"))})


def _split(df):
    """(training rows, the rest) by a hash of the row id: models are scored on rows they did not see."""
    marked = random_split(df, "row_id")
    return marked.where(F.col("split") == "train").drop("split"), marked.where(F.col("split") != "train").drop("split")


@query("M01_forest_predictions")
def m01(spark, sf):
    train, rest = _split(_labelled(spark, sf))
    model = mo.fit_model(mo.with_weights(train, "y", ["row_id"]), NUM, "y", "rf", "weight", numTrees=10)
    return mo.predict(model, rest, ["row_id", "y"]).select("row_id", "y", "pred", F.round("confidence", 4).alias("confidence"))


@query("M01_forest_importances")
def m01b(spark, sf):
    train, _ = _split(_labelled(spark, sf))
    return mo.importances(mo.fit_model(train, NUM, "y", "rf", numTrees=10), NUM, spark).withColumn("score", F.round("score", 6))


@query("M02_soft_vote")
def m02(spark, sf):
    train, rest = _split(_labelled(spark, sf))
    out = mo.soft_vote(train, rest, NUM, "y", ["row_id", "y"], {"rf": {"numTrees": 5}, "gbt": {"maxIter": 3, "maxDepth": 3}})
    return out.withColumn("p", F.round("p", 4))


@query("M03_calibrated_scores")
def m03(spark, sf):
    validation, rest = _split(v.predictions(spark, sf))
    return mo.calibrate(validation, rest, "p", "y").select("row_id", F.round("calibrated", 6).alias("calibrated"))


@query("M04_weighted_linear")
def m04(spark, sf):
    train, rest = _split(_labelled(spark, sf))
    return mo.predict(mo.weighted_linear(train, NUM, "y", ["row_id"], maxIter=10), rest, ["row_id", "y"]).select("row_id", "y", "pred")


@query("M05_train_and_evaluate")
def m05(spark, sf):
    return mo.train_and_evaluate(_labelled(spark, sf), NUM, "row_id", "y", 20000, trees=10)[1]


@query("M06_two_stage")
def m06(spark, sf):
    return mo.two_stage(_labelled(spark, sf), NUM, "row_id", "encrypted", "cls", trees=10, depth=5)


@query("M07_stacking")
def m07(spark, sf):
    train, rest = _split(mo.with_features(_labelled(spark, sf), NUM))
    learners = {"rf": mo.classifier("rf", numTrees=5), "lr": mo.classifier("lr", maxIter=5), "svc": mo.classifier("svc", maxIter=5)}
    model = sk.StackingClassifier(learners, "row_id", "y", folds=2).fit(train)
    return model.transform(rest).select("row_id", "y", F.col("prediction").alias("pred"))


@query("L05_cross_validation")
def l05_models(spark, sf):
    data = mo.with_features(_labelled(spark, sf), NUM).withColumn("y", F.coalesce("cls", "y"))
    return sk.cross_validate(data, {"lr": mo.classifier("lr", maxIter=5), "dt": mo.classifier("dt", maxDepth=4)}, "row_id", "y", folds=3)[1]


@query("M08_parameter_search")
def m08(spark, sf):
    return mo.search(_labelled(spark, sf), NUM, "y", "rf", {"numTrees": [3, 6], "maxDepth": [3, 5]}, samples=3)


@query("M09_score_rows", f"WITH {v.CLASS_PRED} SELECT row_id, CAST(pred AS BIGINT) AS threat_class, {sts('greatest(a, b, c) AS confidence', '1 - a AS threat_score')} FROM cls")
def m09(spark, sf):
    return settle(al.score_rows(v.class_predictions(spark, sf)).select("row_id", "threat_class", "confidence", "threat_score"))


@query("M10_focal_loss", f"""WITH {v.PRED}, f AS (SELECT CASE WHEN y = 1 THEN 0.75 ELSE 0.25 END * pow(1 - greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12), 2) * -ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12)) AS l FROM pred)
SELECT {sts('avg(l) AS mean_loss', 'sum(l) AS total_loss')} FROM f""")
def m10(spark, sf):
    loss = al.focal_loss("y", "p", 2.0, [0.25, 0.75])
    return settle(v.predictions(spark, sf).agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("total_loss")))
