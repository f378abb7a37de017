"""Hand-computed cases and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import (
    alerts as al, clean as cl, engineer as en, flows as fl, metrics as me, models as mo, ordering as od, robustness as ro, sampling as sa,
    scale as sc, temporal as te, tls,
)
from flowsieve.plans import views as v
from flowsieve.streaming import change as ch, flows as sf_


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_labels_from_file_names(spark):
    names = ["A1-VPN.arff", "x-NO-VPN.arff", "novpn.csv", "AllInOne.arff", "other.csv"]
    got = one(spark, *[cl.vpn_label(F.lit(n)).alias(f"c{i}") for i, n in enumerate(names)])
    assert list(got) == [1, 0, 0, -1, 0]
    paths = ["/d/no_vpn/a", "/d/VPN/a", "/d/Scenario A1/a", "/d/x"]
    assert list(one(spark, *[cl.encryption_flag(F.lit(p)).alias(f"c{i}") for i, p in enumerate(paths)])) == [0, 1, 1, -1]


def test_cipher_rules(spark):
    suites = ["TLS_AES_256_GCM", "tls_chacha20", "RC4-SHA", "3DES", "DES-CBC", "OTHER", ""]
    assert list(one(spark, *[tls.cipher_strength(F.lit(s)).alias(f"c{i}") for i, s in enumerate(suites)])) == [256, 256, 64, 112, 64, 128, 0]
    assert one(spark, tls.cipher_strength(F.lit("RC4"), rc4_as_weak=False))[0] == 128
    assert list(one(spark, *[tls.forward_secrecy(F.lit(s)).alias(s) for s in ("ECDHE", "RSA", "ecdh_anon")])) == [True, False, True]


def test_remap_rejects_other_negatives(spark):
    df = spark.createDataFrame([(-1,), (0,), (3,)], "y int")
    assert [r[0] for r in df.select(cl.remap_label("y")).collect()] == [2, 0, 3]
    with pytest.raises(Exception):
        spark.createDataFrame([(-2,)], "y int").select(cl.remap_label("y")).collect()


def test_five_packet_flow(spark):
    rows = [(1, 1000.0, 1, 64.0, "a"), (1, 1000.1, 2, 1024.0, "b"), (1, 1000.15, 3, 128.0, "a"), (1, 1000.3, 4, 512.0, "b"), (1, 1000.35, 5, 256.0, "a")]
    p = spark.createDataFrame(rows, "flow_id int, t double, pkt_id int, size double, direction string")
    flow = fl.packets_to_flows(p).first()
    assert flow["pktCount"] == 5 and flow["totalBytes"] == 1984.0 and flow["flowDuration"] == pytest.approx(0.35)
    assert flow["iatMean"] == pytest.approx(0.0875) and flow["iatStd"] == pytest.approx(np.std([0.1, 0.05, 0.15, 0.05]))
    assert te.direction_balance(p).first()["conversation_turns"] == 0.0  # fewer than 10 packets
    assert te.hurst_exponent(p).first()["hurst_exponent"] == 0.5
    handshake = spark.createDataFrame([(1, 0.0, 1, "client_to_server", 512), (1, 0.1, 2, "server_to_client", 1024)], "flow_id int, ts double, pkt_id int, direction string, size int")
    t = tls.handshake_timing(handshake, ["flow_id"]).first()
    assert (t["handshake_duration"], t["handshake_bytes"]) == (0.1, 1536)
    assert tls.rtt_variance(handshake, ["flow_id"]).first()["rtt_variance"] == 0.0


def test_entropy_of_two_values_is_one_bit(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k int, x string")
    got = {r["k"]: r["h"] for r in fl.value_entropy(df, ["k"], {"h": "x"}).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.0)


def test_kpi_example(spark):
    row = {"detection_rate": 0.96, "false_positive_rate": 0.03, "adversarial_detection_rate": 0.87, "cross_dataset_f1": 0.88, "f1_score": 0.95, "average_latency_ms": 85.0}
    got = me.kpi_score(spark.createDataFrame([row])).first()
    assert got["overall_score"] == pytest.approx(0.25 + 0.2 * 0.9 + 0.2 * 0.87 / 0.9 + 0.15 + 0.1 + 0.1)
    assert not got["ok_overall"] and got["ok_average_latency_ms"] and not got["ok_adversarial_detection_rate"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    for kind in ("minmax", "standard", "robust"):
        assert {r["b"] for r in sc.scale(df, ["a", "b"], kind).collect()} == {0.0}
    assert cl.zscore_filter(df, ["b"]).count() == 0
    assert {r["bin_b"] for r in en.binned_features(df, ["b"]).collect()} == {2}


def test_heavy_join_is_whole(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": [1] * 700 + list(range(2, 302)), "i": range(1000)}))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = od.join_heavy_stats(rows, stats, ["k"], "n")
    assert got.count() == 1000 and got.where("k = 1").agg(F.min("n")).first()[0] == 700
    assert od.join_group_stats(rows, stats, ["k"], ["i"]).count() == 1000


def test_fitted_engineer_keeps_training_limits(spark, sf):
    f = fl.flow_profile(v.packets(spark, sf)).withColumn("activityIntensity", F.col("pktsPerSec")).cache()
    fitted = en.fit_engineer(f, ["flow_id"], inputs=4, outputs=3)
    whole = {r["flow_id"]: r["unusualPktSize"] for r in en.engineer(f, fitted).collect()}
    some = f.orderBy("flow_id").limit(3)
    assert all(whole[r["flow_id"]] == r["unusualPktSize"] for r in en.engineer(some, fitted).collect())


def test_samples_are_whole_and_balanced(spark, sf):
    f = v.flow_table(spark, sf)
    split = sa.stratified_split(f, "row_id", "label")
    assert split.count() == f.count()
    shares = split.groupBy("label").agg(F.avg((F.col("split") == "train").cast("int")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(0.7, abs=0.01) for r in shares)
    small = f.where((F.col("label") == "R") | (F.col("line") == 1))
    sizes = {r["label"]: r["count"] for r in sa.balanced_oversample(small, "row_id", "label").groupBy("label").count().collect()}
    assert len(set(sizes.values())) == 1


def test_null_labels_survive_a_split(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(90)], "id int, label string")
    assert sa.stratified_split(df, "id", "label").count() == 90


def test_forest_beats_chance(spark, sf):
    f = v.flow_table(spark, sf).withColumn("y", (F.col("quantity") > 25).cast("int"))
    out = mo.predict(mo.fit_model(f, ["quantity", "tax"], "y", "rf", numTrees=5), f, ["y"]).withColumn("p", F.element_at("proba", 2))
    assert me.auc_scores(out).first()["auc"] > 0.99
    imp = mo.importances(mo.fit_model(f, ["quantity", "tax"], "y", "rf", numTrees=5), ["quantity", "tax"], spark).collect()
    assert sum(r["score"] for r in imp) == pytest.approx(1.0)


def test_smoothing_without_noise_is_plain_accuracy(spark):
    df = spark.createDataFrame([(str(i), i / 50, int(i / 50 > 0.5)) for i in range(51)], "k string, x double, y int")
    assert ro.smoothed_accuracy(df, "k", ["x"], [1.0], -0.501, "y", 0.0, 11).first()["smoothed_accuracy"] == 1.0
    assert ro.smoothed_accuracy(df, "k", ["x"], [1.0], -0.501, "y", 0.5, 11).first()["smoothed_accuracy"] < 1.0


def test_new_centres():
    assert ch.new_centres([[0.0, 0.0]], [[0.1, 0.0], [0.0, 0.2], [0.1, 0.1], [5.0, 5.0]]) == [False, False, False, True]


def plain_drift(e, size, drift, warning):
    """The drift rule from the whole history, one sample at a time."""
    out, reference, start, ever = [], None, 0, False
    for i in range(len(e)):
        window, now, warn = e[max(start, i + 1 - size) : i + 1], False, False
        if len(window) >= size // 2:
            rate = sum(window) / len(window)
            if reference is None:
                reference = rate
            elif abs(rate - reference) > drift:
                now = ever = True
                reference, start = rate, i + 1
            else:
                warn = abs(rate - reference) > warning
        out.append((now, ever, warn))
    return out


def test_drift_steps_do_not_depend_on_the_cut():
    rng = np.random.default_rng(0)
    e = (rng.random(9000) < np.repeat([0.1, 0.5, 0.2, 0.22, 0.9, 0.05], 1500)).astype(int)
    want = plain_drift(e.tolist(), 100, 0.1, 0.05)
    assert sum(w[0] for w in want) > 5 and sum(w[2] for w in want) > 100
    for cuts in ([0, 9000], [0, 10, 49, 50, 51, 3000, 3001, 9000], [*range(0, 9000, 7), 9000]):
        past, got = (0, 0, np.zeros(0, np.uint8), False), []
        for a, b in zip(cuts, cuts[1:]):
            now, ever, warned, past = ch.drift_steps(e[a:b], past, 100, 0.1, 0.05)
            got += zip(now.tolist(), ever.tolist(), warned.tolist())
        assert got == want and len(past[2]) <= 100


def test_stream_drift_replays(spark, sf, tmp_path):
    p = v.packet_stream(spark, sf).withColumn("stream", F.lit("all"))
    out = sf_.run_and_read(spark, ch.stream_drift(p, "stream", ["t", "pkt_id"], "label", 60, 0.08, 0.04), str(tmp_path / "d")).orderBy("t", "pkt_id").collect()
    rows = v.packets(spark, sf).orderBy("t", "pkt_id").select("label").collect()
    want = plain_drift([r["label"] for r in rows], 60, 0.08, 0.04)
    assert [(r["drift_now"], r["drift"], r["warning"]) for r in out] == want


def test_reused_results_are_never_older_than_the_limit(spark, sf):
    p = v.packets(spark, sf).withColumn("f", F.col("flow_id").cast("string"))
    r = al.reuse_results(p, "f", "t", "pkt_id", 3600)
    src = p.select(F.col("pkt_id").alias("source_row"), F.col("t").alias("t0"))
    ages = r.join(src, "source_row").select((F.col("t") - F.col("t0")).alias("age"))
    assert r.count() == p.count() and ages.agg(F.max("age"), F.min("age")).first()[0] <= 3600
