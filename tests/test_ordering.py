"""The skew-safe kernels against pandas, with one key holding most rows and buckets far smaller than a key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import flows as fl, ordering as od, sequences as sq, temporal as te
from flowsieve.streaming import change as ch, flows as sf_


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 12000
    flow = np.where(rng.random(n) < 0.8, 1, rng.integers(2, 9, n))
    t = np.round(rng.exponential(30.0, n).cumsum() + rng.integers(0, 3, n), 1)
    out = pd.DataFrame({
        "flow_id": flow, "t": t, "pkt_id": rng.permutation(n), "size": np.round(rng.lognormal(3, 1, n), 2),
        "direction": np.where(rng.random(n) < 0.5, "forward", "backward"), "label": (rng.random(n) < 0.2).astype(int), "dst_port": rng.integers(1, 50, n),
    })
    return out.sort_values(["flow_id", "t", "pkt_id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows).repartition(5).cache()


def pull(frame, key="pkt_id"):
    return frame.toPandas().sort_values(key).reset_index(drop=True)


def test_index_and_previous(df, rows):
    want = rows.assign(rn=rows.groupby("flow_id").cumcount() + 1, prev_t=rows.groupby("flow_id")["t"].shift(),
                       prev_direction=rows.groupby("flow_id")["direction"].shift()).sort_values("pkt_id").reset_index(drop=True)
    got = pull(od.index_rows(df, ["flow_id"], ["t", "pkt_id"]))
    assert got["rn"].tolist() == want["rn"].tolist()
    prev = pull(od.with_previous(df, ["flow_id"], ["t", "pkt_id"], ["t", "direction"]))
    assert prev["prev_t"].fillna(-1).tolist() == want["prev_t"].fillna(-1).tolist()
    assert prev["prev_direction"].fillna("").tolist() == want["prev_direction"].fillna("").tolist()
    only_t = pull(od.with_previous(df, ["flow_id"], ["t", "pkt_id"], ["t"]))
    assert only_t["prev_t"].fillna(-1).tolist() == want["prev_t"].fillna(-1).tolist()


def test_global_index(df, rows):
    want = rows.sort_values(["t", "pkt_id"])["pkt_id"].tolist()
    got = od.index_rows(df, [], ["t", "pkt_id"]).orderBy("rn").select("rn", "pkt_id").toPandas()
    assert got["rn"].tolist() == list(range(1, len(rows) + 1)) and got["pkt_id"].tolist() == want


def test_look_back_crosses_blocks(df, rows):
    indexed = od.index_rows(df, ["flow_id"], ["t", "pkt_id"])
    w = od.block_window(["flow_id"]).rowsBetween(-9, 0)
    got = od.with_look_back(indexed, ["flow_id"], 9, 32).select("pkt_id", "_ghost", F.sum("size").over(w).alias("s"))
    got = pull(got.where(~F.col("_ghost")))
    want = rows.assign(s=rows.groupby("flow_id")["size"].transform(lambda x: x.rolling(10, min_periods=1).sum())).sort_values("pkt_id")
    assert np.allclose(got["s"], want["s"])


def test_running_totals(df, rows):
    counts = df.groupBy("flow_id", "size").agg(F.count(F.lit(1)).alias("n"))
    for descending in (False, True):
        got = od.running_totals(counts, ["flow_id"], "size", ["n"], descending).toPandas()
        want = rows.groupby(["flow_id", "size"]).size().rename("n").reset_index().sort_values(["flow_id", "size"], ascending=[True, not descending])
        want["cum_n"] = want.groupby("flow_id")["n"].cumsum()
        both = got.merge(want, on=["flow_id", "size"])
        assert len(both) == len(want) and (both["cum_n_x"] == both["cum_n_y"]).all()


def test_quantiles(df, rows):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = od.group_quantiles(df, ["flow_id"], "size", probs).toPandas().set_index("flow_id")
    for flow, part in rows.groupby("flow_id"):
        assert np.allclose(got.loc[flow, [od.prob_name(p) for p in probs]], part["size"].quantile(probs))


def test_quantiles_of_negative_and_equal_values(spark):
    x = [-5.0, -5.0, -1.5, 0.0, 0.0, 2.0, 1e9, 1e-9]
    frame = spark.createDataFrame([(a, 3.0) for a in x], "a double, b double")
    row = od.column_quantiles(frame, ["a", "b"], [0.25, 0.5]).first()
    assert row["a_p25"] == pytest.approx(np.quantile(x, 0.25)) and row["a_p50"] == pytest.approx(np.median(x)) and row["b_p50"] == 3.0


def test_hot_flow_features(df, rows):
    got = fl.rolling_stats(df).toPandas().set_index("flow_id").sort_index()
    roll = rows.groupby("flow_id")["size"].rolling(10)
    assert np.allclose(got["rollingMean"], roll.mean().groupby("flow_id").mean())
    assert np.allclose(got["rollingStd"], roll.std().groupby("flow_id").mean())
    iat = rows.groupby("flow_id")["t"].diff()
    auto = rows.assign(iat=iat).dropna().groupby("flow_id")["iat"].apply(lambda x: x.autocorr(1))
    assert np.allclose(fl.periodicity(df).toPandas().set_index("flow_id").sort_index()["periodicity"], auto)
    mem = te.size_memory(df).toPandas().set_index("flow_id").sort_index()["size_autocorrelation"]
    want = rows.groupby("flow_id")["size"].apply(lambda x: max(abs(x.autocorr(k)) for k in range(1, 11)))
    assert np.allclose(mem, want)


def test_running_deviation_crosses_blocks(df, rows):
    gaps = te.gap_series(df).cache()
    got = te.running_deviation(gaps, ["flow_id"], block=64).toPandas().sort_values(["flow_id", "pos"])
    iat = rows.assign(iat=rows.groupby("flow_id")["t"].diff()).dropna(subset=["iat"])
    want = (iat["iat"] - iat.groupby("flow_id")["iat"].transform("mean")).groupby(iat["flow_id"]).cumsum()
    assert np.allclose(got["y"], want, atol=1e-6)


def test_windows_of_a_hot_group(df, rows):
    got = sq.sliding_windows(df, ["size"], "label", ["t", "pkt_id"], 7, 5, ["flow_id"]).toPandas()
    for flow, part in rows.groupby("flow_id"):
        mine = got[got["flow_id"] == flow].sort_values("window_id")
        assert len(mine) == max(0, (len(part) - 7) // 5 + 1)
        size = part["size"].to_numpy()
        flat = np.array([[r[0] for r in s] for s in mine["sequences"]])
        assert np.allclose(flat, np.lib.stride_tricks.sliding_window_view(size, 7)[::5])


def test_sessions_of_a_hot_flow(df, rows):
    got = sf_.batch_flows(df, ["flow_id"], 60.0).toPandas()
    gap = rows.groupby("flow_id")["t"].diff()
    session = (gap.isna() | (gap > 60.0)).groupby(rows["flow_id"]).cumsum()
    want = rows.groupby(["flow_id", session])["size"].agg(["count", "sum"])
    assert len(got) == len(want)
    assert sorted(got["pktCount"]) == sorted(want["count"]) and np.isclose(got["totalBytes"].sum(), want["sum"].sum())


def test_adaptive_threshold_replays_the_detector(df, rows):
    got = ch.adaptive_threshold(df, ["flow_id"], ["t", "pkt_id"], "size", size=50, least=20, block=128)
    got = got.toPandas().sort_values(["flow_id", "t", "pkt_id"])
    want = []
    for _, part in rows.groupby("flow_id"):
        want += plain_thresholds(part["size"].to_numpy(), 50, 20, 3.0, 0.1)
    assert np.allclose(got["threshold"], want, equal_nan=True)
    assert got["anomaly"].tolist() == (got["size"].to_numpy() > np.array(want)).tolist()


def plain_thresholds(x, size, least, stds, rate):
    """The moving threshold from the whole history, one sample at a time; NaN before ``least`` samples."""
    out, last = [], None
    for i in range(len(x)):
        window = x[max(0, i + 1 - size) : i + 1]
        if len(window) < least:
            out.append(np.nan)
            continue
        fresh = window.mean() + stds * window.std()
        last = fresh if last is None else (1 - rate) * last + rate * fresh
        out.append(last)
    return out


def test_threshold_steps_do_not_depend_on_the_cut():
    x = np.random.default_rng(5).gamma(2, 3, 3000)
    want = plain_thresholds(x, 100, 50, 3.0, 0.1)
    for cuts in ([0, 3000], [0, 5, 49, 50, 2000, 3000], [*range(0, 3000, 7), 3000]):
        past, got = (np.zeros(0), None), []
        for a, b in zip(cuts, cuts[1:]):
            out, past = ch.threshold_steps(x[a:b], past, 100, 50, 3.0, 0.1)
            got += out.tolist()
        assert np.allclose(got, want, rtol=1e-11, equal_nan=True) and len(past[0]) == 100
