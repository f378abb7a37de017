"""Slices follow the data: equal results and even tasks whatever the values are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ordering as od, slices as sl

ROWS = 40_000


def times(kind, rng):
    """(flow, t) of a hard table."""
    flow = np.where(rng.random(ROWS) < 0.9, 1, rng.integers(2, 500, ROWS))
    if kind == "microseconds":
        return flow, 1.7e9 + rng.integers(0, 60_000, ROWS) * 1e-6
    if kind == "one day":
        return flow, 1.7e9 + np.sort(rng.random(ROWS)) * 86_400
    if kind == "near one":
        return flow, 1 - rng.random(ROWS) * 1e-9
    if kind == "busy hour":  # nine tenths of all rows in one hour of thirty years
        return flow, np.where(rng.random(ROWS) < 0.9, 1.6e9 + rng.random(ROWS) * 3600, rng.random(ROWS) * 1e9)
    return flow, np.where(rng.random(ROWS) < 0.5, 7.0, rng.normal(0, 1e300, ROWS))  # half of all rows at one time


KINDS = ["microseconds", "one day", "near one", "busy hour", "one time"]


@pytest.fixture(scope="module", params=KINDS)
def hard(request, spark):
    rng = np.random.default_rng(17)
    flow, t = times(request.param, rng)
    rows = pd.DataFrame({"flow_id": flow, "t": t, "pkt_id": rng.permutation(ROWS), "size": rng.integers(40, 1500, ROWS).astype(float)})
    return spark.createDataFrame(rows).repartition(7).cache(), rows.sort_values(["flow_id", "t", "pkt_id"]).reset_index(drop=True)


def even(df, key, order, **how):
    """Rows of the largest slice against the mean of the slices of its key that were cut."""
    sizes = sl.with_slices(df, key, order, **how).groupBy(*key, "_b").count().toPandas()["count"]
    return sizes.max(), sizes[sizes > sl.SLICE_SAMPLE / 2].mean()


def test_order_and_size_of_slices(hard):
    df, rows = hard
    for key in (["flow_id"], []):
        most, mean = even(df, key, ["t", "pkt_id"])
        assert most <= 4 * mean and most < ROWS / 100
        b = sl.with_slices(df, key, ["t", "pkt_id"]).toPandas().sort_values([*key, "t", "pkt_id"])
        assert (b.groupby("flow_id")["_b"].diff().dropna() >= 0).all() if key else b["_b"].is_monotonic_increasing


def test_index_previous_and_totals(hard):
    df, rows = hard
    want = rows.assign(rn=rows.groupby("flow_id").cumcount() + 1, prev_t=rows.groupby("flow_id")["t"].shift()).sort_values("pkt_id")
    got = od.with_previous(od.index_rows(df, ["flow_id"], ["t", "pkt_id"], total="n"), ["flow_id"], ["t", "pkt_id"], ["t"]).toPandas().sort_values("pkt_id")
    assert got["rn"].tolist() == want["rn"].tolist()
    assert got["prev_t"].fillna(-1).tolist() == want["prev_t"].fillna(-1).tolist()
    assert got["n"].tolist() == want.groupby("flow_id")["rn"].transform("size").tolist()
    counts = df.groupBy("flow_id", "t").agg(F.count(F.lit(1)).alias("n"))
    totals = od.running_totals(counts, ["flow_id"], "t", ["n"]).toPandas().sort_values(["flow_id", "t"])
    want = rows.groupby(["flow_id", "t"]).size().groupby("flow_id").cumsum()
    assert totals["cum_n"].tolist() == want.tolist()


def test_quantiles(hard):
    df, rows = hard
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = od.group_quantiles(df, ["flow_id"], "t", probs).toPandas().sort_values("flow_id")
    want = rows.groupby("flow_id")["t"].quantile(probs).unstack()
    assert np.allclose(got[[od.prob_name(p) for p in probs]], want, rtol=1e-14, atol=0)
    whole = od.column_quantiles(df, ["t", "size"], probs).first()
    for c in ("t", "size"):
        assert np.allclose([whole[f"{c}_{od.prob_name(p)}"] for p in probs], rows[c].quantile(probs), rtol=1e-14, atol=0)


def test_missing_times_and_keys(spark):
    rng = np.random.default_rng(2)
    data = [(None if i % 7 == 0 else int(i % 3), None if i % 5 == 0 else float(rng.integers(0, 50)), i) for i in range(3000)]
    df = spark.createDataFrame(data, "flow_id int, t double, pkt_id int")
    rows = sorted((d for d in data if d[0] is not None), key=lambda d: (d[0], d[1] is not None, d[1] or 0, d[2]))
    want, n = {}, {}
    for flow, _, pkt in rows:
        n[flow] = want[pkt] = n.get(flow, 0) + 1
    got = {r.pkt_id: r.rn for r in od.index_rows(df, ["flow_id"], ["t", "pkt_id"]).collect()}
    # numbers restart per flow; rows without a time come first, rows without a flow belong to none
    last = {}
    for flow, _, pkt in rows:
        last[flow] = last.get(flow, 0) + 1
        assert got.pop(pkt) == last[flow]
    assert not got
    safe = {r.pkt_id: r.rn for r in od.index_rows(df, ["flow_id"], ["t", "pkt_id"], null_safe=True).collect()}
    lost = sorted((d for d in data if d[0] is None), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
    assert [safe[d[2]] for d in lost] == list(range(1, len(lost) + 1)) and len(safe) == len(data)
    prev = {r.pkt_id: r.prev_pkt_id for r in od.with_previous(df, ["flow_id"], ["t", "pkt_id"], ["pkt_id"]).collect()}
    for (f1, _, a), (f2, _, b) in zip(rows, rows[1:]):
        assert prev[b] == (a if f1 == f2 else None)


def test_empty_and_text_orders(spark):
    none = spark.createDataFrame([], "k int, name string")
    assert od.index_rows(none, ["k"], ["name"]).collect() == [] and od.index_rows(none, [], ["name"]).collect() == []
    names = [f"client-{i % 977:05d}-{i}" for i in range(5000)]  # a common beginning
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in od.index_rows(df, [], ["name"]).orderBy("rn").collect()]
    most, mean = even(df, [], ["name"])
    assert got == sorted(names) and most <= 4 * mean


def test_large_tables_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(sl, "LEAST_SAMPLE", 1 << 10)
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("v"), (F.col("id") % 2).alias("k"))
    cuts = sl.cut_points(df, ["k"], ["v"]).toPandas()
    assert 20 <= len(cuts) <= 50  # 1024 sampled rows, one cut in 32
    most, mean = even(df, ["k"], ["v"])
    assert most <= 4 * mean
    whole = od.index_rows(df, [], ["v"]).where("rn % 20000 = 1").orderBy("rn").toPandas()["v"].tolist()
    assert whole == sorted(i * 7919 % 200_003 for i in range(200_000))[::20_000]
