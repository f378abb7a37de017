"""Ordered keyed state and sliding reuse against plain replays, at several micro-batch cuts and with disorder."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import reuse as ru
from flowsieve.streaming import change as ch, flows as sf_, keyed as ke

DELAY = 600


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Rows in arrival order: event times are up to ``DELAY`` behind the newest, in files of unlike size; a hot key, ties, two late rows."""
    rng = np.random.default_rng(23)
    n = 1500
    arrival = np.sort(rng.integers(0, 40_000, n))
    t = 10_000 + np.maximum(arrival - rng.integers(0, DELAY, n), 0)
    rows = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 6, n)), "t": t, "id": rng.permutation(n), "wrong": (rng.random(n) < 0.2 + 0.4 * (t > 30_000)).astype(int), "score": rng.gamma(2, 3, n)})
    folder = tmp_path_factory.mktemp("events")
    schema = "k bigint, t bigint, id bigint, wrong bigint, score double"
    for name, cuts in (("few", [0, 700, n]), ("many", [0, 1, 200, 210, 500, 900, 1300, 1490, n])):
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = spark.createDataFrame(rows[a:b], schema).withColumn("ts", F.timestamp_seconds("t"))
            part.coalesce(1).write.mode("append").parquet(f"{folder}/{name}/{i}")
    return folder, rows.sort_values(["k", "t", "id"]).reset_index(drop=True)


def streamed(spark, folder, name):
    schema = "k bigint, t bigint, id bigint, wrong bigint, score double, ts timestamp"
    # files are taken by their time of change, which is the order they were written in
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}/*")


@pytest.mark.parametrize("name", ["few", "many"])
def test_ordered_drift(spark, events, tmp_path, name):
    folder, rows = events
    work = lambda p: ke.ordered_drift(p, "k", "ts", ["t", "id"], "wrong", 60, 0.2, 0.1, f"{DELAY} seconds")
    got, late = ke.run_to_end(spark, streamed(spark, folder, name), work, str(tmp_path / "d"))
    got = got.toPandas().sort_values(["k", "t", "id"])
    assert late == 0 and len(got) == len(rows) and got["id"].tolist() == rows["id"].tolist()
    for column, i in (("drift_now", 0), ("drift", 1), ("warning", 2)):
        want = np.concatenate([ch.drift_steps(p["wrong"].to_numpy(), (0, 0, np.zeros(0, np.uint8), False), 60, 0.2, 0.1)[i] for _, p in rows.groupby("k")])
        assert got[column].tolist() == want.tolist()
    assert got["drift_now"].any()


def test_ordered_threshold(spark, events, tmp_path):
    folder, rows = events
    work = lambda p: ke.ordered_threshold(p, "k", "ts", ["t", "id"], "score", 40, 20, delay=f"{DELAY} seconds")
    got, _ = ke.run_to_end(spark, streamed(spark, folder, "many"), work, str(tmp_path / "t"))
    got = got.toPandas().sort_values(["k", "t", "id"])
    want = np.concatenate([ch.threshold_steps(p["score"].to_numpy(), (np.zeros(0), None), 40, 20, 3.0, 0.1)[0] for _, p in rows.groupby("k")])
    assert np.allclose(got["threshold"].astype(float), want, rtol=1e-11, equal_nan=True)
    assert got["anomaly"].tolist() == (got["score"].to_numpy() > want).tolist()


def test_late_rows_are_counted_and_tails_closed(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[(1, 10_000, 1), (2, 10_000, 2)], [(1, 9_000, 3), (1, 9_500, 4), (2, 10_300, 5), (None, 10_000, 6)], [(1, 20_000, 7)], [(1, 20_100, 10)], [(2, 19_000, 8), (2, 19_700, 9)]]):
        df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint").withColumn("ts", F.timestamp_seconds("t")).withColumn("size", F.lit(1.0))
        df.coalesce(1).write.parquet(f"{folder}/{i}")
    schema = "k bigint, t bigint, id bigint, ts timestamp, size double"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    work = lambda p: ke.ordered_reuse(p, "k", "ts", "id", 300, f"{DELAY} seconds")
    got, late = ke.run_to_end(spark, read(), work, str(tmp_path / "r"))
    got = {r.id: (r.reused, r.source_row) for r in got.collect()}
    # 8 came when the watermark had passed its time; 5 is exactly 300 seconds after 2, so computed again
    assert got == {1: (False, 1), 2: (False, 2), 3: (False, 3), 4: (False, 4), 5: (False, 5), 7: (False, 7), 9: (False, 9), 10: (True, 7)}
    assert late == 1
    flows, _ = ke.run_to_end(spark, read(), lambda p: sf_.stream_flows(p, ["k"], 120, f"{DELAY} seconds"), str(tmp_path / "f"))
    assert {(r.k, int(r.start)) for r in flows.where("k IS NOT NULL").collect()} >= {(1, 10_000), (1, 20_000), (2, 19_700)}


def replay(rows, seconds):
    out, held = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in held or t >= held[k][0] + seconds:
            held[k] = (t, i)
        out[i] = (held[k][1] != i, held[k][1])
    return out


@pytest.mark.parametrize("seconds", [1, 30, 5_000, 10**9])
def test_sliding_reuse(spark, seconds):
    rng = np.random.default_rng(seconds)
    n = 2500
    rows = [(1 if rng.random() < 0.8 else int(rng.integers(2, 30)), float(rng.integers(0, 9000)), int(i)) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "fp int, at double, id int").withColumn("rn", F.lit("kept"))
    got = {r.id: (r.reused, r.source_row) for r in ru.sliding_reuse(df, "fp", "at", "id", seconds).collect()}
    assert got == replay(rows, seconds)


def test_sliding_reuse_of_odd_rows(spark):
    rows = [(None, 1.0, 1), (1, None, 2), (1, float("nan"), 3), (1, 5.0, 4), (1, 5.0, 5), (1, 304.9, 6), (1, 305.0, 7)]
    df = spark.createDataFrame(rows, "fp int, at double, id int")
    got = {r.id: (r.reused, r.source_row) for r in ru.sliding_reuse(df, "fp", "at", "id", 300).collect()}
    assert got == {1: (False, 1), 2: (False, 2), 3: (False, 3), 4: (False, 4), 5: (True, 4), 6: (True, 4), 7: (False, 7)}
    assert ru.sliding_reuse(df.limit(0), "fp", "at", "id", 300).collect() == []
