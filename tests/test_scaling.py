"""Steps that hold or move less than they did, against plain versions of the same results."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import flows as fl, tls
from flowsieve.plans import fixtures as fx
from flowsieve.sources import capture as ca, capture_source as cs


def test_vectors_come_in_small_parts():
    """A worker holds the vectors of a part, not of a whole Arrow batch (F8)."""
    raw = pd.Series([b"\x00\xff", None] * 500)
    parts = list(ca._scaled.func(iter([(raw, pd.Series([3] * 1000))])))
    assert max(map(len, parts)) == ca.VECTORS_AT_ONCE and sum(map(len, parts)) == 1000
    assert list(parts[0][0]) == [0, 1, 0] and list(parts[-1].iloc[-1]) == [0, 0, 0]


def test_ranges_grow_with_the_read():
    """A large read has about MANY_RANGES ranges, a small one those asked for."""
    assert cs.wide_enough(10**6, 20000) == 20000
    assert 10**9 / cs.wide_enough(10**9, 20000) <= cs.MANY_RANGES + 1
    assert cs.wide_enough(10**12, 20000) == cs.RANGE_BYTES and cs.wide_enough(10**12, 10**9) == 10**9


def test_more_packets_make_more_captures(spark, monkeypatch):
    """No writer has more than about CAPTURE_PACKETS packets."""
    monkeypatch.setattr(fx, "CAPTURE_PACKETS", 50)
    p = spark.range(400).select(F.col("id").alias("pkt_id"), (F.col("id") * 1000 + 10**15).alias("t_us"), F.lit("TCP").alias("protocol"),
                                (F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("flow_id"), F.lit(443).alias("dst_port"))
    files = fx.capture_files(spark, p)
    assert len(files) == 8
    assert sorted(r["src_port"] for r in ca.read_captures(spark, files, piece=2000).collect()) == [1024 + i for i in range(400)]


def entropy(values):
    n = Counter(values)
    return -sum(c / len(values) * math.log2(c / len(values)) for c in n.values())


@pytest.mark.parametrize("apart", [False, True])
def test_entropy_counts_needed_columns_only(spark, apart):
    """Texts have no column for numbers beside them; each column may be counted apart."""
    rows = [(i % 5, f"s{i % 7}", None if i % 4 == 0 else float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    out = fl.value_entropy(df, ["k"], {"a": "s", "b": "x"}, normalized=True, distinct={"d": "s"}, apart=apart).collect()
    for r in out:
        s, x = [v[1] for v in rows if v[0] == r["k"]], [v[2] for v in rows if v[0] == r["k"] and v[2] is not None]
        assert math.isclose(r["a"], entropy(s), abs_tol=1e-9) and math.isclose(r["b"], entropy(x), abs_tol=1e-9)
        assert math.isclose(r["aNorm"], entropy(s) / math.log2(len(set(s))), abs_tol=1e-6) and r["d"] == len(set(s))
    texts = fl.value_entropy(df, ["k"], {"a": "s"}, apart=apart)
    assert "num" not in texts._jdf.queryExecution().optimizedPlan().toString()


def test_certificate_numbers_travel_as_one_row(spark):
    """Density histogram of each flow against numpy; the join sees a certificate as one row."""
    r = np.random.default_rng(4)
    rows = [(int(i % 6), *map(float, r.integers(0, 40, 3))) for i in range(240)] + [(9, 5.0, 5.0, 5.0)]
    out = tls.certificate_entropy(spark.createDataFrame(rows, "k int, a double, b double, c double"), ["k"], ["a", "b", "c"])
    for k, got in map(tuple, out.collect()):
        x = np.array([v for row in rows if row[0] == k for v in row[1:]])
        n, edges = np.histogram(x, bins=10)
        width = (x.max() - x.min()) / x.std() / 10 if x.max() > x.min() else 0.1
        d = (n if x.max() > x.min() else np.array([len(x)])) / len(x) / width
        assert math.isclose(got, -sum(v * math.log2(v + 1e-10) for v in d if v > 0), abs_tol=1e-6)
    assert "certificate_entropy" in out.columns and out.count() == 7


@pytest.mark.parametrize("few", [20_000, 2])
def test_ranks_of_wide_rows(spark, monkeypatch, few):
    """Ranks come to the rows, with few values and with many, and rows without a value stay (F16)."""
    monkeypatch.setattr(fl, "FEW_KEYS", few)
    rows = [(f"r{i}", None if i % 5 == 0 else float(i * 7 % 31), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, x double, y int")
    out = fl.with_percentile_ranks(df, {"x": "rx", "y": "ry"}, ["id"])
    want = pd.DataFrame(rows, columns=["id", "x", "y"])
    want["rx"], want["ry"] = want["x"].rank(pct=True), want["y"].rank(pct=True)
    got = out.toPandas().set_index("id").loc[want["id"]]
    assert len(got) == 120 and np.allclose(got["rx"].astype(float), want["rx"], equal_nan=True) and np.allclose(got["ry"], want["ry"])
    assert out.columns == ["id", "x", "y", "rx", "ry"]


def test_scenario_files_are_parsed_once(spark, tmp_path):
    """Medians, modes and duplicates read the stored rows, not the text."""
    from flowsieve.sources import tables as tb

    (tmp_path / "a.arff").write_text("@relation r\n@attribute x numeric\n@attribute s string\n@data\n1,p\n?,p\n3,?\n1,p\n")
    out = tb.combine_scenarios(spark, {"A": [str(tmp_path / "a.arff")]})
    assert "text" not in {line.split("FileScan ")[1].split()[0] for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan " in line}
    assert sorted((r["x"], r["s"]) for r in out.collect()) == [(1.0, "p"), (3.0, "p")]


def test_training_rows_come_in_bounded_parts(spark):
    """A task of a fit reads a bounded number of rows."""
    from flowsieve.operators.ordering import training_rows

    stored = training_rows(spark.range(1000).coalesce(1), rows=100)
    assert stored.rdd.getNumPartitions() == 10 and max(stored.rdd.glom().map(len).collect()) <= 200
    assert training_rows(spark.range(1000).coalesce(1)).rdd.getNumPartitions() == 1


def test_dependence_uses_all_partitions(spark):
    """Every gap becomes a row per scale, so gaps are dealt to a fixed number of tasks that are not merged again."""
    from flowsieve.operators import temporal as te

    p = spark.range(100).select((F.col("id") % 2).alias("flow_id"), (F.col("id") * F.col("id") * 1.0).alias("t"), F.col("id").alias("pkt_id"))
    assert "REPARTITION_BY_NUM" in te.long_range_dependence(p)._jdf.queryExecution().executedPlan().toString()
