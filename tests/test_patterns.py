"""Patterns of count windows: independent of the micro-batches, unchanged by a replay, equal to a loop over windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.session import scratch_path
from flowsieve.streaming import patterns as pt

EVERY, K = 50, 3
SCHEMA = "id long, v array<float>"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    x = r.normal(size=(230, 2)) * 0.2 + np.repeat([[0, 0], [5, 5], [0, 9], [30, 0], [0, 0]], 46, axis=0)
    return [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))] + [(900, None), (901, [1.0, float("nan")]), (902, [None, 1.0])]


def cut(spark, rows, cuts):
    """The outcome of pattern_batch over the micro-batches that ``cuts`` make of the rows."""
    store = scratch_path(spark, "patterns")
    step = pt.pattern_batch(store, "v", ["id"], ["id"], EVERY, K)
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        step(spark.createDataFrame(rows[a:b], SCHEMA), n)
    return store, step


def outcome(spark, store):
    samples = sorted(map(tuple, spark.read.parquet(f"{store}/samples").select("id", "window", F.round("min_distance", 6), "new_pattern").collect()))
    found = sorted((r["window"], r["position"], tuple(np.round(r["centre"], 6)), r["is_new"]) for r in spark.read.parquet(f"{store}/patterns").collect())
    return samples, found


def test_equal_to_a_loop_however_the_stream_is_cut(spark, rows):
    store, step = cut(spark, rows, [30, 170])  # the second micro-batch completes three windows, the third one
    got = outcome(spark, store)
    x = np.array([v for _, v in rows[:230]], dtype=float)
    before, want_centres, want_samples = None, [], []
    for w in range(5):
        part = x[w * EVERY:(w + 1) * EVERY]
        for i, v in enumerate(part):
            d = None if before is None else np.sqrt(((before - v) ** 2).sum(axis=1))
            want_samples.append((w * EVERY + i, w, None, None) if d is None else (w * EVERY + i, w, round(float(d.min()), 6), bool(d.min() > d.mean() + 2 * d.std())))
        if len(part) == EVERY:
            now = pt.lloyd(part, K)
            gap = None if before is None else np.sqrt(((now[:, None] - before[None]) ** 2).sum(axis=2)).min(axis=1)
            new = [False] * len(now) if gap is None else [bool(g) for g in gap > np.percentile(gap, 75)]
            want_centres += [(w, i, tuple(np.round(c, 6)), f) for i, (c, f) in enumerate(zip(now, new))]
            before = now
    assert got[1] == want_centres and len(want_centres) == 4 * K and any(c[3] for c in want_centres)
    assert [s[:2] for s in got[0]] == [s[:2] for s in want_samples]
    assert [s[3] for s in got[0]] == [s[3] for s in want_samples]
    assert np.allclose([s[2] for s in got[0][EVERY:]], [s[2] for s in want_samples[EVERY:]], atol=2e-6)
    # a replayed micro-batch, also an earlier one, changes nothing
    step(spark.createDataFrame(rows[30:170], SCHEMA), 1)
    assert outcome(spark, store) == got
    # one micro-batch for all, and an empty one
    other, again = cut(spark, rows, [])
    again(spark.createDataFrame([], SCHEMA), 1)
    assert outcome(spark, other) == got


def test_few_distinct_rows():
    assert pt.lloyd(np.ones((5, 2)), 3).tolist() == [[1.0, 1.0]]
    assert pt.lloyd(np.array([[0.0], [1.0], [0.0]]), 3).tolist() == [[0.0], [1.0]]


def test_watch_goes_on_where_it_stopped(spark, rows):
    source, store = scratch_path(spark, "pattern-source"), scratch_path(spark, "watched")
    spark.createDataFrame(rows[:70], SCHEMA).coalesce(1).write.parquet(f"{source}/a")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
    pt.watch_patterns(stream, "v", ["id"], ["id"], store, EVERY, K)
    spark.createDataFrame(rows[70:], SCHEMA).coalesce(1).write.parquet(f"{source}/b")
    samples, found = pt.watch_patterns(stream, "v", ["id"], ["id"], store, EVERY, K)
    assert samples.count() == 230 and found.count() == 4 * K
    whole, _ = cut(spark, rows, [])
    assert outcome(spark, store) == outcome(spark, whole)


def test_stream_of_a_table_in_a_folder_or_a_file_or_empty(spark, rows, tmp_path):
    """A table may be a folder of part files, whose names are not the table's; without any file there is no sample."""
    import pyarrow.parquet as pq

    from flowsieve.plans import views as v

    good = spark.createDataFrame(rows[:120], SCHEMA)
    good.repartition(3).write.parquet(f"{tmp_path}/folder/embeddings.parquet")
    (tmp_path / "file").mkdir()
    pq.write_table(good.toArrow(), f"{tmp_path}/file/embeddings.parquet")
    found = {}
    for kind in ("folder", "file"):
        stream = v.table_stream(spark, f"{tmp_path}/{kind}", "embeddings")
        samples, patterns = pt.watch_patterns(stream, "v", ["id"], ["id"], scratch_path(spark, "patterns"), EVERY, K)
        found[kind] = sorted(map(tuple, samples.select("id", "window", F.round("min_distance", 6), "new_pattern").collect()))
        assert len(found[kind]) == 120 and patterns.count() == 2 * K
    assert found["folder"] == found["file"]
    (tmp_path / "none").mkdir()
    none, patterns = pt.watch_patterns(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/none"), "v", ["id"], ["id"], scratch_path(spark, "patterns"), EVERY, K)
    assert none.count() == 0 == patterns.count()


def test_packet_stream_of_a_folder(spark, tmp_path, sf):
    from flowsieve.plans import views as v
    from flowsieve.streaming import flows as fs

    v.table(spark, sf, "events").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    out = fs.run_and_read(spark, v.packet_stream(spark, str(tmp_path)).select("pkt_id"), scratch_path(spark, "packets"))
    assert out.count() == v.packets(spark, sf).count()
