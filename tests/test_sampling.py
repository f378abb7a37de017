"""Selection by digest against a plain ranking."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import sampling as sa


def ranked(rows):
    """id -> (1-based place in the class, class size)."""
    out = {}
    for c in {c for _, c in rows}:
        own = sorted((i for i, k in rows if k == c), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        out |= {i: (p, len(own)) for p, i in enumerate(own, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, None if i % 11 == 0 else "hot" if i % 3 else f"c{i % 40}") for i in range(4000)] + [(9999, "single")]


def test_mark_first(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, c string").withColumn("_n", F.lit("kept"))
    places = ranked(rows)
    wanted = {"none": F.lit(0), "three": F.lit(3), "half": F.floor(F.col("class_n") / 2), "every": F.lit(10**9)}
    got = sa.mark_first(df, "id", ["c"], wanted).collect()
    assert len(got) == len(rows)
    for r in got:
        place, n = places[r.id]
        assert (r.none, r.three, r.half, r.every) == (False, place <= 3, place <= n // 2, True) and r["_n"] == "kept"
    whole = ranked([(i, 0) for i, _ in rows])
    assert {r.id for r in sa.mark_first(df, "id", [], {"x": F.lit(100)}).where("x").collect()} == {i for i, (p, _) in whole.items() if p <= 100}
    assert sa.mark_first(df.limit(0), "id", ["c"], wanted).collect() == [] == sa.mark_first(df.limit(0), "id", [], wanted).collect()


def test_no_full_ranking(spark, rows):
    df = spark.createDataFrame(rows * 30, "id bigint, c string").withColumn("id", F.monotonically_increasing_id())
    split = sa.stratified_split(df, "id", "c")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}["train"] >= 0.69 * len(rows) * 30
    held = sa.bounded_holdout(df, "id", 0.2)
    assert held.count() == df.where(sa.unit_hash("id") < 0.2).count()
    assert sa.bounded_holdout(df, "id", 0.2, 500).count() == 500


def test_few_large_classes_do_not_move(spark, rows):
    """Rows of a class are compared with its limit where they are, so no task gets a whole class."""
    df = spark.createDataFrame(rows, "id bigint, c string")
    from flowsieve.operators.clean import drop_rare_classes
    from flowsieve.operators.models import with_weights

    for out in (sa.stratified_split(df, "id", "c"), drop_rare_classes(df, "c", ["id"]), with_weights(df, "c", ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_many_classes_are_joined_by_key(spark, monkeypatch, rows):
    from flowsieve.operators import ordering

    df = spark.createDataFrame(rows, "id bigint, c string")
    want = sorted(map(tuple, sa.stratified_split(df, "id", "c").select("id", "split").collect()))
    monkeypatch.setattr(ordering.store_small, "__defaults__", (3,))
    assert sorted(map(tuple, sa.stratified_split(df, "id", "c").select("id", "split").collect())) == want
    stats = df.where("c is not null").groupBy("c").count()
    assert ordering.join_class_stats(df, stats, ["c"], ["id"]).count() == df.where("c is not null").count()


def test_ranks_move_rows_once(spark):
    """Rows travel to their band and nowhere else: no sample, no cuts, no join that shuffles them."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id") % 1200).alias("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("c"))
    ranked = sa.rank_by_hash(df, "id", ["c"], total="n")
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    held = {}
    for r in ranked.collect():
        held.setdefault(r["c"], []).append((r["rn"], "" if r["id"] is None else hashlib.md5(str(r["id"]).encode()).hexdigest(), r["n"]))
    assert sum(map(len, held.values())) == 3000 and None in held
    for found in held.values():
        assert [rn for rn, _, _ in sorted(found)] == list(range(1, len(found) + 1)) and {n for *_, n in found} == {len(found)}
        assert [h for _, h, _ in sorted(found)] == sorted(h for _, h, _ in found)
    folds = sa.fold_numbers(df, "id", 4, "c").groupBy("c").pivot("fold", [0, 1, 2, 3]).count().collect()
    assert len(folds) == 4 and all(max(r[1:]) - min(r[1:]) <= 1 for r in folds)


def test_hash_below_is_the_unit_hash(spark):
    df = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    for share in (-1.0, 0.0, 0.2, 0.5, 1.0 - 0.15 - 0.15, 0.85, 1.0, 2.0):
        assert df.where(~sa.hash_below("id", share).eqNullSafe(sa.unit_hash("id") < share)).count() == 0
