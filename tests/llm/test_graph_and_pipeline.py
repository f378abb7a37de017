"""The vector graph against all pairs, and the pipeline against its operators one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
import corpus_pipeline
from flowsieve.llm import catalog, langid, quality, simhash, vectorgraph
from flowsieve.llm.common import Forest


def brute_links(rows):
    """ids, links and least linked id of each row by all pairs in double precision."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    forest, n = Forest(len(rows)), np.zeros(len(rows), int)
    for dims in {len(v) for (_, v), good in zip(rows, ok) if good}:
        at = np.array([i for i, (_, v) in enumerate(rows) if ok[i] and len(v) == dims])
        x = np.array([rows[i][1] for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(x @ x.T >= 0.95)
        a, b = a[a != b], b[a != b]
        n[at] += np.bincount(a, minlength=len(at))
        forest.link(at[a], at[b])
    return n, forest.root


def check_vectors(got, rows, least_recall):
    rows = sorted(rows, key=lambda r: r[0])
    n, root = brute_links(rows)
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    links = np.array([found[i].n_links for i, _ in rows])
    assert (links <= n).all() and links.sum() >= least_recall * n.sum()
    same = [found[i].component_id == rows[root[at]][0] for at, (i, _) in enumerate(rows)]
    assert np.mean(same) >= least_recall
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_vectors(catalog.QUERIES["op7_vectorgraph"](spark, small).collect(), rows, 0.95)


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_odd_and_crowded_vectors(spark, block_rows):
    """A crowd around one point (cut into blocks when the limit is low), copies, and vectors without a direction."""
    rng = np.random.default_rng(0)
    crowd = rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.12
    rows = [(i, v.tolist()) for i, v in enumerate(crowd)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0]) for i in range(30)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None, *[0.0] * 6]), (304, [float("nan"), *[1.0] * 7]), (305, [float("inf"), *[1.0] * 7]), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("node", T.StringType()), T.StructField("n", T.StringType())])
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], kind)
    check_vectors(vectorgraph.near_duplicates(table, block_rows=block_rows).collect(), rows, 0.97)
    assert vectorgraph.near_duplicates(table.where("false")).count() == 0


def test_pruned_lists_reach_every_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = vectorgraph.robust_prune(x)
    assert len(lists) == 200 and all(0 < len(near) <= vectorgraph.DEGREE for near in lists)


def test_pipeline_on_whole_table(spark, small):
    """Each stage judged on its own input, by its operator's other form."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_copies", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, lambda t: sorted(r.doc_id for r in t.select("doc_id").collect())
    first = corpus_pipeline.language_stage(spark, docs, small).cache()
    named = langid.identify(docs).where("lang_pred <> 'und' and score >= 0.25")
    assert first.columns == columns and ids(first) == ids(named)
    assert first.count() > 0.9 * docs.where(F.length("text") > 0).count()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    second = corpus_pipeline.quality_stage(spark, first, small).cache()
    assert second.columns == columns and ids(second) == ids(quality.resample(first, labels).where("selected"))
    third = corpus_pipeline.copies_stage(spark, second, small).cache()
    groups = simhash.simhash_groups(second, words=4, distance=4)
    assert third.columns == columns and ids(third) == sorted({r.component_id for r in groups.collect()})
    packed = corpus_pipeline.packing_stage(spark, third, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids(third))
    assert {r.doc_id for r in entry.queries()["pipeline"](spark, small).select("doc_id").distinct().collect()} == set(ids(third))


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.withColumn("lang", F.when(F.length("text") > 30, "en").otherwise("de")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows}.isdisjoint({2, 3, 4, 6})


def test_pipeline_on_empty_tables(spark, odd, tmp_path):
    odd.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
