"""Near-duplicate embeddings over a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to the shards of their nearest centroids, so
shards overlap. Each shard builds a robust-pruned neighbour graph of its nodes; a node's adjacency
lists from all its shards are united. Every node then searches each of its shards: greedily
from the medoid towards the closest nodes, and from every hit on to all its neighbours, until
no further one is in range. Hits are verified in double precision, counted in one shard each,
and recall is audited against brute force for a bounded set of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowsieve.llm.common import Forest, group_bounds, whole_groups
from flowsieve.llm.components import connected_components
from flowsieve.operators.ordering import join_heavy_stats
from flowsieve.session import materialize

THRESHOLD = 0.95
SHARD_ROWS = 512
OVERLAP = 3
#: Vectors for the centroids, at most.
SAMPLE = 16_384
#: A shard with more nodes is cut into blocks, and each pair of blocks searched on its own.
BLOCK_ROWS = 2048
DEGREE, POOL, ALPHA = 24, 64, 1.2
BEAM, HOPS = 16, 24
AUDIT_QUERIES = 256


def clean_vectors(table: DataFrame, id_col: str, column: str) -> DataFrame:
    """(vec_id, v): v is NULL for a vector that is NULL, empty or zero or has NULL or non-finite components."""
    v = F.col(column).cast(T.ArrayType(T.DoubleType()))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).alias("vec_id"), F.when(good, v).alias("v"))


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


class Centroids:
    """Two levels of centroids, about the square root of their number in each, so assignment stays cheap."""

    def __init__(self, sample: np.ndarray, leaves: int):
        groups = max(1, int(np.sqrt(leaves)))
        self.tops = _kmeans(sample, groups)
        own = np.argmax(sample @ self.tops.T, axis=1)
        parts = [_kmeans(sample[own == g], max(1, round(leaves * (own == g).mean())), seed=g) for g in range(len(self.tops)) if (own == g).any()]
        self.tops = self.tops[[g for g in range(len(self.tops)) if (own == g).any()]]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.leaves = np.concatenate(parts)

    def nearest(self, x: np.ndarray, n: int, tops: int = 4) -> list[np.ndarray]:
        """The n nearest leaves of each row among those of its nearest top centroids, nearest first."""
        out = []
        order = np.argsort(-(x @ self.tops.T), axis=1)[:, :tops]
        for row, near in zip(x, order):
            leaf = np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in near])
            score = self.leaves[leaf] @ row
            out.append(leaf[np.argsort(-score, kind="stable")[:n]])
        return out


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of every row: of its ``pool`` nearest, each kept one drops those that are closer to it than to the row by ``alpha``."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    pool = min(pool, n - 1)
    out = []
    for a in range(0, n, 256):
        sims = x[a : a + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        own = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = x[near] @ x[near].transpose(0, 2, 1)
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(pool):
            take = alive[:, j] & (kept.sum(axis=1) < degree)
            kept[:, j] = take
            # squared distances: drop i if alpha * d(j, i) <= d(row, i)
            covered = alpha * (1 - between[:, j]) <= 1 - own
            alive &= ~(covered & take[:, None])
        out += [near[i][kept[i]] for i in range(len(near))]
    return out


class Graph:
    """A shard's nodes with adjacency lists (padded), undirected."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, neighbours: list):
        self.x, order = x, np.argsort(ids)
        a = np.repeat(np.arange(len(ids)), [len(v) for v in neighbours])
        wanted = np.concatenate([np.asarray(v, np.int64) for v in neighbours]) if len(a) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ids[order], wanted), len(ids) - 1)
        here = ids[order][at] == wanted  # a united list also names nodes of other shards
        a, b = a[here], order[at[here]]
        pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1))
        self.to = pairs[:, 1]
        centre = x.mean(axis=0)
        self.medoid = int(np.argmax(x @ centre))

    def spread(self, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, neighbour) of the given (query, node)."""
        size = self.first[node + 1] - self.first[node]
        shift = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.repeat(q, size), self.to[np.arange(int(size.sum())) + shift]

    def search(self, queries: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """A matrix: which nodes each query has found in range. Greedy search with a beam, then expansion of all hits."""
        nq, n = len(queries), len(self.x)
        seen, hit = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
        score = np.full((nq, n), -np.inf)
        new = (np.arange(nq), np.full(nq, self.medoid))
        done = np.zeros((nq, n), bool)
        for _ in range(HOPS):
            if len(new[0]):
                q, v = new
                seen[q, v] = True
                score[q, v] = np.einsum("ij,ij->i", queries[q], self.x[v])
            beam = np.argpartition(-score, min(BEAM, n) - 1, axis=1)[:, : min(BEAM, n)]
            rows = np.repeat(np.arange(nq), beam.shape[1])
            nodes = beam.ravel()
            open_ = (score[rows, nodes] > -np.inf) & ~done[rows, nodes]
            if not open_.any():
                break
            done[rows[open_], nodes[open_]] = True
            new = self._fresh(seen, *self.spread(rows[open_], nodes[open_]))
        hit = score >= threshold
        front = np.nonzero(hit)
        while len(front[0]):
            q, v = self._fresh(seen, *self.spread(*front))
            seen[q, v] = True
            close = np.einsum("ij,ij->i", queries[q], self.x[v]) >= threshold
            front = q[close], v[close]
            hit[front] = True
        return hit

    @staticmethod
    def _fresh(seen, q, v):
        if not len(q):
            return q, v
        code = np.unique((q * seen.shape[1] + v)[~seen[q, v]])
        return code // seen.shape[1], code % seen.shape[1]


def _verified(hit: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Keep only pairs whose cosine, in double precision, reaches the threshold."""
    q, v = np.nonzero(hit)
    for i in range(0, len(q), 1 << 16):
        s = slice(i, i + (1 << 16))
        bad = np.einsum("ij,ij->i", a[q[s]], b[v[s]]) < threshold
        hit[q[s][bad], v[s][bad]] = False
    return hit


def _arrays(batch_column) -> np.ndarray:
    flat = batch_column.values if hasattr(batch_column, "values") else batch_column.combine_chunks().values
    return flat.to_numpy(zero_copy_only=False).reshape(len(batch_column), -1)


def _build(batches):
    """Rows sorted by shard and block: (node, neighbours) for each."""
    for g in whole_groups(batches, ["leaf", "block", "node", "v"], ["leaf", "block"]):
        for a, b in zip(*group_bounds(g, ["leaf", "block"])):
            ids, x = g["node"][a:b], np.stack(g["v"][a:b])
            near = robust_prune(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[n] for n in near], pa.list_(pa.int64()))], names=["node", "near"])


def _search(threshold: float):
    keys = ["leaf", "i", "j"]

    def work(batches):
        for g in whole_groups(batches, [*keys, "block", "node", "n", "v", "near", "leaves"], keys):
            for a, b in zip(*group_bounds(g, keys)):
                c = {k: v[a:b] for k, v in g.items()}
                x, size = np.stack(c["v"]), b - a
                leaf, i, j = int(c["leaf"][0]), int(c["i"][0]), int(c["j"][0])
                found = np.zeros((size, size), bool)
                left, right = np.flatnonzero(c["block"] == i), np.flatnonzero(c["block"] == j)
                graphs = {k: Graph(x[rows], c["node"][rows], list(c["near"][rows])) for k, rows in ((i, left), (j, right)) if len(rows)}
                for queries, nodes, k in ((left, right, j), (right, left, i))[: 1 if i == j else 2]:
                    if len(queries) and len(nodes):
                        for at in range(0, len(queries), 512):
                            part = queries[at : at + 512]
                            hit = _verified(graphs[k].search(x[part], threshold), x[part], x[nodes], threshold)
                            found[np.ix_(part, nodes)] |= hit
                found |= found.T
                np.fill_diagonal(found, False)
                u, v = np.nonzero(found)
                # a pair that shares several shards is counted in the one with the smallest number
                lists = np.full((size, OVERLAP), -1)
                for r, own in enumerate(c["leaves"]):
                    lists[r, : len(own)] = own
                links, forest = np.zeros(size, np.int64), Forest(size)
                for s in range(0, len(u), 1 << 18):
                    p, q = u[s : s + (1 << 18)], v[s : s + (1 << 18)]
                    common = (lists[p][:, :, None] == lists[q][:, None, :]) & (lists[p] >= 0)[:, :, None]
                    least = np.where(common.any(axis=2), lists[p], np.iinfo(np.int64).max).min(axis=1)
                    mine = least == leaf
                    links += np.bincount(p[mine], weights=c["n"][q[mine]], minlength=size).astype(np.int64)
                    forest.link(p, q)
                member, root = forest.edges()
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([c["node"][some], c["node"][member]])), pa.array(np.concatenate([links[some], np.zeros(len(member), np.int64)])),
                     pa.array([None] * len(some) + c["node"][root].tolist(), pa.int64())], names=["node", "links", "root"])

    return work


def audit_recall(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT_QUERIES) -> DataFrame:
    """One row (audit_queries, audit_recall): of the links of at most ``queries`` nodes, the first by a hash, the share found.

    ``nodes`` (node, n, v) is compared with the queries in blocks; ``links`` (node, links) holds what was found.
    """
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(queries).select("node", "v").toArrow()
    ids = chosen.column("node").to_numpy()
    x = np.array(chosen.column("v").to_pylist(), float)

    def work(batches):
        want = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(ids) and batch.num_rows:
                own = batch.column(0).to_numpy()
                hit = (x @ _arrays(batch.column(2)).T >= threshold) & (ids[:, None] != own[None])
                want += hit @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(want)], names=["node", "want"])

    wanted = nodes.select("node", "n", "v").mapInArrow(work, "node bigint, want bigint").groupBy("node").agg(F.sum("want").alias("want"))
    both = wanted.join(links, "node", "left").select("want", F.least("want", F.coalesce("links", F.lit(0))).alias("got"))
    return both.agg(F.count(F.lit(1)).alias("audit_queries"), F.coalesce(F.sum("got") / F.nullif(F.sum("want"), F.lit(0)), F.lit(1.0)).alias("audit_recall"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audit_recall.

    Vectors without a direction (NULL, zero, empty, NULL or non-finite components) have no links and are their own component. Vectors
    of another length than most others link only among those of their length. Equal vectors link with each other. Repeated ids get
    a row each. An empty table gives an empty result.
    """
    spark = table.sparkSession
    clean = materialize(clean_vectors(table, id_col, column).withColumn("key", F.sha2(F.to_json("v"), 256)), "vectors")
    classes = clean.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("raw"))

    def unit(batches):
        for batch in batches:
            v = batch.column(3)
            rows = [_unit([r])[0] for r in v.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.float64()))], names=["key", "first", "n", "v"])

    kind = clean.schema["vec_id"].dataType.simpleString()
    nodes = classes.mapInArrow(unit, f"key string, first {kind}, n bigint, v array<double>").withColumn("node", F.xxhash64("key")).withColumn("dims", F.size("v"))
    nodes = materialize(nodes, "nodes")
    parts = []
    for r in sorted(nodes.groupBy("dims").count().collect()):  # a table has vectors of one length, or of very few
        parts.append(_links(nodes.where(F.col("dims") == r["dims"]).select("node", "n", "v"), r["count"], threshold, shard_rows, block_rows))
    if not parts:
        return clean.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    links, recalls = parts[0]
    for more, recall in parts[1:]:
        links, recalls = links.union(more), recalls.union(recall)
    links = materialize(links, "links")
    roots = materialize(connected_components(links.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    members = nodes.select("key", "node", "first", "n").join(counted, "node", "left").join(roots, "node", "left")
    members = materialize(members.withColumn("root", F.coalesce("root", "node")), "members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    labels = join_heavy_stats(members, least, ["root"], "_size").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "n")
    labels = materialize(labels, "labels")
    linked = join_heavy_stats(clean.where("key is not null").select("vec_id", "key"), labels, ["key"], "n").select("vec_id", "n_links", "component_id")
    alone = clean.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    recall = recalls.agg(F.min("audit_recall").alias("r"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", recall.scalar())


def _links(nodes: DataFrame, count: int, threshold: float, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, links, root) rows of nodes of one length, and their audit."""
    share = min(1.0, 1.5 * SAMPLE / count)
    u = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = nodes.where(u < share).select("v").limit(SAMPLE).toArrow()  # at most SAMPLE vectors
    centroids = Centroids(np.array(sample.column("v").to_pylist() or nodes.select("v").limit(1).toArrow().column("v").to_pylist(), float), max(1, -(-count // shard_rows)))

    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def leaves(v: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in shared.value.nearest(np.stack(v.to_numpy()), OVERLAP)])

    dealt = nodes.withColumn("leaves", leaves("v"))
    dealt = materialize(dealt, "dealt")
    copies = dealt.select("node", "n", "v", "leaves", F.explode("leaves").alias("leaf"))
    sizes = copies.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("k"))
    sizes = materialize(sizes, "sizes")
    blocks = copies.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("node", "leaf"), F.col("k")).cast("int"))
    rows = blocks.select("leaf", "block", "node", "v").repartition("leaf", "block").sortWithinPartitions("leaf", "block")
    # each node has at most OVERLAP lists of DEGREE
    near = materialize(rows.mapInArrow(_build, "node bigint, near array<bigint>").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    own, k = F.col("block"), F.col("k")
    cells = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    dealt_cells = blocks.join(near, "node").select("leaf", F.explode(cells).alias("c"), "block", "node", "n", "v", "near", "leaves").select("leaf", "c.i", "c.j", "block", "node", "n", "v", "near", "leaves")
    grouped = dealt_cells.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    links = materialize(grouped.mapInArrow(_search(threshold), "node bigint, links bigint, root bigint"), "found")
    return links, audit_recall(nodes, links.groupBy("node").agg(F.sum("links").alias("links")), threshold)
