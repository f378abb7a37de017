"""Exact top-k search over vectors by distributed histogram selection.

Every query row is scored against every candidate row, in cells of a grid: a
block of queries meets a chunk of candidates, both of bounded size. No score is
kept. Each round a cell counts, for each of its queries, how many scores fall
into each of ``BINS`` equal bins of the query's present range, the counts are
summed over all cells, and the bin that holds the k-th largest score becomes
the next range, until it is one score wide. A last pass keeps the scores above
that limit and, of those equal to it, the smallest ids that are still needed.

A cell reports only the bins down to its own k-th score: the k-th of all rows
cannot lie below. So a cell sends at most k rows for a query and round, and ties
(a vector with a million copies) are cut to k rows where they are found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.session import materialize

BINS = 1024
QUERY_ROWS = 4096
CHUNK_ROWS = 4096
SCORES_AT_ONCE = 1 << 20
SCALE = 256.0
#: Scores end here; the double product of usual vectors is far below and exact.
MOST = 1 << 62
CELL = ["dim", "i", "j"]


def _components(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of integers, held as doubles."""
    flat = pa.chunked_array([c.flatten() for c in vectors.chunks], vectors.type.value_type).to_numpy().astype(np.float64)
    widest = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * flat, -widest, widest)).reshape(len(vectors), -1)


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer matrices, ended at plus and minus ``MOST``.

    Rows whose components are too large for exact doubles go through Python's integers.
    """
    safe = (2.0**53 / max(1, q.shape[1])) ** 0.5
    large_q, large_c = (np.flatnonzero((np.abs(m) > safe).any(axis=1)) for m in (q, c))
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.clip(np.nan_to_num(q @ c.T), -float(MOST), float(MOST)).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m]
    exact = lambda a, b: max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b))))
    if len(large_q):
        others = whole(c)
        for i, row in zip(large_q, whole(q[large_q])):
            out[i] = [exact(row, b) for b in others]
    if len(large_c):
        others = whole(q)
        for j, row in zip(large_c, whole(c[large_c])):
            out[:, j] = [exact(a, row) for a in others]
    return out


def _tiles(queries: pa.Table, candidates: pa.Table):
    """Slices of a cell's queries with their scores and which of these are a query's own row."""
    q, c = _components(queries["vec"]), _components(candidates["vec"])
    own_rows, rows = queries["row"].to_numpy(), candidates["row"].to_numpy()
    by_row = np.argsort(rows)
    step = max(1, SCORES_AT_ONCE // max(1, len(c)))
    for a in range(0, len(q), step):
        at = slice(a, a + step)
        place = np.minimum(np.searchsorted(rows, own_rows[at], sorter=by_row), len(rows) - 1)
        here = np.flatnonzero(rows[by_row[place]] == own_rows[at])
        yield at, inner_products(q[at], c), (here, by_row[place[here]])


COUNTS = "row bigint, bin int, n bigint"


def _count(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """The occupied bins of each query of a cell, from the top down to the bin of its k-th score in the cell."""
    row, lo, span, need = (queries[x].to_numpy() for x in ("row", "lo", "span", "need"))
    parts = []
    if len(queries) and len(candidates):
        for at, scores, own in _tiles(queries, candidates):
            shift = scores - lo[at, None]
            inside = (shift >= 0) & (shift < span[at, None])
            inside[own] = False
            i, j = np.nonzero(inside)
            bins = shift[i, j] // -(-span[at] // BINS)[i]
            counts = np.bincount(i * BINS + bins, minlength=len(scores) * BINS).reshape(len(scores), BINS)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            i, bins = np.nonzero((counts > 0) & (above < need[at, None]))
            parts.append((row[at][i], bins, counts[i, bins]))
    cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
    return pa.table({"row": pa.array(cols[0], pa.int64()), "bin": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int64())})


FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def _select(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """The scores of a cell above each query's limit, and of those equal to it the smallest ids, as many as are needed."""
    candidates = candidates.sort_by("id")  # NULL last
    row, limit, need = (queries[x].to_numpy() for x in ("row", "lo", "need"))
    parts_i, parts_j, parts_s = [], [], []
    if len(queries) and len(candidates):
        for at, scores, own in _tiles(queries, candidates):
            equal, more = scores == limit[at, None], scores > limit[at, None]
            equal[own] = more[own] = False
            i, j = np.nonzero(more | (equal & (np.cumsum(equal, axis=1) <= need[at, None])))
            parts_i.append(i + at.start)
            parts_j.append(j)
            parts_s.append(scores[i, j])
    i, j, s = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (parts_i, parts_j, parts_s))
    return pa.table({"row": queries["row"].take(i), "query_id": queries["id"].take(i), "vec_id": candidates["id"].take(j), "score": pa.array(s, pa.int64())})


def _in_cells(queries: DataFrame, candidates: DataFrame, blocks: int, chunks: int, work, schema: str) -> DataFrame:
    """``work`` on every block of queries with every chunk of candidates of the same length."""
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("i", part(blocks)).withColumn("j", every(chunks))
    right = candidates.select("row", "id", "vec", "dim", every(blocks).alias("i"), part(chunks).alias("j"))
    spark = queries.sparkSession
    tasks = max(1, min(blocks * chunks * 2, int(spark.conf.get("spark.sql.shuffle.partitions")) * 16))
    dealt = [x.toDF(*x.columns).repartition(tasks, *CELL).groupBy(*CELL) for x in (left, right)]  # own column ids: both come from one table
    return dealt[0].cogroup(dealt[1]).applyInArrow(work, schema)


def prepare(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The vectors that take part, with a row number, their length, their norm and whether they are queries; stored."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(vector_col)
    usable = vectors.where(vec.isNotNull()).where(~F.exists(vec, bad))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * SCALE + 1, F.lit(2.0)))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    return materialize(rows.select("*", F.monotonically_increasing_id().alias("row"), F.size("vec").alias("dim"), F.sqrt(square).alias("norm")), "vectors")


def first_ranges(rows: DataFrame, k: int) -> DataFrame:
    """(row, lo, span, need) of each query: all scores it can have, by the longest vector there is."""
    longest = rows.agg(F.max("norm")).first()[0] or 0.0
    reach = F.ceil(F.least(F.col("norm") * longest * (1 + 1e-9) + 1, F.lit(float(MOST)))).cast("long")
    reach = F.least(reach, F.lit(MOST))
    span = F.when(reach < MOST, reach * 2 + 1).otherwise(F.lit((1 << 63) - 1))
    return rows.where("is_query").select("row", (-reach).alias("lo"), span.alias("span"), F.lit(k).cast("long").alias("need"))


def next_ranges(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each range, the bin that holds the score looked for; ``need`` is its rank from the top of that bin.

    Where there are fewer scores than that rank, the lowest occupied bin.
    """
    down = Window.partitionBy("row").orderBy(F.desc("bin"))
    summed = counts.groupBy("row", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
    place = F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))
    reached = F.max(F.when(F.col("upto") >= F.col("need"), place))
    chosen = summed.join(state.select("row", "need"), "row").groupBy("row").agg(F.coalesce(reached, F.min(place)).alias("c"))
    width = F.expr(f"(span - 1) div {BINS} + 1")
    below = F.col("c.bin") * width
    moved = state.join(chosen, "row").select("row", (F.col("lo") + below).alias("lo"), F.least(width, F.col("span") - below).alias("span"), (F.col("need") - F.col("c.above")).alias("need"))
    return materialize(moved, "ranges")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k`` other rows of the largest score.

    The score is the inner product of ``floor(256 * component)``, an exact integer (beyond plus or
    minus 2^62 it ends there). Equal scores go by smaller id, NULL ids last. Rows whose vector is NULL or holds
    a NULL or non-finite component take no part; vectors of unlike length have no score; empty vectors
    score 0 with each other. Repeated rows are candidates each, also for one another, and repeated queries
    are answered each. With fewer than ``k`` candidates all are returned. An empty table gives an empty result.
    """
    rows = prepare(vectors, is_query, id_col, vector_col)
    n, n_queries = rows.count(), rows.where("is_query").count()
    blocks, chunks = max(1, -(-n_queries // query_rows)), max(1, -(-n // chunk_rows))
    state = first_ranges(rows, k)
    queries = rows.where("is_query").select("row", "id", "vec", "dim")
    while (state.agg(F.max("span")).first()[0] or 1) > 1:
        state = next_ranges(state, _in_cells(queries.join(state, "row"), rows, blocks, chunks, _count, COUNTS))
    found = _in_cells(queries.join(state, "row"), rows, blocks, chunks, _select, FOUND)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
