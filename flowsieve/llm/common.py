"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (other columns cannot clash), a NULL text as the empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, or the first longer one that no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(parts: int = 5):
    """crc32 of ``doc_id`` as text, modulo ``parts``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


class Forest:
    """Union-find over ``0 .. n-1`` on whole arrays of links; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                jumped = self.root[self.root]
                if np.array_equal(jumped, self.root):
                    break
                self.root = jumped

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning star of each set: (member, root), at most n - 1 pairs."""
        members = np.flatnonzero(self.root != np.arange(len(self.root)))
        return members, self.root[members]


def runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut ``sizes`` into consecutive slices whose sum is at most ``most`` (or that hold one item)."""
    out, begin, total = [], 0, 0
    ends = np.cumsum(sizes)
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, total + most, side="right")))
        out.append((begin, end))
        total, begin = int(ends[end - 1]), end
    return out


def whole_groups(batches, columns: list[str], keys: list[str]):
    """From Arrow batches sorted by ``keys``: dicts of numpy arrays in which no key is cut in two."""
    held = None
    for batch in batches:
        now = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in columns}
        n = len(now[columns[0]])
        if not n:
            continue
        last = np.ones(n, bool)
        for k in keys:
            last &= now[k] == now[k][-1]
        cut = n - int(last.sum())
        held = {c: v[cut:] for c, v in now.items()}
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
    if held is not None and len(held[columns[0]]):
        yield held


def group_bounds(arrays: dict[str, np.ndarray], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal keys."""
    n = len(arrays[keys[0]])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= arrays[k][1:] != arrays[k][:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``start .. start + size - 1`` for each pair."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(int(sizes.sum())) + shift
