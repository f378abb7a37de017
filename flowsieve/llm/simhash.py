"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set if more than half of the shingle hashes have it.
The 64 bits are cut into blocks with thresholds whose sum exceeds the allowed
distance, so that two close fingerprints are close within at least one block.
In a block, the anchors are the words of a covering code: a Hamming code of
15 bits times all settings of the remaining bits, covering radius 1. Every
fingerprint is copied to each anchor within covering radius plus threshold;
the nearest anchor is its home. A close pair then meets at the home of either
one, and only pairs with one side at home are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.common import Forest, bounded_batches, fresh, group_bounds, ranges, runs, whole_groups
from flowsieve.llm.components import connected_components
from flowsieve.operators.ordering import join_heavy_stats
from flowsieve.session import materialize

BITS = 64
SEED = 42
HOME_ROWS = 4096
PAIRS_AT_ONCE = 1 << 21
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 if it has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(first), HASHES_AT_ONCE):
        pairs = zip(first[at : at + HASHES_AT_ONCE], last[at : at + HASHES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, fp bigint"

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return narrow.mapInArrow(work, schema)


class Block:
    """``width`` bits from ``low`` on, the anchors of its covering code, and the error patterns that lead to them.

    ``check`` parity bits give a Hamming code on the first ``2**check - 1`` bits;
    the other bits are free. ``masks[s]`` holds every pattern of at most radius plus
    ``threshold`` bits that turns a word with syndrome ``s`` into an anchor, lightest first.
    """

    def __init__(self, low: int, width: int, threshold: int, check: int):
        self.low, self.width, self.threshold = low, width, threshold
        self.coded = min((1 << check) - 1, width)
        self.radius = 1 if check else 0
        if check and self.coded < (1 << check) - 1:
            raise ValueError("the block is narrower than its code")
        by = [[] for _ in range(1 << check)]
        for weight in range(self.radius + threshold + 1):
            for bits in combinations(range(width), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= b + 1 if b < self.coded else 0
                by[syndrome].append(sum(1 << b for b in bits))
        self.counts = np.array([len(x) for x in by])
        self.masks = np.zeros((len(by), self.counts.max()), np.uint64)
        for s, found in enumerate(by):
            self.masks[s, : len(found)] = found

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for b in range(self.coded):
            out ^= np.where((words >> np.uint64(b)) & np.uint64(1), b + 1, 0)
        return out

    def anchors(self, fps: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, is home) for each copy."""
        words = (fps >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)
        s = self.syndrome(words)
        n = np.ones(len(fps), np.int64) if homes_only else self.counts[s]
        row = np.repeat(np.arange(len(fps)), n)
        at = ranges(np.zeros(len(fps), np.int64), n)
        return row, words[row] ^ self.masks[s[row], at], at == 0


def layout(distance: int, check: int = 4) -> list[Block]:
    """Blocks for pairs at ``distance`` bits or fewer: the sum of (threshold + 1) is distance + 1."""
    n = min(3, distance + 1)
    widths = [BITS // n + (1 if i >= n - BITS % n else 0) for i in range(n)]
    thresholds = [(distance + 1) // n + (1 if i < (distance + 1) % n else 0) - 1 for i in range(n)]
    lows = [sum(widths[:i]) for i in range(n)]
    return [Block(lo, w, t, check if t else 0) for lo, w, t in zip(lows, widths, thresholds)]


def _copies(blocks: list[Block], homes_only: bool):
    def work(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, block in enumerate(blocks):
                row, anchor, home = block.anchors(fps, homes_only)
                key = anchor.astype(np.int64) + (k << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    return work


def _compare(distance: int):
    keys = ["key", "i", "j"]

    def work(batches):
        for rows in whole_groups(batches, [*keys, "fp", "home"], keys):
            starts, ends = group_bounds(rows, keys)
            size = ends - starts
            group = np.repeat(np.arange(len(starts)), size)
            distinct, node = np.unique(rows["fp"].view(np.uint64), return_inverse=True)
            forest = Forest(len(distinct))
            homes = np.flatnonzero(rows["home"])
            homes = homes[size[group[homes]] > 1]
            sizes = size[group[homes]]
            for a, b in runs(sizes, PAIRS_AT_ONCE):
                left = np.repeat(node[homes[a:b]], sizes[a:b])
                right = node[ranges(starts[group[homes[a:b]]], sizes[a:b])]
                close = np.bitwise_count(distinct[left] ^ distinct[right]) <= distance
                forest.link(left[close], right[close])
            member, root = forest.edges()
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(distinct[member].view(np.int64)), pa.array(distinct[root].view(np.int64))], names=["a", "b"])

    return work


def close_links(fps: DataFrame, distance: int = 4, home_rows: int = HOME_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all pairs at ``distance`` bits or fewer.

    Not every pair is a link, but any two close fingerprints are joined by a path
    of close pairs. An anchor that is home to more than ``home_rows`` fingerprints
    is cut into a grid of cells (home part i against member part j), each its own group.
    """
    blocks = layout(distance)
    homes = fps.mapInArrow(_copies(blocks, True), "key bigint, fp bigint, home boolean").groupBy("key").count()
    hot = materialize(homes.where(F.col("count") > home_rows).select("key", F.ceil(F.col("count") / home_rows).cast("int").alias("k")), "hot-anchors")
    rows = fps.mapInArrow(_copies(blocks, False), "key bigint, fp bigint, home boolean").join(hot, "key", "left")
    k, own = F.col("k"), F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    parts = F.sequence(F.lit(0), k - 1)
    as_member = F.transform(parts, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("home")))
    as_home = F.transform(parts, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("home")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home")))
    cells = F.when(k.isNull(), alone).when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
    dealt = rows.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "fp", "c.home")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(distance), "a bigint, b bigint")


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", home_rows: int = HOME_ROWS) -> DataFrame:
    """One row per document: ``id``, ``fp`` (signed long) and ``component_id``, the smallest id reachable over close fingerprints.

    NULL and empty texts and texts of white space have fingerprint 0 and link like any other;
    shorter texts than ``words`` words are one shingle. Equal rows give equal rows. NULL ids never
    become a component id unless a component has no other. An empty table gives an empty result.
    """
    table = materialize(fingerprints(docs, words, id_col), "fingerprints")
    fps = table.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
    fps = materialize(fps, "distinct-fingerprints")
    nodes = materialize(connected_components(close_links(fps.select("fp"), distance, home_rows)), "components")
    members = fps.join(nodes, fps["fp"] == nodes["node"], "left").select("fp", "first_id", "_n", F.coalesce("root", "fp").alias("root"))
    members = materialize(members, "members")
    roots = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    labels = join_heavy_stats(members.select("fp", "_n", "root"), roots, ["root"], "_size").select("fp", "_n", "component_id")
    labels = materialize(labels, "labels")
    return join_heavy_stats(table, labels, ["fp"], "_n").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays (of equal ids, one; NULL ids last).

    NULL, empty and white texts are one group. All columns stay as they are, whatever their names. An empty table
    gives an empty result.
    """
    row = fresh(docs.columns, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    groups = simhash_groups(numbered.select(own.alias("_id"), "text"), words, distance, "_id")
    dropped = materialize(groups.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id.row").alias(row)), "copies")
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
