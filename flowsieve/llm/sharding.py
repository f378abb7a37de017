"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each record scores every shard by ``-weight / ln(u)`` with ``u`` a hash of key and
shard name in (0, 1), and goes to the best. A further shard therefore only
takes records to itself, and a removed one only gives its own away. Everything
is a column expression; nothing but the numbering of slots moves rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.session import materialize

SLOT_ROWS = 20_000


def _draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from the upper 52 bits of a hash of key and shard."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key, 0 to ``len(weights) - 1``; weight 0 takes nothing. NULL keys count as one key."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.log(_draw(key, i))).alias("score"), F.lit(-i).alias("at")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["at"]).cast("int")


def assign_shards(rows: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their key; no row moves."""
    return rows.withColumn(name, rendezvous(F.col(key), weights))


def number_slots(rows: DataFrame, shard: str, order: Sequence[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each shard.

    ``rows`` must be a stored table (it is read three times). Its rows are dealt into
    buckets of about ``slot_rows`` by a hash of all columns, numbered inside the bucket,
    and shifted by the rows of the buckets before, so no shard is sorted in one task.
    Give the table a column that tells repeated rows apart, or they share a bucket.
    """
    shards = rows.groupBy(shard).count()
    parts = F.ceil(F.max("count") / slot_rows).cast("int")
    n = max(1, shards.agg(parts).first()[0] or 1)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, "_bucket").count()
    offsets = counts.select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = dealt.join(offsets, [shard, "_bucket"]).withColumn("slot", (F.row_number().over(inside) - 1 + F.col("_before")).cast("long"))
    return numbered.drop("_bucket", "_before")


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """The placement of every document under the law ``key``.

    Columns: doc_id, size (UTF-8 bytes plus 8; NULL text: 8), text_crc32 (NULL text as the empty
    one), law, shard, slot, grown_shard (the shard with one more of weight 1). Equal doc_ids share a shard, also
    NULL ones; repeated rows get slots of their own. An empty table gives an empty result.
    """
    now = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col("doc_id").cast("long"), now).alias("shard"),
        rendezvous(F.col("doc_id").cast("long"), [*now, 1.0]).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"),
    )
    slots = number_slots(materialize(placed, "placed"), "shard", ["doc_id", "_row"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float]) -> None:
    """Write the documents as Parquet, one folder per shard (column ``shard``), each by several tasks."""
    spread = assign_shards(docs, "doc_id", weights)
    spread.write.partitionBy("shard").parquet(path)
