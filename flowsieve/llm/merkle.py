"""Merkle manifest of a dataset, hashed level by level with lag and lead windows.

Rows of a group stand in one gapless order. On each level every ``ARITY``
consecutive nodes form a run: lag and lead columns of fixed offsets, masked by a
node's slot and the length of its run, give its left and right siblings, and the
first child of a run hashes it to the parent. Windows see aligned blocks of whole
runs, never a whole group. The siblings on the way up are handed down again from
the roots, one join per level, each an eighth of the one below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.session import materialize

ARITY = 8
BLOCK_RUNS = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for NULL, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def number(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 within each group, and ``n``, the rows of the group.

    ``rows`` must be a stored table. It is cut into ranges of (group, order) that follow the data; the
    range of a row is stored before it is counted, so a retry cannot move a border.
    """
    cut = rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(
        group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("n")
    )
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = cut.join(offsets, [group, "_part"]).withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1)
    return numbered.drop("_part", "_before")


def with_siblings(level: DataFrame) -> DataFrame:
    """A level (grp, pos, n, digest, ...) with ``left`` and ``right``: the digests of the other nodes of the run, joined."""
    slot, run = f"(pos % {ARITY})", f"least({ARITY}, n - (pos - pos % {ARITY}))"
    near = "OVER (PARTITION BY grp, _block ORDER BY pos)"
    left = [f"IF({slot} >= {j}, lag(digest, {j}) {near}, '')" for j in range(ARITY - 1, 0, -1)]
    right = [f"IF({slot} + {j} < {run}, lead(digest, {j}) {near}, '')" for j in range(1, ARITY)]
    blocks = level.withColumn("_block", F.expr(f"pos div {ARITY * BLOCK_RUNS}"))
    return blocks.selectExpr("*", f"concat({', '.join(left)}) AS left", f"concat({', '.join(right)}) AS right").drop("_block")


def parents(level: DataFrame) -> DataFrame:
    """The next level of the groups that have more than one node: the first child of each run hashes it."""
    first = with_siblings(level.select("grp", "pos", "n", "digest").where("n > 1")).where(F.col("pos") % ARITY == 0)
    return first.select(
        "grp", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n - 1) div {ARITY} + 1").alias("n"), digest(F.col("digest"), F.col("right")).alias("digest")
    )


def build(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees of stored leaves (grp, pos, n, digest), leaves first; a root has ``n`` = 1."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(materialize(parents(levels[-1]), "merkle-level"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(grp, digest): the root of each group."""
    out = levels[0].where("n = 1").select("grp", "digest")
    for level in levels[1:]:
        out = out.union(level.where("n = 1").select("grp", "digest"))
    return out


PATH = "array<struct<left:string,right:string>>"


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings on each level up to the root and on from there.

    ``tops`` has the path beyond the root for each group, and further columns that every leaf gets.
    """
    more = [c for c in tops.columns if c not in ("grp", "path")]
    above = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("n",)]
        done = level.where("n = 1").join(tops, "grp").select(*own, "path", *more)
        if above is not None:
            up = above.select("grp", F.col("pos").alias("_up"), F.col("path").alias("_rest"), *more)
            here = with_siblings(level.where("n > 1")).withColumn("_up", F.expr(f"pos div {ARITY}")).join(up, ["grp", "_up"])
            path = F.concat(F.array(F.struct("left", "right")), "_rest").alias("path")
            done = here.select(*own, path, *more).unionByName(done)
        above = done
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda up, s: digest(s["left"], up, s["right"]))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, from the leaf to the root, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered(docs: DataFrame) -> Column:
    """Whether 3 divides the crc32 of the decimal doc_id; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0


def manifest(docs: DataFrame, group: str = "lang") -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    Leaves of a group stand in order of doc_id (NULL first), equal ids in order of their digest; repeated rows are
    leaves each. Groups stand in order of their UTF-8 bytes, NULL first. NULL fields are encoded as ``-``, so
    a NULL text and an empty one differ. ``folded_root`` starts from the document as ``tampered`` says it was
    received, with upper-case A-Z lowered. An empty table gives an empty result. Other columns are ignored.
    """
    plain = docs.select(*[F.col(c) for c in FIELDS], F.concat(F.lit("+"), F.col(group).cast("string")).alias("grp"))
    lowered = [F.translate(F.col(c).cast("string"), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    other = F.when(tampered(docs), digest(*[field(c) for c in lowered]))
    leaves = plain.select(
        "doc_id", F.coalesce("grp", F.lit("")).alias("grp"), digest(*[field(F.col(c)) for c in FIELDS]).alias("digest"), other.alias("other"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["doc_id", "digest", "_row"]
    placed = materialize(number(materialize(leaves, "leaves"), "grp", order).drop("_row"), "numbered")
    levels = build(placed)

    subroots = materialize(roots(levels).withColumn("all", F.lit("")), "subroots")
    named = number(subroots.withColumnRenamed("grp", "name").withColumnRenamed("all", "grp"), "grp", ["name"])
    upper = build(materialize(named, "subroots-numbered"))
    top = roots(upper).select("grp", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = with_paths(upper, top).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path")

    paths = with_paths(levels, materialize(tops, "subroot-paths"))
    received = F.coalesce("other", "digest")
    out = paths.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(received, F.col("path")).alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
