"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one aggregate and one join over the links; hub nodes are spread
over tasks, and each round is written to the shared folder, so the plan stays
short and a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsieve.operators.ordering import join_heavy_stats
from flowsieve.session import materialize


def _least(links: DataFrame) -> DataFrame:
    """Each link (a, b) with ``m``, the least of ``a`` and all its partners."""
    stats = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    stats = stats.select("a", F.least("a", "m").alias("m"), "_n")
    return join_heavy_stats(links, stats, ["a"], "_n").select("a", "b", "m")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller partner, which has none itself."""
    chained = links.select("a").join(links.select(F.col("b").alias("a")), "a", "left_semi")
    return links.groupBy("a").count().where("count > 1").isEmpty() and chained.isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); ``root`` is the smallest node of the component.

    Links with a NULL end and links from a node to itself connect nothing. An
    empty table gives an empty result. Repeated links and either direction are fine.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "links")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _least(large)
        pairs = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = materialize(small.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
