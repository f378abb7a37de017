"""Reuse of results within a sliding time-to-live.

A result computed at time s serves every equal request before s + ttl; the first request from then on is
computed again. Which requests are computed depends on the whole history of a fingerprint, yet no
fingerprint is replayed: every request points to the first one that its result could not serve, and
those on the chain from a certain start are found by doubling the pointers, in as many rounds as the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowsieve.operators.ordering import index_rows, match_keys
from flowsieve.operators.slices import with_slices
from flowsieve.session import materialize


def carried(df: DataFrame, key: list[str], order: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """``df`` with the last value that is not NULL up to each row of its key (``ahead``: the first one from it on).

    Rows travel once, to their (key, slice); what crosses a slice comes from a summary with one row per slice.
    """
    direction = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    b = with_slices(df, key, order)
    edge = (F.min if ahead else F.max)(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value"))))
    slices = b.groupBy(*key, "_b").agg(edge.alias("_edge"))
    across = Window.partitionBy(*key).orderBy(F.desc("_b") if ahead else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*key, "_b", F.last("_edge", ignorenulls=True).over(across)["_value"].alias("_carry"))
    inside = Window.partitionBy(*key, "_b").orderBy(*direction).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = match_keys(b, carry, [*key, "_b"])
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry")).drop("_b", "_carry")


def first_not_served(requests: DataFrame, seconds: float) -> DataFrame:
    """(fp, rn, next) from (fp, t, rn): the first request of the fingerprint at t + ``seconds`` or later, where there is one."""
    rows = requests.select("fp", F.col("t").alias("at"), F.lit(1).alias("kind"), "rn", F.col("rn").alias("real"))
    ends = requests.select("fp", (F.col("t") + seconds).alias("at"), F.lit(0).alias("kind"), "rn", F.lit(None).cast("long").alias("real"))
    found = carried(rows.union(ends), ["fp"], ["at", "kind", "rn"], "real", "next", ahead=True)
    return found.where("kind = 0 AND next IS NOT NULL").select("fp", "rn", "next")


def on_chains(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(fp, rn): the starts and all that their pointers lead to."""
    marked, jumps = materialize(starts, "computed"), materialize(pointers, "jumps")
    while not jumps.isEmpty():
        reached = marked.join(jumps, ["fp", "rn"]).select("fp", F.col("next").alias("rn"))
        marked = materialize(marked.union(reached).distinct(), "computed")
        ahead = jumps.select("fp", F.col("rn").alias("next"), F.col("next").alias("further"))
        jumps = materialize(jumps.join(ahead, ["fp", "next"]).select("fp", "rn", F.col("further").alias("next")), "jumps")
    return marked


def sliding_reuse(df: DataFrame, fingerprint: str, t: str, tie: str, seconds: float) -> DataFrame:
    """``df`` with ``reused`` and ``source_row``, the ``tie`` of the request whose result is served.

    Requests of a fingerprint come in order of ``t`` (in seconds) and ``tie``. Those without a fingerprint or a time
    are computed each and serve no other. Columns other than the three are kept as they are.
    """
    packed = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    narrow = df.select(F.col(fingerprint).alias("fp"), F.col(t).cast("double").alias("t"), F.col(tie).alias("tie"), packed)
    timed = F.col("fp").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t")
    numbered = materialize(index_rows(narrow.where(timed), ["fp"], ["t", "tie"]), "requests")
    # a request after so long a silence is computed whatever came before, so chains end there
    before = numbered.select("fp", (F.col("rn") + 1).alias("rn"), F.col("t").alias("before"))
    gaps = numbered.select("fp", "rn", "t").join(before, ["fp", "rn"], "left")
    starts = materialize(gaps.where(F.col("before").isNull() | (F.col("t") >= F.col("before") + seconds)).select("fp", "rn"), "starts")
    pointers = first_not_served(numbered.select("fp", "t", "rn"), seconds)
    pointers = pointers.join(starts.select("fp", F.col("rn").alias("next")), ["fp", "next"], "left_anti").select("fp", "rn", "next")
    computed = on_chains(starts, pointers).withColumn("computed", F.lit(True))
    marked = numbered.join(computed, ["fp", "rn"], "left").withColumn("own", F.when(F.col("computed"), F.col("tie")))
    served = carried(marked, ["fp"], ["rn"], "own", "source_row")
    out = served.select("row.*", F.col("computed").isNull().alias("reused"), "source_row")
    return out.union(narrow.where(~timed | timed.isNull()).select("row.*", F.lit(False), "tie"))
