"""Streaming flow assembly, scoring and counters, with batch twins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowsieve.operators.alerts import alert_rows, with_risk
from flowsieve.operators.flows import ORDER
from flowsieve.operators.ordering import match_keys, with_previous

# A flow closes after this silence; results are reused for this long.
IDLE_SECONDS = 120
REUSE_SECONDS = 300


def flow_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pktCount"), F.sum("size").alias("totalBytes"), F.min("t").alias("start"), F.max("t").alias("last"),
    ]


def stream_flows(packets: DataFrame, key: Sequence[str], idle: float = IDLE_SECONDS, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Flows closed by ``idle`` seconds of silence; packets later than ``delay`` are dropped."""
    session = F.session_window(ts, f"{idle} seconds")
    return packets.withWatermark(ts, delay).groupBy(*key, session).agg(*flow_aggs()).drop("session_window")


def batch_flows(packets: DataFrame, key: Sequence[str], idle: float = IDLE_SECONDS) -> DataFrame:
    """The same flows from a finished table. Session numbers are running counts of
    session starts, summed in two levels so that a busy key spreads over its slices."""
    key = list(key)
    p = with_previous(packets, key, ORDER, ["t"], keep_slice=True)
    p = p.withColumn("_new", (F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > idle)).cast("int"))
    totals = p.groupBy(*key, "_b").agg(F.sum("_new").alias("_s"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*key, "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = match_keys(p, offsets, [*key, "_b"]).withColumn("session", F.col("_o") + F.sum("_new").over(inside))
    return p.groupBy(*key, "session").agg(*flow_aggs())


def score_stream(requests: DataFrame, score: Column, keep: Sequence[str]) -> DataFrame:
    """Score, risk level and recommendation per request; stateless, so it runs on streams and tables alike."""
    return with_risk(requests.select(*keep, score.alias("threat_score")), "threat_score")


def alerts_of(scored: DataFrame) -> DataFrame:
    return alert_rows(scored)


def first_in_ttl(requests: DataFrame, fingerprint: str, ts: str = "ts", seconds: int = REUSE_SECONDS) -> DataFrame:
    """Requests to compute: the first of each fingerprint in each aligned window of the reuse time, as in ``alerts.reuse_results``.

    Which windows there are depends on the times alone, so how requests fall into micro-batches changes nothing
    about the number of requests per fingerprint and window. Requests without a time are not windowed and drop out at the watermark.
    """
    timed = requests.withWatermark(ts, f"{seconds} seconds").withColumn("_w", F.floor(F.unix_micros(ts) / F.lit(seconds * 1000000)))
    return timed.dropDuplicatesWithinWatermark([fingerprint, "_w"]).drop("_w")


def traffic_counters(packets: DataFrame, by: Sequence[str] = (), every: str = "1 minute", delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Requests, mean and approximate p95 latency and requests per second in tumbling windows."""
    p = packets.withWatermark(ts, delay) if delay else packets
    w = F.window(ts, every)
    out = p.groupBy(w, *by).agg(
        F.count(F.lit(1)).alias("requests"), F.avg("size").alias("mean_latency"), F.percentile_approx("size", 0.95).alias("p95_latency")
    )
    seconds = F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    rate = F.col("requests") / (seconds / F.lit(1000000.0))
    return out.select(F.unix_seconds("window.start").alias("window_start"), *by, "requests", "mean_latency", "p95_latency", rate.alias("requests_per_second"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append") -> int:
    """Drain what is available into a file sink, exactly once through the checkpoint; the number of rows dropped as late."""
    q = (
        stream.writeStream.format(kind).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])


def run_and_read(spark: SparkSession, stream: DataFrame, base: str, kind: str = "parquet") -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    run_to_files(stream, f"{base}/out", f"{base}/checkpoint", kind)
    return spark.read.schema(stream.schema).format(kind).load(f"{base}/out")
