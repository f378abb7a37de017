"""Keyed state with event-time timers: ordered work per key on a stream, whatever the micro-batches are.

Rows of a key wait in list state until the watermark has passed them; a timer then hands them on in
order. What is computed from them depends on the order of events alone, not on how they fell into
micro-batches or, within the watermark's delay, on the order they came in. Rows later than that are dropped by
Spark, which counts them (``run_to_files`` returns the count). ``run_to_end`` closes a finished
input: a last row far in the future moves the watermark on, so open windows, sessions and waiting rows follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from flowsieve.streaming.change import (
    ADAPT_RATE, DRIFT_LIMIT, DRIFT_WINDOW, SCORE_LEAST, SCORE_STDS, SCORE_WINDOW, WARNING_LIMIT, drift_steps, threshold_steps,
)
from flowsieve.streaming.flows import REUSE_SECONDS, run_to_files

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_OF_TIME = "2250-01-01 00:00:00"  # pandas holds no later ones


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in order of event time. ``step(rows, past)`` gives (columns, past), ``past`` being
    a tuple of ``past_schema`` or None. The first two columns of a row are the key and the event time in microseconds."""

    def __init__(self, schema: str, names: list[str], order: list[str], step: Callable, past_schema: str):
        self.schema, self.names, self.order, self.step, self.past_schema = schema, names, order, step, past_schema

    def init(self, handle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", self.schema)
        self.past = handle.getValueState("past", self.past_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # the end of the input
            return iter(())
        first = None
        for pdf in rows:
            pdf = pdf[self.names]
            self.early.appendList(list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)))
            first = min(int(pdf["event_us"].min()), first if first is not None else 1 << 62)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, event_us: int) -> None:
        """One timer for each key, at the earliest row that waits."""
        due, known = -(-event_us // 1000), list(self.handle.listTimers())
        if not known or due < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame(list(self.early.get()), columns=self.names)
        ready = waiting["event_us"] <= passed
        rest = waiting[~ready]
        self.early.clear()
        if len(rest):
            self.early.put(list(rest.astype(object).where(rest.notna(), None).itertuples(index=False, name=None)))
            self.handle.registerTimer(-(-int(rest["event_us"].min()) // 1000))  # the one that rings now goes by itself
        rows = waiting[ready].sort_values(["event_us", *self.order]).reset_index(drop=True)
        if len(rows):
            out, past = self.step(rows, self.past.get() if self.past.exists() else None)
            self.past.update(past)
            yield rows.drop(columns="event_us").assign(**out)

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame, key: str, ts: str, order: Sequence[str], columns: Sequence[str], step: Callable, past_schema: str, out_schema: str, delay: str,
) -> DataFrame:
    """(key, order..., columns..., and what ``step`` adds, of ``out_schema``) of a stream, in event-time order per key.

    Rows without a key belong to none and are left out, rows without a time are never passed by the watermark and
    dropped with the late ones. State of a key: the rows within ``delay``, and one ``past_schema``.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = dict(stream.dtypes)
    kept = list(dict.fromkeys([key, *order, *columns]))
    names = ["event_us", *kept]
    # the row that ends the input has no key; a condition on the key alone would be tested before the watermark sees the row
    belongs = F.col(key).isNotNull() | (F.col(ts) >= F.lit(END_OF_TIME).cast("timestamp"))
    rows = stream.withWatermark(ts, delay).where(belongs).select(F.unix_micros(ts).alias("event_us"), *kept, ts)
    schema = ", ".join(["event_us bigint", *[f"`{c}` {kinds[c]}" for c in kept]])
    given = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], out_schema])
    return rows.groupBy(key).transformWithStateInPandas(InOrder(schema, names, list(order), step, past_schema), given, "append", "EventTime")


def ordered_drift(
    stream: DataFrame, key: str, ts: str, order: Sequence[str], error: str, size: int = DRIFT_WINDOW, drift: float = DRIFT_LIMIT,
    warning: float = WARNING_LIMIT, delay: str = "10 minutes",
) -> DataFrame:
    """Per sample: ``drift_now``, the sticky ``drift`` flag and ``warning`` of its key, in event-time order."""

    def step(rows: pd.DataFrame, past: tuple | None):
        wrong, counted, recent, drifted = past or (0, 0, b"", False)
        state = (wrong, counted, np.frombuffer(bytes(recent), np.uint8), drifted)
        now, ever, warned, (wrong, counted, recent, drifted) = drift_steps(rows[error].to_numpy(np.int64), state, size, drift, warning)
        return {"drift_now": now, "drift": ever, "warning": warned}, (int(wrong), int(counted), recent.tobytes(), bool(drifted))

    return in_order(
        stream, key, ts, order, [error], step, "wrong bigint, counted bigint, recent binary, drifted boolean",
        "drift_now boolean, drift boolean, warning boolean", delay,
    )


def ordered_threshold(
    stream: DataFrame, key: str, ts: str, order: Sequence[str], score: str, size: int = SCORE_WINDOW, least: int = SCORE_LEAST,
    stds: float = SCORE_STDS, rate: float = ADAPT_RATE, delay: str = "10 minutes",
) -> DataFrame:
    """Per sample: the moving threshold of its key and whether the score exceeds it, in event-time order."""

    def step(rows: pd.DataFrame, past: tuple | None):
        recent, last = past or (b"", None)
        values = rows[score].to_numpy(float)
        limits, (recent, last) = threshold_steps(values, (np.frombuffer(bytes(recent)), last), size, least, stds, rate)
        found = pd.Series(limits).astype(object).where(~np.isnan(limits), None)
        return {"threshold": found, "anomaly": values > limits}, (np.asarray(recent, float).tobytes(), last)

    return in_order(stream, key, ts, order, [score], step, "recent binary, last double", "threshold double, anomaly boolean", delay)


def ordered_reuse(stream: DataFrame, key: str, ts: str, tie: str, seconds: float = REUSE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Per request: whether an earlier result of its key still serves it, and whose (``source_row``): ``reuse.sliding_reuse`` on a stream."""

    def step(rows: pd.DataFrame, past: tuple | None):
        begun, source = past or (None, None)
        at, ids, reused, served = rows["event_us"].to_numpy(), rows[tie].to_list(), [], []
        for t, row in zip(at.tolist(), ids):
            fresh = begun is None or t >= begun + seconds * 1_000_000
            if fresh:
                begun, source = t, row
            reused.append(not fresh)
            served.append(source)
        return {"reused": reused, "source_row": served}, (begun, source)

    kind = dict(stream.dtypes)[tie]
    return in_order(stream, key, ts, [tie], [], step, f"begun bigint, source {kind}", f"reused boolean, source_row {kind}", delay)


def run_to_end(spark: SparkSession, rows: DataFrame, work: Callable[[DataFrame], DataFrame], base: str, ts: str = "ts") -> tuple[DataFrame, int]:
    """(what ``work`` makes of a stream of ``rows`` to the end of the input, rows dropped as late).

    First all that is there is drained; then a row of NULLs at the end of time is added, and the same query goes on from
    its checkpoint. ``work`` must leave out or keep apart rows without a key.
    """
    end = f"{base}/end"
    spark.createDataFrame([], rows.schema).write.parquet(end)
    out = work(rows.unionByName(spark.readStream.schema(rows.schema).parquet(end)))
    late = run_to_files(out, f"{base}/out", f"{base}/checkpoint")
    last = [(F.lit(END_OF_TIME) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*last).write.mode("append").parquet(end)
    late += run_to_files(out, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out"), late
