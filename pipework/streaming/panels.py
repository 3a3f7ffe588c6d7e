"""p95 panels and alert rules that refresh as data comes (E11, E14 and E20's refresh).

Both are the batch operators on a stream: chained event-time aggregations count
observations by bucket and step, sum the steps of each trailing window and
interpolate; an alert keeps per series since when its condition has held. A row is
given out once the watermark has passed it, and never changed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pipework.operators import promql as P

ET = "_event_ts"


def stream_quantile(df: DataFrame, value: str, q: float, bounds: Sequence[float], step_s: int,
                    window_s: int | None = None, by: Sequence[str] = (), ts: str = "ts",
                    watermark: str = "10 minutes", scale: float = 1.0, name: str = "value") -> DataFrame:
    """``histogram_quantile(q, sum by (le, by…)(rate(h_bucket[window])))`` every
    ``step_s``, by default over windows of one step → (ts, by…, value), ``ts``
    being the window's end. Also returns ``event_ts``, ``ts`` under the watermark.

    The first aggregation holds a count per step, series and bucket; the second holds
    those of a window: window/step times the number of bounds at most, whatever the
    number of observations."""
    window_s = window_s or step_s
    if window_s % step_s:
        raise ValueError(f"window {window_s}s must be a multiple of the step {step_s}s")
    keys = list(by)
    seen = (df.where(F.col(value).isNotNull()).withColumn(ET, F.col(ts).cast("timestamp")).withWatermark(ET, watermark)
              .withColumn("le", P.le_of(value, bounds)))
    steps = seen.groupBy(F.window(ET, f"{int(step_s)} seconds").alias("step"), *keys, "le").agg(F.count(F.lit(1)).alias("n"))
    trailing = F.window(F.window_time("step"), f"{int(window_s)} seconds", f"{int(step_s)} seconds")
    parts = steps.groupBy(trailing.alias("w"), *keys).agg(F.collect_list(F.struct("le", "n")).alias("_buckets"))
    v = P.bucket_quantile(F.col("_buckets"), q, bounds)
    # the window's own time, a microsecond before its end, carries the watermark on
    return parts.select(F.col("w.end").cast("timestamp_ntz").alias("ts"), *keys, (v / F.lit(float(scale))).alias(name),
                        F.window_time("w").alias("event_ts"))


class AlertState(StatefulProcessor):
    """State of one series: the instants that the watermark has not passed, and
    the last instant and begin of the island it is in."""

    def __init__(self, step_us: int, for_us: int, keys: list[str]):
        self.step_us, self.for_us, self.keys = step_us, for_us, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "us bigint", "value double")
        self.island = handle.getValueState("island", "since bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.pending.updateValue((r.us,), (r.value,))
            self.handle.registerTimer(r.us // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        for us in sorted(k[0] for k in self.pending.keys() if k[0] <= passed):
            (value,) = self.pending.getValue((us,))
            self.pending.removeKey((us,))
            held = self.island.get() if self.island.exists() else None
            since = held[0] if held and us - held[1] <= self.step_us else us
            self.island.update((since, us))
            # the island is forgotten when no instant has followed within a step
            self.handle.registerTimer((us + 2 * self.step_us) // 1000)
            yield Row(**dict(zip(self.keys, key)), us=us, value=value, since=since,
                      state="firing" if us - since >= self.for_us else "pending")
        held = self.island.get() if self.island.exists() else None
        if held and held[1] + self.step_us <= passed - self.step_us and not any(True for _ in self.pending.keys()):
            self.island.clear()

    def close(self) -> None:
        pass


def stream_alert(df: DataFrame, condition: Column, step_s: int, for_s: int, by: Sequence[str] = (),
                 value: str = "value") -> DataFrame:
    """E14 on the output of :func:`stream_quantile` (or any stream with ``ts`` on the
    grid and ``event_ts`` under a watermark): the instants where ``condition``
    holds, ``pending`` until held for ``for_s``, then ``firing`` → (ts, by…, value,
    active_since, state). Equals :func:`~pipework.operators.promql.alert_for`. A key
    column is returned as text. The session needs
    :data:`~pipework.streaming.watch.STATE_STORE` when the query starts."""
    keys = list(by)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = df.where(condition).select(*[F.col(k).cast("string").alias(k) for k in keys] or [F.lit("").alias("_all")],
                                      at.alias("us"), F.col(value).cast("double").alias("value"), "event_ts")
    group = keys or ["_all"]
    out = StructType([StructField(k, StringType()) for k in group]
                     + [StructField("us", LongType())]
                     + StructType.fromDDL("value double").fields
                     + [StructField("since", LongType()), StructField("state", StringType())])
    states = rows.groupBy(*group).transformWithState(
        AlertState(int(step_s) * 1_000_000, int(for_s) * 1_000_000, group), out, "append", "eventTime")
    ntz = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return states.select(ntz("us").alias("ts"), *keys, "value", ntz("since").alias("active_since"), "state")


__all__ = ["stream_quantile", "stream_alert"]
