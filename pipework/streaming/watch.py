"""D9 on a stream: change events with the spec of the pointer's version, from keyed state.

Rows of a change log may come in any order within the watermark. Each flow holds
its rows until the watermark passes them and only then applies them in order,
so events are those of the batch :func:`~pipework.operators.history.watch_events`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pipework.operators.history import key_name, pointer_version, version_specs

#: Stateful processors keep maps and timers, which the default state store can't.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Timers stand on whole steps (ms): a flow has one for each step that it has rows in.
STEP_MS = 60_000
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
OUT = "us bigint, rev bigint, key string, flow string, event_type string, version string, spec string"


class WatchEvents(StatefulProcessor):
    """State of one flow: the specs of its versions, which pointer keys are live,
    and the rows that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.specs = handle.getMapState("specs", "version string", "spec string")
        self.live = handle.getMapState("live", "key string", "live boolean")
        # at one revision, specs change before pointers
        self.pending = handle.getMapState("pending", "us bigint, rev bigint, pointer boolean, key string", "op string, value string, version string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timers = set()
        for r in rows:
            self.pending.updateValue((r.us, r.rev, r.pointer, r.key), (r.op, r.value, r.version))
            timers.add(-(-r.us // (1000 * STEP_MS)) * STEP_MS)
        for t in timers:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        for at in sorted(tuple(k) for k in self.pending.keys() if k[0] <= upto):
            op, value, version = self.pending.getValue(at)
            self.pending.removeKey(at)
            us, rev, pointer, path = at
            if pointer:
                event = self._pointed(path, op)
                if event and (event == "DELETED" or version is not None):
                    spec = self.specs.getValue((version,)) if event != "DELETED" else None
                    yield Row(us=us, rev=rev, key=path, flow=key[0], event_type=event, version=None if event == "DELETED" else version,
                              spec=spec[0] if spec else None)
            elif op == "put":
                self.specs.updateValue((version,), (value,))
            else:
                self.specs.removeKey((version,))

    def _pointed(self, path: str, op: str) -> str | None:
        was = self.live.containsKey((path,))
        if op == "put":
            if not was:
                self.live.updateValue((path,), (True,))
            return "UPDATED" if was else "ADDED"
        if was:
            self.live.removeKey((path,))
            return "DELETED"
        return None

    def close(self) -> None:
        pass


def watch_events_stream(kv: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Streaming D9 over a key-value change stream (ts, rev, key, op, value): the
    events of the batch operator, each given out once the watermark has passed
    it. Rows later than ``watermark`` are dropped. The session needs
    :data:`STATE_STORE` when the query starts."""
    act = kv.where(F.col("key").endswith("/active")).select(
        "ts", "rev", "key", "op", "value", key_name("key").alias("name"),
        F.when(F.col("op") == "put", pointer_version("value")).alias("version"), F.lit(True).alias("pointer"))
    specs = version_specs(kv).select("ts", "rev", "key", "op", "value", "name", "version", F.lit(False).alias("pointer"))
    rows = act.unionByName(specs).withColumn("us", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)")).drop("ts")
    rows = rows.withColumn("event_ts", F.timestamp_micros("us")).withWatermark("event_ts", watermark)
    out = rows.groupBy("name").transformWithState(WatchEvents(), OUT, "append", "eventTime")
    return out.select(F.expr(f"timestampadd(MICROSECOND, us, {EPOCH})").alias("ts"), "rev", "key", "flow", "event_type",
                      F.col("version").try_cast("long").alias("version"), "spec")
