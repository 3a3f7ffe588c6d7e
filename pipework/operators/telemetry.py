"""Telemetry derived from records.

Row accounting follows the runner rules (behaviour 6):

=========================  =======  =======  =====  =======
outcome                    dequeue  process  error  enqueue
=========================  =======  =======  =====  =======
source ok / stamped        –        1        –      1
source schema mismatch     –        0        1      0
transform input rejected   1        0        1      0
transform ok               1        1        –      1
transform output mismatch  1        1        1      0
sink input rejected        1        0        1      –
sink consumed              1        1        –      –
=========================  =======  =======  =====  =======
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.operators import schema_gate as G
from pipework.operators.history import gauge
from pipework.operators.promql import bucket_counts, cumulative_buckets
from pipework.operators.scan import hour_chunk, ordered_scan

ZERO_TRACE = "0" * 32


def counters(kind: str, in_schema: str | None = None, out_schema: str | None = None,
             col: str = "schema_id") -> dict[str, Column]:
    """Per-row counters of one stage (table above) as 0/1 long columns."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    in_ok = G.input_ok(in_schema, col)
    out_ok = G.output_ok(out_schema, col)
    if kind == "source":
        return {"dequeue": none, "process": F.when(out_ok, one).otherwise(zero),
                "error": F.when(out_ok, zero).otherwise(one), "enqueue": F.when(out_ok, one).otherwise(zero)}
    if kind == "transform":
        return {"dequeue": one, "process": F.when(in_ok, one).otherwise(zero),
                "error": F.when(in_ok & out_ok, zero).otherwise(one), "enqueue": F.when(in_ok & out_ok, one).otherwise(zero)}
    if kind == "sink":
        return {"dequeue": one, "process": F.when(in_ok, one).otherwise(zero),
                "error": F.when(in_ok, zero).otherwise(one), "enqueue": none}
    raise ValueError(f"unknown stage kind {kind!r}")


def account(df: DataFrame, kind: str, in_schema: str | None = None,
            out_schema: str | None = None, col: str = "schema_id") -> DataFrame:
    """The rows with their :func:`counters`."""
    return df.select("*", *[c.alias(n) for n, c in counters(kind, in_schema, out_schema, col).items()])


def runtime_points(payloads: DataFrame, queue_schema: str | None) -> DataFrame:
    """Observations of the canonical runtime flow over the envelope: each
    payload is produced by a source into queue ``<event_type>`` (schema
    ``queue_schema``) and consumed by stage type ``<event_type>``; it waits
    ``value`` ms in the queue and takes ``value`` ms to process."""
    ok = G.output_ok(queue_schema)
    return payloads.select(
        "ts", "event_id",
        F.col("event_type").alias("queue"),
        F.col("event_type").alias("stage"),
        ok.alias("enqueued"),
        (~ok).alias("error"),
        F.when(ok, T.add_ms("ts", F.col("value"))).alias("dequeue_ts"),
        (F.col("value") * F.lit(1e6)).alias("dwell_ns"),
        (F.col("value") * F.lit(1e6)).alias("latency_ns"),
    )


# E30 / E31 / E33 / E35 ---------------------------------------------------
def counter_by(df: DataFrame, flag: str, by: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.when(F.col(flag), 1)).alias(name))


# E32 / E34 ---------------------------------------------------------------
def duration_stats(df: DataFrame, start: str, end: str, by: str) -> DataFrame:
    """Per-group ns duration stats; zero/unknown starts are not recorded."""
    d = (T.epoch_us(end) - T.epoch_us(start)) * F.lit(1000)
    x = df.select(by, d.alias("_ns")).where(F.col("_ns") > 0)
    return x.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("_ns") / F.lit(1e6), 3).alias("sum_ms"),
        F.round(F.max("_ns") / F.lit(1e6), 3).alias("max_ms"))


# E36 ---------------------------------------------------------------------
def bucketize(df: DataFrame, value: str, bounds: Sequence[float], by=None) -> DataFrame:
    """Cumulative ``le`` counts per group (present buckets + ``+Inf``)."""
    return cumulative_buckets(bucket_counts(df, value, bounds, by), by)


# E38 ---------------------------------------------------------------------
def http_metrics(access: DataFrame) -> DataFrame:
    """Request count and integer-ms latency by method / route / status."""
    return access.groupBy("method", "route", "status").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.floor("latency_ms")).cast("long").alias("latency_ms_sum"))


def grpc_metrics(access: DataFrame) -> DataFrame:
    err = F.col("status") >= 500
    return access.groupBy("rpc_method").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(err, 1)).alias("errors"),
        F.sum(F.floor("latency_ms")).cast("long").alias("latency_ms_sum"))


# E39 ---------------------------------------------------------------------
def span_status(access: DataFrame) -> DataFrame:
    """HTTP spans are errors at status ≥ 500; gRPC spans when err ≠ nil."""
    return access.select(
        "request_id",
        F.when(F.col("status") >= 500, F.lit("error")).otherwise(F.lit("unset")).alias("http_span_status"),
        F.when(F.col("status") >= 500, F.lit("error")).otherwise(F.lit("ok")).alias("grpc_span_status"))


# E40 ---------------------------------------------------------------------
def span_chain(payloads: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Each hop's span is a child of the span carried by the payload and then
    replaces it. An all-zero trace id means no valid context: parent null."""
    valid = F.col("trace_id") != F.lit(ZERO_TRACE)
    x = ordered_scan(payloads.select("trace_id", "span_id", *order), ["trace_id"], list(order),
                     hour_chunk(order[0]), sums={"_hop": F.lit(1)}, prevs={"_parent": F.col("span_id")})
    return x.select("trace_id", "span_id", *order,
                    F.when(valid, F.col("_parent")).alias("parent_span_id"),
                    F.when(valid, F.col("_hop").cast("long")).alias("hop"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace: span count, start, end, duration and error spans."""
    dur = (T.epoch_us(F.max("end_ts")) - T.epoch_us(F.min("start_ts"))) / F.lit(1000.0)
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.round(dur, 3).alias("duration_ms"),
        F.count(F.when(F.col("status") == "error", 1)).alias("error_spans"),
        F.count(F.when(F.col("parent_span_id").isNull(), 1)).alias("roots"))


# planned metrics (drops, depth) ----------------------------------------------
def drops(rejected: DataFrame, by=("queue", "reason")) -> DataFrame:
    """Dropped rows per queue and reason (the quarantine's size)."""
    return rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("dropped"))


def queue_depth_by_queue(points: DataFrame, step_s: int = 60) -> DataFrame:
    """Per-queue depth at each step end = enqueued − dequeued so far. Both
    sides are counted per (queue, step) first; the depth is a :func:`gauge`, so
    it holds in steps without traffic."""
    enq = points.where("enqueued").select("queue", T.bucket_index("ts", step_s).alias("_b"),
                                          F.lit(1).cast("long").alias("_d"))
    deq = points.where(F.col("dequeue_ts").isNotNull()).select(
        "queue", T.bucket_index("dequeue_ts", step_s).alias("_b"), F.lit(-1).cast("long").alias("_d"))
    per = enq.unionByName(deq).groupBy("queue", "_b").agg(F.sum("_d").alias("_d"))
    return gauge(per, step_s, "depth", ("queue",))
