"""Generic monitoring operators (E1-E21) and record-derived metrics
(E30-E40) as named queries over the derived telemetry inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.operators import promql as P
from pipework.operators import sketch as K
from pipework.operators import telemetry as M
from pipework.operators.history import queue_depth
from pipework.sources import fixtures as X

STEP_S = 60


def _rt(spark, d):
    return M.runtime_points(X.payloads(spark, d), X.QUEUE_SCHEMA_ID)


def enqueue_samples(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counter ``queue_enqueue_count_total{queue}``
    sampled at each minute end with traffic; the process restarts daily, so
    the counter resets at every day boundary."""
    per = P.step_counts(_rt(spark, d).where("enqueued"), STEP_S, ["queue"], name="n")
    # a sample stamped exactly at midnight closes the previous day's minute
    day = F.floor((T.epoch_us("ts") - 1) / F.lit(86_400 * 1_000_000)).cast("long")
    w = Window.partitionBy("queue", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return (per.withColumn("_day", day)
               .select("ts", "queue", F.sum("n").over(w).cast("double").alias("value")))


# E1 / E2 --------------------------------------------------------------------
def sel_eq(spark, d):
    a = P.select_eq(X.access_log(spark, d), method="GET", route="/v1/click")
    return a.select("request_id", "ts", "status", "latency_ms")


def sel_regex(spark, d):
    a = P.select_regex(X.access_log(spark, d), "status", "5..")
    return a.select("request_id", "ts", "status")


# E4 / E5 / E6 ---------------------------------------------------------------
def increase_10m(spark, d):
    inc = P.increase(enqueue_samples(spark, d), 600, ["queue"], name="increase")
    return inc.select("queue", "ts", F.round("increase", 6).alias("increase"))


def rate_1m(spark, d):
    r = P.rate(enqueue_samples(spark, d), 60, ["queue"], name="rate")
    return r.select("queue", "ts", F.round("rate", 6).alias("rate"))


def max_over_time(spark, d):
    g = queue_depth(X.work_log(spark, d))
    m = P.max_over_time(g, 600, None, value="depth", name="max_depth")
    return m.select("ts", "max_depth")


# E7 / E8 / E9 ---------------------------------------------------------------
def _queue_rates(spark, d):
    return P.window_rate(_rt(spark, d).where("enqueued"), STEP_S, ["queue"], name="value")


def sum_all(spark, d):
    s = P.sum_all(_queue_rates(spark, d))
    return s.select("ts", F.round("value", 6).alias("value"))


def sum_by(spark, d):
    r = P.window_rate(X.access_log(spark, d), STEP_S, ["method", "status"], name="value")
    s = P.sum_by(r, ["status"])
    return s.select("ts", "status", F.round("value", 6).alias("value"))


def max_all(spark, d):
    m = P.max_all(_queue_rates(spark, d))
    return m.select("ts", F.round("value", 6).alias("value"))


# E10 / E13 ------------------------------------------------------------------
def error_ratio(spark, d):
    both = P.window_rates(X.access_log(spark, d), STEP_S, {"err": P.matches("status", "5.."), "tot": F.lit(True)})
    r = both.where(F.col("err").isNotNull())   # matching samples only
    return r.select("ts", F.round(F.try_divide("err", "tot"), 6).alias("ratio"))


def vector_and(spark, d):
    both = P.window_rates(X.access_log(spark, d), STEP_S, {"err": P.matches("status", "5.."), "tot": F.lit(True)}, ["route"])
    r = both.where(F.col("err").isNotNull() & (F.col("tot") * STEP_S >= 2))
    return r.select("ts", "route", F.round("err", 6).alias("value"))


# E11 / E36 ------------------------------------------------------------------
def hist_p95(spark, d):
    rt = _rt(spark, d).where(F.col("dequeue_ts").isNotNull())
    c = P.bucket_counts(rt.withColumn("dwell_ms", F.col("dwell_ns") / F.lit(1e6)), "dwell_ms",
                        P.DEFAULT_MS_BOUNDS, ["queue"])
    q = P.histogram_quantile(c, 0.95, P.DEFAULT_MS_BOUNDS, ["queue"])
    return q.select("queue", F.round("value", 6).alias("p95_ms"))


def bucketize(spark, d):
    b = M.bucketize(X.access_log(spark, d), "latency_ms", P.DEFAULT_MS_BOUNDS, ["route"])
    return b.select("route", "le", "cum")


def p95_sketch(spark, d):
    """p95 latency without buckets by day and route: sketches by the minute, merged; each
    answer's rank is held against all observations, at twice the sketch's 99 % bound."""
    a = X.access_log(spark, d).withColumn("day", F.to_date("ts"))
    minutes = K.step_sketches(a, "latency_ms", STEP_S, ["day", "route"])
    p95 = K.quantile(K.merged(minutes, ["day", "route"]), 0.95)
    return K.rank_check(a, p95, "latency_ms", 0.95, ["day", "route"], 2 * K.rank_error())


# E14 / E16 / E19 / E20 ------------------------------------------------------
def alert_for(spark, d):
    """Generic ``for: 3m`` on 'queue received traffic this minute'."""
    busy = P.step_counts(_rt(spark, d).where("enqueued"), STEP_S, ["queue"], name="n")
    f = P.alert_for(busy, STEP_S, 180, ["queue"])
    return f.select("queue", "ts", "active_since", "state")


def last_not_null(spark, d):
    ln = P.last_not_null(_queue_rates(spark, d), ["queue"])
    return ln.select("queue", "ts", F.round("value", 6).alias("value"))


def threshold_state(spark, d):
    a = X.access_log(spark, d)
    per = a.groupBy(F.to_date("ts").alias("day"), "route").agg(F.count(F.lit(1)).alias("requests"))
    return per.select("day", "route", "requests", P.threshold_state("requests", 80).alias("state"))


def time_range(spark, d):
    r = P.time_range(X.access_log(spark, d), 6.0)
    return r.select("request_id", "ts", "status")


# E17 / E18 ------------------------------------------------------------------
def logs_recent(spark, d):
    return P.logs_recent(X.logs(spark, d), "src0").select("ts", "service", "severity", "message", "doc_id")


def traces_recent(spark, d):
    t = P.traces_recent(X.span_times(spark, d), "error")
    return t.withColumn("duration_ms", F.round("duration_ms", 3))


# E30-E35 --------------------------------------------------------------------
def m_enqueue(spark, d):
    return M.counter_by(_rt(spark, d), "enqueued", "queue", "enqueue")


def m_dequeue(spark, d):
    rt = _rt(spark, d).withColumn("dq", F.col("dequeue_ts").isNotNull())
    return M.counter_by(rt, "dq", "queue", "dequeue")


def m_dwell(spark, d):
    return M.duration_stats(_rt(spark, d), "ts", "dequeue_ts", "queue")


def m_process(spark, d):
    return M.counter_by(_rt(spark, d), "enqueued", "stage", "process")


def m_latency(spark, d):
    rt = _rt(spark, d).where("enqueued")
    return rt.groupBy("stage").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("latency_ns") / F.lit(1e6), 3).alias("sum_ms"),
                                   F.round(F.max("latency_ns") / F.lit(1e6), 3).alias("max_ms"))


def m_errors(spark, d):
    return M.counter_by(_rt(spark, d), "error", "stage", "errors")


# E37 / E38 / E39 / E40 ------------------------------------------------------
def m_reconcile(spark, d):
    r = X.reconcile_log(spark, d)
    return r.groupBy("flow_name").agg(F.count(F.when(F.col("ok"), 1)).alias("success"),
                                      F.count(F.when(~F.col("ok"), 1)).alias("failure"))


def m_http(spark, d):
    return M.http_metrics(X.access_log(spark, d))


def m_grpc(spark, d):
    return M.grpc_metrics(X.access_log(spark, d))


def span_status(spark, d):
    return M.span_status(X.access_log(spark, d))


def span_chain(spark, d):
    c = M.span_chain(X.payloads(spark, d))
    return c.select("trace_id", "span_id", "parent_span_id", "hop")


def trace_summary(spark, d):
    return M.trace_summary(X.spans(spark, d))


def m_drops(spark, d):
    """Planned metric: drops = schema rejects per queue and reason."""
    from pipework.operators import schema_gate as G
    rej = G.rejects(X.payloads(spark, d).withColumn("queue", F.col("event_type")), X.QUEUE_SCHEMA_ID,
                    stage_input=False)
    return M.drops(rej)


def m_queue_depth(spark, d):
    """Planned metric: per-queue depth = running enqueue − dequeue."""
    return M.queue_depth_by_queue(_rt(spark, d))


MONITORING = {
    "m_drops": m_drops, "m_queue_depth": m_queue_depth,
    "sel_eq": sel_eq, "sel_regex": sel_regex, "increase_10m": increase_10m, "rate_1m": rate_1m,
    "max_over_time": max_over_time, "sum_all": sum_all, "sum_by": sum_by, "max_all": max_all,
    "error_ratio": error_ratio, "vector_and": vector_and, "hist_p95": hist_p95, "p95_sketch": p95_sketch, "bucketize": bucketize,
    "alert_for": alert_for, "last_not_null": last_not_null, "threshold_state": threshold_state,
    "time_range": time_range, "logs_recent": logs_recent, "traces_recent": traces_recent,
    "m_enqueue": m_enqueue, "m_dequeue": m_dequeue, "m_dwell": m_dwell, "m_process": m_process,
    "m_latency": m_latency, "m_errors": m_errors, "m_reconcile": m_reconcile, "m_http": m_http,
    "m_grpc": m_grpc, "span_status": span_status, "span_chain": span_chain,
    "trace_summary": trace_summary,
}
