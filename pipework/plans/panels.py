"""The 30 dashboard panels as DataFrame compositions of the E-operators.

Rate panels = select → rate over ``$__rate_interval`` (default 60 s) → sum by;
p95 panels = the same with ``le`` → histogram_quantile (÷1e6 for ns);
overview stat panels reduce the series with lastNotNull. Every panel adds
its threshold state (E19) and legend (E21). Every panel takes a range in hours
(E20): its instants are then those after ``now`` less the range, ``now`` being
the newest row of its whole source (selected or not), and rows that can't reach them aren't read on.
Without a range a panel runs over the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.operators import promql as P
from pipework.operators.telemetry import runtime_points
from pipework.operators.history import coalesced_lag, watch_events, queue_depth
from pipework.sources import fixtures as X

RATE_INTERVAL_S = 60   # $__rate_interval default
ROUND = 6


def since(df: DataFrame, hours: float, ts: str = "ts"):
    """``now`` less the range as one scalar subquery (a tiny aggregate)."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600).cast("decimal(18,6)"))
    return df.select((F.max(ts) - back).alias("lo")).scalar()


def _within(df: DataFrame, hours: float | None, of: DataFrame, ts: str = "ts", lead_s: int = 0) -> DataFrame:
    """The rows after the range's start, ``now`` being the newest of ``of``; ``lead_s``
    keeps what the window of the first instant reaches back to."""
    return df if hours is None else df.where(F.col(ts) > since(of, hours + lead_s / 3600.0, ts))


def _finish(df: DataFrame, labels: list[str], threshold: float, value: str = "value") -> DataFrame:
    v = F.round(F.col(value), ROUND)
    cols = ["ts", *labels, v.alias("value")]
    if labels:
        cols.append(P.legend(*labels).alias("legend"))
    cols.append(P.threshold_state(v, threshold).alias("state"))
    return df.select(*cols)


def _rate(df: DataFrame, labels, hours: float | None, of: DataFrame) -> DataFrame:
    r = P.window_rate(_within(df, hours, of, lead_s=RATE_INTERVAL_S), RATE_INTERVAL_S, labels, name="value")
    return _within(r, hours, of)


def _quantile(df: DataFrame, value: str, bounds, labels, hours: float | None, of: DataFrame, scale: float = 1.0) -> DataFrame:
    q = P.window_quantile(_within(df, hours, of, lead_s=RATE_INTERVAL_S), value, 0.95, bounds, RATE_INTERVAL_S, labels,
                          scale=scale, name="value")
    return _within(q, hours, of)


def _rate_panel(df: DataFrame, labels: list[str], threshold: float, hours: float | None, of: DataFrame) -> DataFrame:
    return _finish(_rate(df, labels, hours, of), labels, threshold)


def _p95_panel(df: DataFrame, value: str, bounds, labels: list[str], threshold: float,
               hours: float | None, of: DataFrame, scale: float = 1.0) -> DataFrame:
    return _finish(_quantile(df, value, bounds, labels, hours, of, scale), labels, threshold)


def _stat(df: DataFrame, threshold: float, hours: float | None, of: DataFrame) -> DataFrame:
    """Overview stat panel: sum(rate) series reduced by lastNotNull."""
    s = P.sum_all(_rate(df, None, hours, of), value="value", name="value")
    last = P.last_not_null(s, None, value="value", name="value")
    return _finish(last, [], threshold)


# ---- runtime dashboard ---------------------------------------------------
def _rt(spark, d):
    return runtime_points(X.payloads(spark, d), X.QUEUE_SCHEMA_ID)


def rt_enqueue(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(_rt(spark, d).where("enqueued"), ["queue"], 80, hours, _rt(spark, d))


def rt_dequeue(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    deq = _rt(spark, d).where(F.col("dequeue_ts").isNotNull()).select(F.col("dequeue_ts").alias("ts"), "queue")
    return _rate_panel(deq, ["queue"], 80, hours, _rt(spark, d))


def rt_dwell_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    deq = _rt(spark, d).where(F.col("dequeue_ts").isNotNull()) \
                       .select(F.col("dequeue_ts").alias("ts"), "queue", "dwell_ns")
    return _p95_panel(deq, "dwell_ns", P.ns_bounds(), ["queue"], 500, hours, _rt(spark, d), scale=1e6)


def rt_stage_rate(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(_rt(spark, d).where("enqueued"), ["stage"], 80, hours, _rt(spark, d))


def rt_stage_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _p95_panel(_rt(spark, d).where("enqueued"), "latency_ns", P.ns_bounds(), ["stage"], 500, hours, _rt(spark, d), scale=1e6)


def rt_stage_errors(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(_rt(spark, d).where("error"), ["stage"], 5, hours, _rt(spark, d))


# ---- API dashboard -------------------------------------------------------
def api_http_rate(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(X.access_log(spark, d), ["method", "route", "status"], 80, hours, X.access_log(spark, d))


def api_http_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _p95_panel(X.access_log(spark, d), "latency_ms", P.DEFAULT_MS_BOUNDS, ["method", "route"], 500, hours, X.access_log(spark, d))


def api_grpc_rate(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(X.access_log(spark, d), ["rpc_method"], 80, hours, X.access_log(spark, d))


def api_grpc_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _p95_panel(X.access_log(spark, d), "latency_ms", P.DEFAULT_MS_BOUNDS, ["rpc_method"], 500, hours, X.access_log(spark, d))


# ---- controller dashboard ------------------------------------------------
def ctl_reconcile_ok(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(X.reconcile_log(spark, d).where("ok"), ["flow_name"], 5, hours, X.reconcile_log(spark, d))


def ctl_reconcile_fail(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _rate_panel(X.reconcile_log(spark, d).where(~F.col("ok")), ["flow_name"], 1, hours, X.reconcile_log(spark, d))


def ctl_watch_rate(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    ev = watch_events(X.kv_log(spark, d))
    return _rate_panel(ev, ["event_type"], 10, hours, X.kv_log(spark, d))


def ctl_queue_depth(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    g = queue_depth(X.work_log(spark, d)).withColumnRenamed("depth", "value")
    return _finish(_within(g, hours, X.work_log(spark, d)), [], 50)


def ctl_queue_lag_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    lag = coalesced_lag(X.work_log(spark, d))
    flows = lag.select("ts", F.concat(F.lit("flow_"), (F.col("key") % X.N_FLOWS).cast("string")).alias("flow_name"),
                       "lag_s")
    return _p95_panel(flows, "lag_s", P.DEFAULT_SECONDS_BOUNDS, ["flow_name"], 5, hours, X.work_log(spark, d))


# ---- overview dashboard --------------------------------------------------
def ovw_http_rate(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _stat(X.access_log(spark, d), 1, hours, X.access_log(spark, d))


def ovw_http_5xx(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    a = P.select_regex(X.access_log(spark, d), "status", "5..")
    return _stat(a, 1, hours, X.access_log(spark, d))


def ovw_http_p95(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    q = _quantile(X.access_log(spark, d), "latency_ms", P.DEFAULT_MS_BOUNDS, None, hours, X.access_log(spark, d))
    return _finish(P.last_not_null(q, None), [], 500)


def ovw_enqueue(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _stat(_rt(spark, d).where("enqueued"), 80, hours, _rt(spark, d))


def ovw_dequeue(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    deq = _rt(spark, d).where(F.col("dequeue_ts").isNotNull()).select(F.col("dequeue_ts").alias("ts"))
    return _stat(deq, 80, hours, _rt(spark, d))


def ovw_stage_errors(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _stat(_rt(spark, d).where("error"), 1, hours, _rt(spark, d))


def ovw_reconcile_ok(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _stat(X.reconcile_log(spark, d).where("ok"), 80, hours, X.reconcile_log(spark, d))


def ovw_reconcile_fail(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    return _stat(X.reconcile_log(spark, d).where(~F.col("ok")), 1, hours, X.reconcile_log(spark, d))


def ovw_queue_depth(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
    g = queue_depth(X.work_log(spark, d))
    m = P.max_all(_within(g, hours, X.work_log(spark, d)), value="depth", name="value")
    return _finish(P.last_not_null(m, None), [], 10)


# ---- logs and traces -----------------------------------------------------
# fixed values: the dashboard's $service selection per panel family
LOG_SERVICE = {"api": "src1", "ctl": "src2", "rt": "src3"}
TRACE_SERVICE = {"api": "click", "ctl": "view", "rt": "purchase"}


def _logs(kind):
    def q(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
        logs = X.logs(spark, d)
        return P.logs_recent(_within(logs, hours, logs), LOG_SERVICE[kind]) \
                .select("ts", "service", "severity", "message", "doc_id")
    return q


# fixed values: the API and controller trace panels state a limit, the runtime one doesn't
TRACE_LIMIT = {"api": 20, "ctl": 20, "rt": None}


def _traces(kind):
    def q(spark: SparkSession, d: str, hours: float | None = None) -> DataFrame:
        spans = X.span_times(spark, d)
        t = P.traces_recent(spans, TRACE_SERVICE[kind], None if hours is not None else TRACE_LIMIT[kind])
        if hours is not None:   # a trace belongs to the range by its start
            t = _within(t, hours, spans, "start_ts")
            t = t.orderBy(F.desc("start_ts"), F.desc("trace_id"))
            t = t.limit(TRACE_LIMIT[kind]) if TRACE_LIMIT[kind] else t
        return t.withColumn("duration_ms", F.round("duration_ms", 3))
    return q


api_logs, ctl_logs, rt_logs = _logs("api"), _logs("ctl"), _logs("rt")
api_traces, ctl_traces, rt_traces = _traces("api"), _traces("ctl"), _traces("rt")

PANELS = {
    "api_http_rate": api_http_rate, "api_http_p95": api_http_p95,
    "api_grpc_rate": api_grpc_rate, "api_grpc_p95": api_grpc_p95,
    "api_logs": api_logs, "api_traces": api_traces,
    "ctl_reconcile_ok": ctl_reconcile_ok, "ctl_reconcile_fail": ctl_reconcile_fail,
    "ctl_watch_rate": ctl_watch_rate, "ctl_queue_depth": ctl_queue_depth,
    "ctl_queue_lag_p95": ctl_queue_lag_p95, "ctl_logs": ctl_logs, "ctl_traces": ctl_traces,
    "ovw_http_rate": ovw_http_rate, "ovw_http_5xx": ovw_http_5xx, "ovw_http_p95": ovw_http_p95,
    "ovw_enqueue": ovw_enqueue, "ovw_dequeue": ovw_dequeue, "ovw_stage_errors": ovw_stage_errors,
    "ovw_reconcile_ok": ovw_reconcile_ok, "ovw_reconcile_fail": ovw_reconcile_fail,
    "ovw_queue_depth": ovw_queue_depth,
    "rt_enqueue": rt_enqueue, "rt_dequeue": rt_dequeue, "rt_dwell_p95": rt_dwell_p95,
    "rt_stage_rate": rt_stage_rate, "rt_stage_p95": rt_stage_p95, "rt_stage_errors": rt_stage_errors,
    "rt_logs": rt_logs, "rt_traces": rt_traces,
}


def _last_six_hours(panel):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return panel(spark, d, 6.0)
    return q


RANGED = {f"{k}_6h": _last_six_hours(PANELS[k]) for k in ("rt_dwell_p95", "api_http_rate", "ovw_http_5xx", "ctl_queue_depth")}
