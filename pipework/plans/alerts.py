"""The six alert rules, evaluated on a one-minute grid.

Each rule: per-minute partial aggregates (map-side combined) → spread onto
the evaluation instants whose trailing window covers them (constant fan-out
window/step) → re-aggregate → condition → ``for:`` (gaps-and-islands).
Rows are the instants where the condition holds, with ``pending`` /
``firing`` state, like the ``ALERTS`` series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.operators import promql as P
from pipework.operators.history import queue_depth
from pipework.operators.telemetry import runtime_points
from pipework.sources import fixtures as X

STEP_S = 60
FOR_S = 600

# --- fixed values: rule thresholds (chart defaults) and labels -----------
API_ERROR_RATIO = 0.05
API_MIN_REQUESTS = 20
API_P95_MS = 500
CTL_FAILURES = 1
CTL_MAX_DEPTH = 100
RT_DWELL_P95_MS = 5000
RT_STAGE_ERRORS = 1
# (name, component, summary, description); summaries state the threshold
RULES = {
    "alert_api_errors": ("ApiHighErrorRate", "api", f'Flow API 5xx error rate above "{API_ERROR_RATIO}"',
                         "The Flow API is returning elevated 5xx responses over the last 10m."),
    "alert_api_latency": ("ApiHighLatency", "api", f"Flow API p95 latency above {API_P95_MS}ms",
                          "The Flow API 95th percentile latency is higher than expected."),
    "alert_reconcile_failures": ("ControllerReconcileFailures", "controller", "Flow controller reconcile failures detected",
                                 "Flow controller reconcile failures were observed in the last 10m."),
    "alert_queue_depth": ("ControllerQueueDepthHigh", "controller", f"Flow controller queue depth above {CTL_MAX_DEPTH}",
                          "The controller work queue depth is elevated."),
    "alert_dwell": ("RuntimeQueueDwellHigh", "runtime", f"Runtime queue dwell p95 above {RT_DWELL_P95_MS}ms",
                    "Runtime queues are taking longer than expected to process items."),
    "alert_stage_errors": ("RuntimeStageErrors", "runtime", "Runtime stage errors detected",
                           "Stage errors were detected in the last 10m."),
}
# -------------------------------------------------------------------------


def _finish(key: str, cond: DataFrame) -> DataFrame:
    name, component, summary, description = RULES[key]
    fired = P.alert_for(cond, STEP_S, FOR_S)
    return fired.select(F.lit(name).alias("alertname"), "ts",
                        F.round(F.col("value").cast("double"), 6).alias("value"), "active_since", "state",
                        F.lit("warning").alias("severity"), F.lit(component).alias("component"),
                        F.lit(summary).alias("summary"), F.lit(description).alias("description"))


def _windowed_sum(per_min: DataFrame, window_s: int, cols: list[str]) -> DataFrame:
    g = P.eval_grid(per_min, STEP_S, window_s)
    return g.groupBy("ts").agg(*[F.sum(c).alias(c) for c in cols])


def _windowed_quantile(df: DataFrame, value: str, bounds, window_s: int, q: float = 0.95) -> DataFrame:
    per = P.step_counts(df.withColumn("le", P.le_of(value, bounds)), STEP_S, ["le"], name="cnt")
    g = P.eval_grid(per, STEP_S, window_s).groupBy("ts", "le").agg(F.sum("cnt").alias("cnt"))
    return P.histogram_quantile(g, q, bounds, ["ts"], name="value")


def alert_api_errors(spark: SparkSession, d: str) -> DataFrame:
    """5xx ratio over 10m > 0.05 *and* ≥ 20 requests over 10m. Both sides of
    the ``and`` are the same evaluation instants, so the semi-join collapses
    into one filter over one aggregate."""
    a = X.access_log(spark, d)
    is5xx = P.anchored("5..")
    per = (a.groupBy(P.T.bucket_index("ts", STEP_S).alias("_b"))
            .agg(F.count(F.lit(1)).alias("tot"),
                 F.count(F.when(F.col("status").cast("string").rlike(is5xx), 1)).alias("err"))
            .select(P.T.index_to_ts(F.col("_b") + 1, STEP_S).alias("ts"), "tot", "err"))
    w = _windowed_sum(per, 600, ["err", "tot"])
    ratio = w.withColumn("value", F.try_divide(F.col("err"), F.col("tot")))
    cond = ratio.where((F.col("value") > API_ERROR_RATIO) & (F.col("tot") >= API_MIN_REQUESTS))
    return _finish("alert_api_errors", cond)


def alert_api_latency(spark: SparkSession, d: str) -> DataFrame:
    q = _windowed_quantile(X.access_log(spark, d), "latency_ms", P.DEFAULT_MS_BOUNDS, 300)
    return _finish("alert_api_latency", q.where(F.col("value") > API_P95_MS))


def alert_reconcile_failures(spark: SparkSession, d: str) -> DataFrame:
    per = P.step_counts(X.reconcile_log(spark, d).where(~F.col("ok")), STEP_S, name="value")
    w = _windowed_sum(per, 600, ["value"])
    return _finish("alert_reconcile_failures", w.where(F.col("value") >= CTL_FAILURES))


def alert_queue_depth(spark: SparkSession, d: str) -> DataFrame:
    g = queue_depth(X.work_log(spark, d))
    w = P.eval_grid(g, STEP_S, 600).groupBy("ts").agg(F.max("depth").alias("value"))
    return _finish("alert_queue_depth", w.where(F.col("value") > CTL_MAX_DEPTH))


def alert_dwell(spark: SparkSession, d: str) -> DataFrame:
    rt = runtime_points(X.payloads(spark, d), X.QUEUE_SCHEMA_ID)
    deq = rt.where(F.col("dequeue_ts").isNotNull()).select(F.col("dequeue_ts").alias("ts"), "dwell_ns")
    q = _windowed_quantile(deq, "dwell_ns", P.ns_bounds(), 300)
    q = q.withColumn("value", F.col("value") / F.lit(1e6))
    return _finish("alert_dwell", q.where(F.col("value") > RT_DWELL_P95_MS))


def alert_stage_errors(spark: SparkSession, d: str) -> DataFrame:
    rt = runtime_points(X.payloads(spark, d), X.QUEUE_SCHEMA_ID).where("error")
    w = _windowed_sum(P.step_counts(rt, STEP_S, name="value"), 600, ["value"])
    return _finish("alert_stage_errors", w.where(F.col("value") >= RT_STAGE_ERRORS))


ALERTS = {
    "alert_api_errors": alert_api_errors, "alert_api_latency": alert_api_latency,
    "alert_reconcile_failures": alert_reconcile_failures, "alert_queue_depth": alert_queue_depth,
    "alert_dwell": alert_dwell, "alert_stage_errors": alert_stage_errors,
}
