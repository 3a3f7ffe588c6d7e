"""Monitoring operators as DataFrame functions.

Semantics (documented choices):

* Counters are cumulative ``samples``; ``increase`` over ``w`` at sample time
  ``t`` is the sum of every per-sample growth Δ whose *later* sample lies in
  ``(t-w, t]``. Δ = v - prev, or v when the counter went down (reset); the
  first sample of a series contributes 0. No edge extrapolation.
* Event-level rates use epoch-aligned buckets ``[t-step, t)``; a row is stamped
  with the bucket *end* ``t``. Buckets without observations emit no row.
* Histograms are cumulative on ``le`` with a mandatory ``+Inf`` bucket.
  ``histogram_quantile`` interpolates linearly inside the bucket; the lower
  edge of the first bucket is 0, the ``+Inf`` bucket answers with the highest
  finite bound. Zero buckets never have to be materialised: the lower edge
  comes from the declared bound list.

All heavy work is shuffle-by-series aggregation or a window partitioned by
series; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.operators.scan import ordered_scan

INF = float("inf")

# --- fixed values: histogram bucket bounds -------------------------------
# OpenTelemetry SDK default explicit bucket boundaries (milliseconds).
DEFAULT_MS_BOUNDS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0,
                     750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)
# Prometheus client default buckets (seconds).
DEFAULT_SECONDS_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0,
                          2.5, 5.0, 10.0)
# -------------------------------------------------------------------------


def ns_bounds(ms_bounds: Sequence[float] = DEFAULT_MS_BOUNDS) -> tuple:
    """Nanosecond bounds for a ns histogram declared in ms."""
    return tuple(b * 1e6 for b in ms_bounds)


def _cols(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


# E1 ---------------------------------------------------------------------
def select_eq(df: DataFrame, **labels) -> DataFrame:
    """Label equality selector ``{k="v", ...}``."""
    cond = F.lit(True)
    for k, v in labels.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


# E2 ---------------------------------------------------------------------
def anchored(pattern: str) -> str:
    """PromQL regex matchers are fully anchored."""
    return f"^(?:{pattern})$"


def matches(label: str, pattern: str) -> Column:
    return F.col(label).cast("string").rlike(anchored(pattern))


def select_regex(df: DataFrame, label: str, pattern: str, negate: bool = False) -> DataFrame:
    m = matches(label, pattern)
    return df.where(~m if negate else m)


# E36 --------------------------------------------------------------------
def le_of(value, bounds: Sequence[float]) -> Column:
    """Upper bound of the bucket holding ``value`` (``+Inf`` overflow).
    A CASE chain: stays in codegen, no join with the bound list."""
    v = F.col(value) if isinstance(value, str) else value
    expr = F.when(v.isNull(), F.lit(None).cast("double"))   # no observation, no bucket
    for b in sorted(bounds):
        expr = expr.when(v <= F.lit(float(b)), F.lit(float(b)))
    return expr.otherwise(F.lit(INF))


def lower_edge(le: Column, bounds: Sequence[float]) -> Column:
    """Lower edge of the bucket whose upper bound is ``le`` (0 for the first)."""
    bs = sorted(float(b) for b in bounds)
    expr = F.when(le == F.lit(bs[0]), F.lit(0.0))
    for prev, cur in zip(bs, bs[1:]):
        expr = expr.when(le == F.lit(cur), F.lit(prev))
    return expr.otherwise(F.lit(bs[-1]))


def bucket_counts(df: DataFrame, value: str, bounds: Sequence[float], by=None,
                  count_name: str = "cnt") -> DataFrame:
    """Non-cumulative per-bucket observation counts (present buckets only).
    Partial aggregation happens map-side, so the shuffle carries
    ``groups × buckets`` rows, not raw observations."""
    return (df.where(F.col(value).isNotNull()).withColumn("le", le_of(value, bounds))
              .groupBy(*_cols(by), "le")
              .agg(F.count(F.lit(1)).alias(count_name)))


def cumulative_buckets(counts: DataFrame, by=None, count: str = "cnt") -> DataFrame:
    """Prometheus-style cumulative ``le`` series: one row per present bucket
    plus the mandatory ``+Inf`` row (= total). One aggregation per group; the
    per-group bucket list is bounded by the number of declared bounds."""
    keys = _cols(by)
    g = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", F.col(count).alias("n")))).alias("_b"))
    finite = F.filter("_b", lambda x: x["le"] != F.lit(INF))
    cum = F.transform(finite, lambda x, i: F.struct(
        x["le"].alias("le"),
        F.aggregate(F.slice(finite, 1, i + 1), F.lit(0).cast("long"), lambda acc, y: acc + y["n"]).alias("cum")))
    total = F.struct(F.lit(INF).alias("le"),
                     F.aggregate("_b", F.lit(0).cast("long"), lambda acc, y: acc + y["n"]).alias("cum"))
    return (g.select(*keys, F.explode(F.concat(cum, F.array(total))).alias("_r"))
             .select(*keys, "_r.le", F.col("_r.cum").cast("long").alias("cum")))


# E11 --------------------------------------------------------------------
def histogram_quantile(counts: DataFrame, q: float, bounds: Sequence[float], by=None,
                       count: str = "cnt", name: str = "value") -> DataFrame:
    """``histogram_quantile(q, sum by (le, by…) (…))`` over per-bucket counts
    (non-cumulative ``(by…, le, count)`` rows). Groups with no observations
    emit no row."""
    if not (0.0 <= q <= 1.0) or math.isnan(q):
        raise ValueError(f"quantile must lie in [0, 1], got {q}")
    keys = _cols(by)
    part = Window.partitionBy(*keys)
    cum_w = part.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.where(F.col(count) > 0)
                    .select(*keys, "le", F.col(count).cast("double").alias("_n"),
                            F.sum(count).over(cum_w).cast("double").alias("_cum"),
                            F.sum(count).over(part).cast("double").alias("_tot")))
    rank = F.lit(float(q)) * F.col("_tot")
    hit = (ranked.where(F.col("_cum") >= rank)
                 .groupBy(*keys)
                 .agg(F.min_by(F.struct("le", "_n", "_cum", "_tot"), F.col("le")).alias("_hit")))
    le = F.col("_hit.le")
    lo = lower_edge(le, bounds)
    hi_finite = F.lit(float(max(bounds)))
    r = F.lit(float(q)) * F.col("_hit._tot") - (F.col("_hit._cum") - F.col("_hit._n"))
    val = (F.when(le == F.lit(INF), hi_finite)
            .when((le == F.lit(float(min(bounds)))) & (le <= 0), le)
            .otherwise(lo + (le - lo) * r / F.col("_hit._n")))
    return hit.select(*keys, val.alias(name))


def bucket_quantile(buckets: Column, q: float, bounds: Sequence[float]) -> Column:
    """:func:`histogram_quantile` of one row's array of (le, n), a ``le`` possibly
    several times (partial counts). Null without observations. Walks the declared
    bounds, so its work doesn't depend on the counts."""
    if not (0.0 <= q <= 1.0) or math.isnan(q):
        raise ValueError(f"quantile must lie in [0, 1], got {q}")
    declared = F.array(*[F.lit(b) for b in sorted({*map(float, bounds), INF})])
    zero = F.lit(0).cast("double")
    upto = lambda hit: F.aggregate(F.filter(buckets, hit), zero, lambda acc, x: acc + x["n"])
    total = F.aggregate(buckets, zero, lambda acc, x: acc + x["n"])
    per = F.transform(declared, lambda le: F.struct(le.alias("le"), upto(lambda x: x["le"] == le).alias("n"),
                                                    upto(lambda x: x["le"] <= le).alias("cum")))
    rank = F.lit(float(q)) * total
    hit = F.get(F.filter(per, lambda x: (x["n"] > 0) & (x["cum"] >= rank)), F.lit(0))
    lo = lower_edge(hit["le"], bounds)
    return (F.when(hit.isNull(), F.lit(None).cast("double"))
             .when(hit["le"] == F.lit(INF), F.lit(float(max(bounds))))
             .when((hit["le"] == F.lit(float(min(bounds)))) & (hit["le"] <= 0), hit["le"])
             .otherwise(lo + (hit["le"] - lo) * (rank - (hit["cum"] - hit["n"])) / hit["n"]))


# E4 / E5 ----------------------------------------------------------------
def increase(samples: DataFrame, window_s: int, series, ts: str = "ts",
             value: str = "value", name: str = "increase") -> DataFrame:
    """``increase(counter[w])`` evaluated at each sample, per series."""
    keys = _cols(series)
    order = Window.partitionBy(*keys).orderBy(ts)
    prev = F.lag(value).over(order)
    delta = (F.when(prev.isNull(), F.lit(0.0))
              .when(F.col(value) < prev, F.col(value))
              .otherwise(F.col(value) - prev))
    w_us = int(window_s) * 1_000_000
    rng = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(w_us - 1), 0)
    return (samples.select(*keys, ts, value, T.epoch_us(ts).alias("_us"),
                           delta.cast("double").alias("_delta"))
                   .select(*keys, ts, F.sum("_delta").over(rng).alias(name)))


def rate(samples: DataFrame, window_s: int, series, ts: str = "ts",
         value: str = "value", name: str = "rate") -> DataFrame:
    inc = increase(samples, window_s, series, ts, value, "_inc")
    return inc.select(*_cols(series), ts, (F.col("_inc") / F.lit(float(window_s))).alias(name))


# E6 ---------------------------------------------------------------------
def max_over_time(samples: DataFrame, window_s: int, series=None, ts: str = "ts",
                  value: str = "value", name: str = "max_over_time") -> DataFrame:
    """Trailing maximum at every sample. Time is cut into spans of many windows;
    a sample also goes, as history only, to the next span if it lies within a
    window of its end. So a series (or the lack of one) is never one task."""
    keys = _cols(series)
    w_us = int(window_s) * 1_000_000
    span = max(w_us * 8, 86_400_000_000)
    rng = Window.partitionBy(*keys, "_span").orderBy("_us").rangeBetween(-(w_us - 1), 0)
    x = samples.select(*keys, ts, value, T.epoch_us(ts).alias("_us"))
    x = x.withColumn("_own", F.floor(F.col("_us") / F.lit(span)).cast("long"))
    late = (F.col("_own") + 1) * F.lit(span) - F.col("_us") < F.lit(w_us)
    x = x.withColumn("_span", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    return (x.withColumn(name, F.max(value).over(rng)).where(F.col("_span") == F.col("_own"))
             .select(*keys, ts, name))


# E5 on raw observations -------------------------------------------------
def window_rate(df: DataFrame, step_s: int, by=None, ts: str = "ts",
                name: str = "rate") -> DataFrame:
    """Per-second rate of observations in epoch-aligned ``step_s`` buckets,
    stamped with the bucket end; partial counts combine map-side."""
    keys = _cols(by)
    return (df.groupBy(T.bucket_index(ts, step_s).alias("_b"), *keys)
              .agg(F.count(F.lit(1)).alias("_n"))
              .select(T.index_to_ts(F.col("_b") + 1, step_s).alias("ts"), *keys,
                      (F.col("_n") / F.lit(float(step_s))).alias(name)))


def window_rates(df: DataFrame, step_s: int, selected: dict[str, Column], by=None, ts: str = "ts") -> DataFrame:
    """Several :func:`window_rate` vectors of one input, side by side and from one
    pass: a column per selection, null where the vector has no sample."""
    keys = _cols(by)
    counts = [F.count(F.when(cond, 1)).alias(n) for n, cond in selected.items()]
    per = df.groupBy(T.bucket_index(ts, step_s).alias("_b"), *keys).agg(*counts)
    return per.select(T.index_to_ts(F.col("_b") + 1, step_s).alias("ts"), *keys,
                      *[F.when(F.col(n) > 0, F.col(n) / F.lit(float(step_s))).alias(n) for n in selected])


def window_quantile(df: DataFrame, value: str, q: float, bounds: Sequence[float],
                    step_s: int, by=None, ts: str = "ts", scale: float = 1.0,
                    name: str = "value") -> DataFrame:
    """``histogram_quantile(q, sum by (le, by…)(rate(h_bucket[step])))`` on raw
    observations: the rate's 1/step cancels inside the quantile."""
    keys = _cols(by)
    binned = df.select(T.bucket_index(ts, step_s).alias("_b"), *keys, value)
    counts = bucket_counts(binned, value, bounds, ["_b", *keys])
    hq = histogram_quantile(counts, q, bounds, ["_b", *keys], name="_q")
    out = F.col("_q") / F.lit(float(scale)) if scale != 1.0 else F.col("_q")
    return hq.select(T.index_to_ts(F.col("_b") + 1, step_s).alias("ts"), *keys, out.alias(name))


# E7 / E8 / E9 -----------------------------------------------------------
def sum_by(df: DataFrame, by=None, ts: str = "ts", value: str = "value",
           name: str = "value") -> DataFrame:
    return df.groupBy(ts, *_cols(by)).agg(F.sum(value).alias(name))


def sum_all(df: DataFrame, ts: str = "ts", value: str = "value", name: str = "value") -> DataFrame:
    return sum_by(df, None, ts, value, name)


def max_all(df: DataFrame, ts: str = "ts", value: str = "value", name: str = "value") -> DataFrame:
    return df.groupBy(ts).agg(F.max(value).alias(name))


# E10 --------------------------------------------------------------------
def divide(a: DataFrame, b: DataFrame, on, a_value: str, b_value: str,
           name: str = "ratio") -> DataFrame:
    """Vector ÷ vector on matching labels; ÷0 → null (no sample)."""
    keys = _cols(on)
    j = a.select(*keys, F.col(a_value).alias("_a")).join(
        b.select(*keys, F.col(b_value).alias("_b")), keys, "inner")
    return j.select(*keys, F.try_divide(F.col("_a"), F.col("_b")).alias(name))


def scale(df: DataFrame, value: str, divisor: float) -> DataFrame:
    return df.withColumn(value, F.col(value) / F.lit(float(divisor)))


# E13 --------------------------------------------------------------------
def vector_and(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """``a and b``: keep samples of ``a`` whose labels also exist in ``b``."""
    keys = _cols(on)
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


# E14 --------------------------------------------------------------------
def alert_for(df: DataFrame, step_s: int, for_s: int, series=None, ts: str = "ts") -> DataFrame:
    """``for:`` on a regular evaluation grid. ``df`` holds the instants where
    the condition is *true* (absent = false). Consecutive grid instants form an
    island; an instant is ``firing`` once ``ts - island_start >= for``, else
    ``pending``. Scanned by days, so a condition without series labels is not
    one task either."""
    keys = _cols(series)
    idx = F.floor(T.epoch_us(ts) / F.lit(int(step_s) * 1_000_000)).cast("long")
    day = T.bucket_index(ts, 86_400)
    isl = ordered_scan(df.withColumn("_i", idx), keys, ["_i"], day, prevs={"_g": F.col("_i")})
    begins = F.when(F.col("_g").isNull() | (F.col("_g") < F.col("_i") - 1), F.col(ts))
    out = ordered_scan(isl, keys, ["_i"], day, lasts={"active_since": begins})
    held = T.epoch_us(ts) - T.epoch_us("active_since")
    return (out.withColumn("state", F.when(held >= F.lit(int(for_s) * 1_000_000), F.lit("firing"))
                                     .otherwise(F.lit("pending")))
               .drop("_i", "_g"))


def eval_grid(per_step: DataFrame, step_s: int, window_s: int, ts: str = "ts") -> DataFrame:
    """Spread per-step partial aggregates (stamped at bucket end) onto every
    evaluation instant ``t`` whose trailing window ``(t-w, t]`` covers them.
    The fan-out is the constant ``window/step`` on already-aggregated rows;
    callers re-aggregate by the new ``ts``."""
    if window_s < step_s or window_s % step_s:
        raise ValueError(f"window {window_s}s must be a multiple of the step {step_s}s")
    n = int(window_s // step_s)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    others = [c for c in per_step.columns if c != ts]
    return (per_step.select("*", k.alias("_k"))
                    .select(T.from_epoch_us(T.epoch_us(ts) + F.col("_k") * F.lit(int(step_s) * 1_000_000)).alias(ts),
                            *others))


def step_counts(df: DataFrame, step_s: int, by=None, ts: str = "ts", name: str = "n",
                value: str | None = None, agg=None) -> DataFrame:
    """Per-step partial aggregate stamped at bucket end (count, or ``agg`` of
    ``value``)."""
    keys = _cols(by)
    a = F.count(F.lit(1)) if value is None else (agg or F.sum)(value)
    return (df.groupBy(T.bucket_index(ts, step_s).alias("_b"), *keys).agg(a.alias(name))
              .select(T.index_to_ts(F.col("_b") + 1, step_s).alias(ts), *keys, name))


# E16 --------------------------------------------------------------------
def last_not_null(df: DataFrame, by=None, ts: str = "ts", value: str = "value",
                  name: str = "value") -> DataFrame:
    keys = _cols(by)
    return (df.where(F.col(value).isNotNull())
              .groupBy(*keys)
              .agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(name)))


# E17 --------------------------------------------------------------------
def logs_recent(logs: DataFrame, service: str, limit: int | None = None) -> DataFrame:
    """``{service_name="$service"}``: every line, newest first. Only a panel that
    states a ``limit`` has one (then a distributed top-k)."""
    out = (logs.where(F.col("service") == F.lit(service))
               .orderBy(F.col("ts").desc(), F.col("doc_id").desc()))
    return out if limit is None else out.limit(int(limit))


# E18 --------------------------------------------------------------------
def traces_recent(spans: DataFrame, service: str, limit: int | None = 20) -> DataFrame:
    """``{ service.name = "$service" }``: traces with a matching span, latest
    ``limit`` by trace start (None: all of them). One scan and one aggregation:
    whether a span matches is part of it."""
    per_trace = (spans.groupBy("trace_id")
                      .agg(F.max(F.col("service") == F.lit(service)).alias("_hit"),
                           F.min("start_ts").alias("start_ts"),
                           F.max("end_ts").alias("end_ts"),
                           F.count(F.lit(1)).alias("span_count"),
                           F.min_by("service", F.struct("start_ts", "span_id")).alias("root_service"))
                      .where("_hit"))
    dur = (T.epoch_us("end_ts") - T.epoch_us("start_ts")) / F.lit(1000.0)
    out = (per_trace.select("trace_id", "root_service", "start_ts", "span_count",
                            dur.alias("duration_ms"))
                    .orderBy(F.col("start_ts").desc(), F.col("trace_id").desc()))
    return out if limit is None else out.limit(int(limit))


# E19 --------------------------------------------------------------------
def threshold_state(value, threshold: float) -> Column:
    """Grafana absolute thresholds: green base, red from ``threshold``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v >= F.lit(float(threshold)), F.lit("red")).otherwise(F.lit("green"))


# E20 --------------------------------------------------------------------
def time_range(df: DataFrame, hours: float = 6.0, ts: str = "ts") -> DataFrame:
    """Dashboard range ``now-6h .. now`` with ``now`` = newest sample. The
    newest sample is one scalar subquery (a tiny aggregate), not a join;
    ``ts <= now`` holds by definition. The column itself is compared, so that
    the bound reaches the scan."""
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600).cast("decimal(18,6)"))
    lo = df.select((F.max(ts) - back).alias("lo")).scalar()
    return df.where(F.col(ts) >= lo)


# E21 --------------------------------------------------------------------
def legend(*labels: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in labels])
