"""Quantiles of observations that declare no buckets (E11 without bounds).

Each step of a series keeps one mergeable KLL sketch (a few KB whatever the
number of observations); the sketches of a trailing window are merged and
answer any quantile. A group of few observations is answered exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.operators.promql import _cols, eval_grid

#: Size parameter of a sketch: larger is more exact.
K = 200


def rank_error(k: int = K) -> float:
    """How far the rank of an answer may lie from the rank asked for, as a share of
    all observations, with 99 % confidence (fitted constants of the KLL sketch)."""
    return 2.296 / k ** 0.9723


def step_sketches(df: DataFrame, value: str, step_s: int, by=None, ts: str = "ts", k: int = K) -> DataFrame:
    """One sketch per step and series, stamped at the step's end. Null and NaN
    observations don't count; a step without others has no row. Sketches are
    partially aggregated, so the shuffle carries sketches, not observations."""
    keys = _cols(by)
    seen = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return (seen.groupBy(T.bucket_index(ts, step_s).alias("_b"), *keys)
                .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
                .select(T.index_to_ts(F.col("_b") + 1, step_s).alias("ts"), *keys, "sketch"))


def merged(sketches: DataFrame, by=None, k: int = K) -> DataFrame:
    """The sketches of each group as one."""
    return sketches.groupBy(*_cols(by)).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile(sketches: DataFrame, q: float, name: str = "value") -> DataFrame:
    """Each sketch's ``q`` quantile and its number of observations ``n``."""
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile must lie in [0, 1], got {q}")
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, F.kll_sketch_get_n_double("sketch").alias("n"),
                           F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name))


def trailing_quantile(df: DataFrame, value: str, q: float, step_s: int, window_s: int, by=None,
                      ts: str = "ts", name: str = "value", k: int = K) -> DataFrame:
    """The quantile over the trailing window ``(t-w, t]`` at every step ``t`` with
    observations in it: observations are read once, a step's sketch goes to the
    window/step instants that it counts for."""
    spread = eval_grid(step_sketches(df, value, step_s, by, ts, k), step_s, window_s)
    return quantile(merged(spread, ["ts", *_cols(by)], k), q, name)


def rank_check(df: DataFrame, answers: DataFrame, value: str, q: float, by, error: float,
               answer: str = "value") -> DataFrame:
    """Whether each group's ``answer`` has, among the group's observations, a rank
    within ``error`` of ``q`` → (by…, n, within). Exact: counts what lies below
    the answer and what equals it, in one pass over the observations."""
    keys = _cols(by)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    a = answers.select(*keys, F.col(answer).alias("_a"))
    counts = x.join(a, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_v") < F.col("_a"), 1)).alias("_lt"),
        F.count(F.when(F.col("_v") <= F.col("_a"), 1)).alias("_le"))
    within = (F.col("_lt") / F.col("n") <= F.lit(q + error)) & (F.col("_le") / F.col("n") >= F.lit(q - error))
    return counts.select(*keys, "n", within.alias("within"))
