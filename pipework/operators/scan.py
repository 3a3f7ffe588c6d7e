"""Skew-safe ordered scans (running sums, last non-null, previous row).

A window ``partitionBy(key).orderBy(ts, seq)`` sends every row of a key to
one task. For most keys that is right: one shuffle, nothing else. Only a
*heavy* key (a sketch of fixed size finds them; there are at most
``HEAVY_KEYS``) is split into chunks along the order:

1. local scans with windows partitioned by ``(key, chunk)``;
2. one summary row per ``(key, chunk)`` (chunk totals / last values);
3. an exclusive prefix over the chunk summaries of each key (one row per chunk);
4. the local result joined with its chunk's prefix on ``(key, chunk)``.

Both ways give the same rows. Nothing is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipework.functions import time as T


def hour_chunk(ts: str = "ts", seconds: int = 3600) -> Column:
    """Default chunking: epoch-aligned time buckets of the ordering column."""
    return T.bucket_index(ts, seconds)


#: A key is heavy with more than this many rows, and more than 1/HEAVY_KEYS of all rows.
HEAVY_ROWS = 1_000_000
HEAVY_KEYS = 1000
#: Keys a sketch tracks at most: any key of over 3.5/TRACKED of all rows is found, which
#: covers 1/HEAVY_KEYS; a sketch has some 100 KB whatever the number of keys.
TRACKED = 1 << 14
#: Sketches of the partitions are merged in this many groups first, then these.
MERGES = 256


def heavy_hashes(df: DataFrame, key: list[str], heavy_rows: int | None = None) -> list[int]:
    """Hashes of the heavy keys, HEAVY_KEYS at most, from a mergeable frequent-items
    sketch: no key is shuffled, only sketches are. Counts are upper bounds, so a
    key may come out heavy that is slightly lighter than ``heavy_rows``; a lighter
    key with the same hash goes with it. Neither changes a scan's rows."""
    heavy_rows = HEAVY_ROWS if heavy_rows is None else heavy_rows
    hashed = df.select(F.xxhash64(*key).alias("_h"), (F.spark_partition_id() % MERGES).alias("_m"))
    first = hashed.groupBy("_m").agg(F.expr(f"approx_top_k_accumulate(_h, {TRACKED})").alias("_s"))
    top = first.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(_s, {TRACKED})").alias("_s")) \
               .select(F.expr(f"approx_top_k_estimate(_s, {HEAVY_KEYS})").alias("top")).first()
    return [r["item"] for r in top["top"] if r["count"] > heavy_rows] if top else []   # no rows, no sketch


def split_heavy(df: DataFrame, key: list[str], heavy_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of heavy keys or None). The driver gets hashes of
    the heavy keys only."""
    heavy = heavy_hashes(df, key, heavy_rows)
    if not heavy:
        return df, None
    hit = F.xxhash64(*key).isin(heavy)
    return df.where(~hit), df.where(hit)


def ordered_scan(df: DataFrame, key: list[str], order: list[str], chunk: Column | str,
                 sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None,
                 prevs: dict[str, Column] | None = None, heavy_rows: int | None = None) -> DataFrame:
    """Add ``sums``, ``lasts`` and ``prevs`` (see :func:`chunked_scan`) per ``key``
    in ``order``: by plain windows, and by chunks for keys of over
    ``heavy_rows`` rows. Without a key all rows are one series, by chunks."""
    if not key:
        return chunked_scan(df, key, order, chunk, sums, lasts, prevs)
    light, heavy = split_heavy(df, key, heavy_rows)
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    new = {n: F.sum(c).over(run) for n, c in (sums or {}).items()}
    new |= {n: F.last(c, ignorenulls=True).over(run) for n, c in (lasts or {}).items()}
    new |= {n: F.lag(c).over(w) for n, c in (prevs or {}).items()}
    out = light.withColumns(new)
    if heavy is None:
        return out
    return out.unionByName(chunked_scan(heavy, key, order, chunk, sums, lasts, prevs).select(*out.columns))


def chunked_scan(df: DataFrame, key: list[str], order: list[str], chunk: Column | str,
                 sums: dict[str, Column] | None = None,
                 lasts: dict[str, Column] | None = None,
                 prevs: dict[str, Column] | None = None) -> DataFrame:
    """Add, per ``key`` in ``order``:

    * ``sums[n]``  – inclusive running sum of the column;
    * ``lasts[n]`` – inclusive last non-null value;
    * ``prevs[n]`` – value on the previous row (null on the key's first row).

    ``chunk`` must be non-decreasing along ``order`` within a key."""
    sums, lasts, prevs = sums or {}, lasts or {}, prevs or {}
    keys = list(key)
    ordc = F.struct(*order)
    x = df if isinstance(chunk, str) else df.withColumn("_chunk", chunk)
    for n, c in {**sums, **lasts, **prevs}.items():
        x = x.withColumn(f"_in_{n}", c)
    part = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    run = part.rowsBetween(Window.unboundedPreceding, 0)
    local = x
    for n in sums:
        local = local.withColumn(f"_ls_{n}", F.sum(f"_in_{n}").over(run))
    for n in lasts:
        local = local.withColumn(f"_ll_{n}", F.last(f"_in_{n}", ignorenulls=True).over(run))
    for n in prevs:
        local = local.withColumn(f"_lp_{n}", F.lag(f"_in_{n}").over(part))
    if prevs:
        local = local.withColumn("_first", F.row_number().over(part) == 1)

    summary = local.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_ls_{n}", ordc).alias(f"_ts_{n}") for n in sums],
        *[F.max_by(f"_ll_{n}", ordc).alias(f"_tl_{n}") for n in lasts],
        *[F.max_by(f"_in_{n}", ordc).alias(f"_tp_{n}") for n in prevs])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_w = Window.partitionBy(*keys).orderBy("_chunk")
    prefix = summary.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_ts_{n}").over(before), F.lit(0)).alias(f"_ps_{n}") for n in sums],
        *[F.last(f"_tl_{n}", ignorenulls=True).over(before).alias(f"_pl_{n}") for n in lasts],
        *[F.lag(f"_tp_{n}").over(chunk_w).alias(f"_pp_{n}") for n in prevs])

    for k in keys:   # a null key is a key
        prefix = prefix.withColumnRenamed(k, f"_key_{k}")
    same = F.col("_chunk").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = local.join(prefix.withColumnRenamed("_chunk", "_at"), same, "inner").drop("_at", *[f"_key_{k}" for k in keys])
    for n in sums:
        out = out.withColumn(n, F.col(f"_ls_{n}") + F.col(f"_ps_{n}"))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(F.col(f"_ll_{n}"), F.col(f"_pl_{n}")))
    for n in prevs:
        out = out.withColumn(n, F.when(F.col("_first"), F.col(f"_pp_{n}")).otherwise(F.col(f"_lp_{n}")))
    drop = [c for c in out.columns if c.startswith(("_in_", "_ls_", "_ll_", "_lp_", "_ps_", "_pl_", "_pp_"))]
    out = out.drop(*drop, "_first")
    return out.drop("_chunk")
