"""Sequence sources (A1 batch from a config table, A2 paced stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Messages that one row generates at most; longer sequences are generated by blocks.
BLOCK = 10_000


def sequence_from_configs(cfg: DataFrame, key: str, message: str, threads: str,
                          max_messages: str) -> DataFrame:
    """One sequence source per config row: ``threads`` workers each emit
    ``"<message> #<i>"`` for i in [0, max_messages). Configs without a worker or
    a message emit nothing (see :func:`sequence_config_errors`)."""
    n, m = F.col(threads).cast("long"), F.col(max_messages).cast("long")
    ok = cfg.where((n > 0) & (m > 0)).select(key, message, m.alias("_m"), n.alias("_n"))
    w = ok.select(key, message, "_m", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("worker"))
    b = w.select(key, message, "_m", "worker",
                 F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / F.lit(BLOCK)))).alias("_b"))
    first = F.col("_b") * BLOCK
    s = b.select(key, message, "worker",
                 F.explode(F.sequence(first, F.least(first + (BLOCK - 1), F.col("_m") - 1))).alias("seq"))
    return s.select(key, F.col("worker").cast("long").alias("worker"), F.col("seq").cast("long").alias("seq"),
                    F.concat(F.col(message), F.lit(" #"), F.col("seq").cast("string")).alias("text"))


def sequence_config_errors(cfg: DataFrame, key: str, threads: str, max_messages: str) -> DataFrame:
    """Configs that can't run in a batch, with the reason."""
    n, m = F.coalesce(F.col(threads).cast("long"), F.lit(0)), F.coalesce(F.col(max_messages).cast("long"), F.lit(0))
    error = (F.when(n <= 0, F.lit("stage must declare at least one thread"))
              .when(m <= 0, F.lit("batch sequence source needs max_messages > 0")))
    return cfg.select(key, error.alias("error")).where("error IS NOT NULL")


def rate_sequence(spark: SparkSession, message: str, threads: int = 1, delay_ms: int = 200,
                  max_messages: int = 0, unpaced_rows: int = 1_000_000) -> DataFrame:
    """A2 streaming form: one row every ``delay_ms`` per worker, via the built-in
    ``rate`` source. That source counts whole rows a second, so it runs at the
    next whole rate and the rows that a slower pace doesn't reach are left out.
    ``delay_ms`` 0 means no pacing (``unpaced_rows`` a second). Message v belongs
    to worker ``v % threads`` as its ``v // threads``-th; ``max_messages`` > 0
    bounds each worker."""
    if delay_ms > 0:
        num, den = threads * 1000, delay_ms
    else:
        num, den = unpaced_rows, 1
    rps = -(-num // den)
    r = spark.readStream.format("rate").option("rowsPerSecond", rps).load()
    nth = lambda v: F.floor(v * F.lit(num) / F.lit(rps * den))  # noqa: E731  messages due after v rows
    r = r.where(nth(F.col("value") + 1) > nth(F.col("value"))).withColumn("value", nth(F.col("value") + 1) - 1)
    out = r.select((F.col("value") % threads).alias("worker"),
                   F.floor(F.col("value") / threads).alias("seq"),
                   F.col("timestamp").cast("timestamp_ntz").alias("enqueue_ts"))
    if max_messages:
        out = out.where(F.col("seq") < max_messages)
    return out.withColumn("text", F.concat(F.lit((message or "noop_source") + " #"), F.col("seq").cast("string")))
