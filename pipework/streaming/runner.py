"""Structured Streaming forms of flows and telemetry (A2, A8-A11, A14, A17,
E5 on streams).

The same :func:`pipework.operators.flow.run_flow` builder composes streaming
DataFrames: stamps, gates, competing splits (filters) and fan-in (union) are
all stateless, so a flow is one streaming query: its graph runs over each
micro-batch, and all sinks of a batch are written before the next.

* job mode (A8) = ``trigger(availableNow=True)`` then wait: drain, exit;
* streaming mode (A9) = ``trigger(processingTime=…)`` until stopped;
* bounded admission (A10) = the tightest queue behind a source, as
  ``maxFilesPerTrigger``; never changes results;
* stop on first failure (A11) = any query failing stops the others; its
  checkpoint makes the input replayable (better than the reference, which
  loses buffered rows);
* sinks write through checkpointed file sinks (exactly-once) or
  ``foreachBatch`` keyed by ``batch_id`` (idempotent overwrite).

Checkpoints live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipework.operators.flow import admission_limits, check_spec, hadoop_path, registered, run_flow, source_frames, stage
from pipework.operators.stages import text_envelope
from pipework.session import scratch_path
from pipework.sources.sequence import rate_sequence


# ---------------------------------------------------------------------------
# streaming sources as stage types
# ---------------------------------------------------------------------------
@dataclass
class FileSourceConfig:
    path: str = ""
    format: str = "parquet"        # parquet | json | text | csv
    schema: str = ""               # DDL (required for non-text formats)
    max_files_per_trigger: int = 0  # bounded admission (A10)
    payload_col: str | None = None


@stage("file_source", "source", FileSourceConfig)
def _file_source(spark, cfg: FileSourceConfig):
    """Streaming scan of a folder; new files are new rows."""
    def produce(threads: int) -> DataFrame:
        r = spark.readStream.format(cfg.format)
        if cfg.schema and cfg.format != "text":
            r = r.schema(cfg.schema)
        if cfg.max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", cfg.max_files_per_trigger)
        df = r.load(cfg.path)
        if cfg.payload_col or cfg.format == "text":
            df = text_envelope(df, cfg.payload_col or "value")
        # threads = independent workers reading the same folder, as for a table
        return df if threads == 1 else df.withColumn("_worker", F.explode(F.sequence(F.lit(1), F.lit(threads)))).drop("_worker")
    return produce


@dataclass
class RateSourceConfig:
    delay_ms: int = 200
    message: str = ""
    max_messages: int = 0


@stage("rate_source", "source", RateSourceConfig)
def _rate_source(spark, cfg: RateSourceConfig):
    """A2: the paced sequence source as a stream."""
    def produce(threads: int) -> DataFrame:
        rows = rate_sequence(spark, cfg.message, threads, cfg.delay_ms, cfg.max_messages)
        return text_envelope(rows.drop("enqueue_ts"))   # the envelope has one of its own
    return produce


# ---------------------------------------------------------------------------
# running
# ---------------------------------------------------------------------------
SOURCE = "_source"


def _admitted(spec: dict) -> dict:
    """A10 applied: file sources without a limit of their own take at most as many
    files per micro-batch as their tightest queue holds (a file has a row at least)."""
    limits = admission_limits(spec)

    def one(s: dict) -> dict:
        cfg = dict(s.get("config") or {})
        if registered(s["type"]).config is FileSourceConfig and limits.get(s["name"]) and not cfg.get("max_files_per_trigger"):
            cfg["max_files_per_trigger"] = limits[s["name"]]
            return {**s, "config": cfg}
        return s
    return {**spec, "stages": [one(s) for s in spec.get("stages") or []]}


def _tagged_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one stream: the stage's name, and its rows as a struct of that name."""
    frames = [df.select(F.lit(name).alias(SOURCE), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)) for name, df in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def start_flow(spark: SparkSession, spec: dict, out_dir: str, mode: str = "job",
               interval: str = "10 seconds", fmt: str = "parquet", name: str | None = None,
               set_schema: bool = False) -> list[StreamingQuery]:
    """Start the flow as one streaming query, however many sinks it has.

    The sources are read once, as one stream. Each micro-batch is kept while the
    flow's graph runs over it and every sink writes its rows to
    ``out_dir/<sink>/batch_id=<n>``; then ``out_dir/_batches/<n>`` marks the batch.
    All sinks therefore stand at the same batch whenever the flow stops. A batch
    that is replayed after its mark is skipped, one without a mark overwrites its
    own folders. :func:`read_sink` reads the marked batches. ``mode="job"`` drains
    what is available and stops; ``"streaming"`` runs until :func:`stop_all`."""
    check_spec(spec)
    spec = _admitted(spec)
    flow, base = name or spec.get("name") or "flow", out_dir.rstrip("/")
    sources = source_frames(spark, spec)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        fs, mark = hadoop_path(own, f"{base}/_batches/{batch_id}")
        if fs.exists(mark):
            return
        batch = batch.persist()
        try:
            rows = {n: batch.where(F.col(SOURCE) == n).select(F.col(f"`{n}`.*")) for n in sources}
            for sink, df in run_flow(own, spec, set_schema=set_schema, sources=rows).sinks.items():
                df.write.mode("overwrite").format(fmt).save(f"{base}/{sink}/batch_id={batch_id}")
        finally:
            batch.unpersist()
        fs.create(mark).close()

    w = (_tagged_sources(sources).writeStream.foreachBatch(write).queryName(flow)
         .option("checkpointLocation", scratch_path(spark, f"streams/{flow}")))
    w = w.trigger(availableNow=True) if mode == "job" else w.trigger(processingTime=interval)
    return [w.start()]


def read_sink(spark: SparkSession, out_dir: str, sink: str, fmt: str = "parquet") -> DataFrame | None:
    """A sink's rows of all marked batches; None before the first."""
    base = out_dir.rstrip("/")
    fs, marks = hadoop_path(spark, f"{base}/_batches")
    if not fs.exists(marks):
        return None
    done = [f"{base}/{sink}/batch_id={m.getPath().getName()}" for m in fs.listStatus(marks)]
    return spark.read.format(fmt).load(done) if done else None


def await_all(queries: list[StreamingQuery], timeout_s: float | None = None) -> None:
    """Wait for all queries at once; the first failure of any of them stops
    all the others and is re-raised. Returns when all have ended, or after
    ``timeout_s``."""
    end = None if timeout_s is None else time.monotonic() + timeout_s
    try:
        while True:
            for q in queries:
                if (failure := q.exception()) is not None:
                    raise failure
            running = [q for q in queries if q.isActive]
            if not running or (end is not None and time.monotonic() >= end):
                return
            running[0].awaitTermination(1)
    except Exception:
        stop_all(queries)
        raise


def stop_all(queries: list[StreamingQuery]) -> None:
    for q in queries:
        try:
            q.stop()
        except Exception:  # noqa: BLE001 - best effort on shutdown
            pass


def run_job(spark: SparkSession, spec: dict, out_dir: str, **kw) -> list[StreamingQuery]:
    """Run a flow to completion on the available input."""
    qs = start_flow(spark, spec, out_dir, mode="job", **kw)
    await_all(qs)
    return qs


def foreach_batch_sink(df: DataFrame, path: str, checkpoint: str,
                       transform: Callable[[DataFrame], DataFrame] | None = None,
                       fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Custom sink per micro-batch, idempotent by ``batch_id``: a
    replayed batch overwrites its own ``batch_id=`` folder and nothing else."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ---------------------------------------------------------------------------
# telemetry on streams
# ---------------------------------------------------------------------------
def stream_rate(df: DataFrame, step_s: int, by: list[str], ts: str = "ts",
                watermark: str = "10 minutes", name: str = "rate") -> DataFrame:
    """E5 on a stream: tumbling ``step_s`` windows closed by the watermark,
    rate stamped at the window end. Append mode emits each window once.
    Watermarks need a zoned ``TIMESTAMP``; with the session in UTC the cast
    from NTZ is exact and the window end is cast back."""
    et = "_event_ts"
    x = df.withColumn(et, F.col(ts).cast("timestamp"))
    w = F.window(F.col(et), f"{int(step_s)} seconds")
    agg = (x.withWatermark(et, watermark).groupBy(w.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("_n")))
    return agg.select(F.col("w.end").cast("timestamp_ntz").alias("ts"), *by,
                      (F.col("_n") / F.lit(float(step_s))).alias(name))


def observed(df: DataFrame, name: str, flag_cols: list[str]) -> DataFrame:
    """E30 etc. on streams: per-batch counters via ``observe`` (no extra job)."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"),
                      *[F.count(F.when(F.col(c), 1)).alias(c) for c in flag_cols])


def csv_ingest_stream(spark: SparkSession, in_dir: str, ddl: str, out_path: str, checkpoint: str,
                      max_files: int = 0) -> StreamingQuery:
    """A17 end to end: text files → ``from_csv`` → parquet per batch."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    lines = r.load(in_dir)
    parsed = lines.select(F.from_csv("value", ddl).alias("r")).select("r.*")
    return foreach_batch_sink(parsed, out_path, checkpoint)


__all__ = ["start_flow", "await_all", "stop_all", "run_job", "foreach_batch_sink", "stream_rate",
           "observed", "csv_ingest_stream", "read_sink"]
