"""Built-in stage types registered with the
flow runner. Each is ordinary DataFrame code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.functions.attrs import ZERO_TRACE, to_envelope
from pipework.operators.flow import FlowError, stage

# --- fixed values ---------------------------------------------------------
DEFAULT_SOURCE_MESSAGE = "noop_source"
# -------------------------------------------------------------------------


@dataclass
class NoopSourceConfig:
    delay_ms: int = 0
    message: str = ""
    max_messages: int = 0


def sequence_rows(spark: SparkSession, message: str, threads: int, max_messages: int) -> DataFrame:
    """A1: every worker emits ``"<message> #<i>"`` for i in [0, max): a source
    with ``threads`` workers yields threads × max rows (each worker counts
    from 0). Built from ``spark.range`` so it is generated on executors."""
    if max_messages <= 0:
        raise FlowError("batch sequence source needs max_messages > 0 (0 = unlimited is streaming only)")
    msg = message or DEFAULT_SOURCE_MESSAGE
    n = int(threads) * int(max_messages)
    # rows are generated on the executors; partitions follow the row count
    # (~1M rows each), not the worker count
    parts = max(spark.sparkContext.defaultParallelism, -(-n // 1_000_000))
    r = spark.range(0, n, 1, numPartitions=min(parts, max(1, n)))
    return r.select((F.col("id") % threads).alias("worker"), F.floor(F.col("id") / threads).alias("seq")) \
            .select("worker", "seq", F.concat(F.lit(msg + " #"), F.col("seq").cast("string")).alias("text"))


def text_envelope(df: DataFrame, text: str = "text", span_key=None) -> DataFrame:
    """Wrap a text column as an envelope row (no schema id, no trace). Each
    record gets a span id derived from ``span_key`` (default: the text), so
    competing consumers, which split on it, actually share the load."""
    body = F.col(text)
    key = span_key if span_key is not None else body
    return df.select("*", F.encode(body, "UTF-8").alias("payload"),
                     F.octet_length(body).cast("long").alias("size"),
                     F.current_timestamp().cast("timestamp_ntz").alias("enqueue_ts"),
                     F.lit(ZERO_TRACE).alias("trace_id"),
                     F.substring(F.md5(key.cast("string")), 1, 16).alias("span_id"),
                     F.lit(0).cast("long").alias("flags"), F.lit("").alias("schema_id"),
                     F.lit(None).cast("map<string,string>").alias("attrs"))


@stage("noop_source", "source", NoopSourceConfig)
def _noop_source(spark, cfg: NoopSourceConfig):
    def produce(threads: int) -> DataFrame:
        rows = sequence_rows(spark, cfg.message, threads, cfg.max_messages)
        return text_envelope(rows, "text", F.concat_ws(":", "worker", "seq"))
    return produce


@dataclass
class TableSourceConfig:
    table: str = ""            # temp view / catalog table name
    path: str = ""             # or a parquet path
    payload_cols: list | None = None
    payload_col: str | None = None  # use this text column's bytes as the payload
    ts: str | None = None


@stage("table_source", "source", TableSourceConfig)
def _table_source(spark, cfg: TableSourceConfig):
    """Rows of a table; tables without the envelope get one (JSON payload of
    ``payload_cols``, or the bytes of ``payload_col``)."""
    def produce(threads: int) -> DataFrame:
        df = spark.table(cfg.table) if cfg.table else spark.read.parquet(cfg.path)
        if "payload" not in df.columns:
            if cfg.payload_col:
                df = text_envelope(df, cfg.payload_col)
            else:
                df = to_envelope(df, cfg.payload_cols or df.columns, cfg.ts)
        # threads = independent workers reading the same table (behaviour 2)
        if threads == 1:
            return df
        return df.withColumn("_worker", F.explode(F.sequence(F.lit(1), F.lit(threads)))).drop("_worker")
    return produce


@dataclass
class NoopTransformConfig:
    verbose: bool = False
    delay_ms: int = 0          # pacing only; no effect on results


@stage("noop_transform", "transform", NoopTransformConfig)
def _noop_transform(spark, cfg: NoopTransformConfig):
    """A3: output = input, metadata included."""
    return lambda df: df


@stage("stdout_sink", "sink", None)
def _stdout_sink(spark, cfg):
    """A4: skip empty payloads; each payload becomes one text line."""
    def consume(df: DataFrame) -> DataFrame:
        ok = F.col("payload").isNotNull() & (F.coalesce(F.col("size"), F.lit(0)) > 0)
        return df.where(ok).select(F.decode("payload", "UTF-8").alias("value"))
    return consume


@dataclass
class CsvParserConfig:
    schema: str = ""           # DDL, e.g. "id BIGINT, name STRING"
    column: str = "value"
    mode: str = "PERMISSIVE"


@stage("csv_parser", "transform", CsvParserConfig)
def _csv_parser(spark, cfg: CsvParserConfig):
    """Parse one CSV record per row into typed columns."""
    if not cfg.schema:
        raise FlowError("csv_parser needs a schema")

    def process(df: DataFrame) -> DataFrame:
        src = F.col(cfg.column) if cfg.column in df.columns else F.decode("payload", "UTF-8")
        parsed = F.from_csv(src, cfg.schema, {"mode": cfg.mode})
        return df.withColumn("record", parsed)
    return process


@dataclass
class UpperConfig:
    pass


@stage("upper_payload", "transform", UpperConfig)
def _upper_payload(spark, cfg):
    """A13 example of a user transform: upper-cases the payload text. 1:1,
    metadata carried over, JVM-side expression."""
    def process(df: DataFrame) -> DataFrame:
        up = F.upper(F.decode("payload", "UTF-8"))
        return df.withColumn("payload", F.encode(up, "UTF-8")).withColumn("size", F.octet_length(up).cast("long"))
    return process


@stage("table_sink", "sink", None)
def _table_sink(spark, cfg):
    """A17 table writer: everything but the envelope bytes."""
    return lambda df: df.drop("payload")
