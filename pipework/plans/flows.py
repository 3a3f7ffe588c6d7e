"""Named queries for record flows (A1-A18). Flows read the given tables
through ``table_source`` stages (temp views of derived inputs)."""

from __future__ import annotations

from pyspark.sql import functions as F

import pipework.operators.stages  # noqa: F401  (registers the built-in stage types)
from pipework.functions import time as T
from pipework.operators.flow import competing_split as split_rows
from pipework.operators.flow import fan_in as merge
from pipework.operators.flow import run_flow
from pipework.sources import fixtures as X
from pipework.sources.sequence import sequence_from_configs
from pipework.sources.tables import load

ORDERS_DDL = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"


def _payload_view(spark, d, name="pw_payloads"):
    X.payloads(spark, d).createOrReplaceTempView(name)
    return name


def _spec(stages, queues):
    return {"name": "q", "stages": stages,
            "queues": [q if isinstance(q, dict) else {"name": q, "capacity": 256} for q in queues]}


def seq_source(spark, d):
    """A1 with the source configs held in a table (one source per part)."""
    p = load(spark, d, "part")
    cfg = p.select("p_partkey", F.col("p_brand").alias("message"),
                   (F.col("p_size") % 3 + 1).alias("threads"), (F.col("p_size") % 5 + 1).alias("max_messages"))
    return sequence_from_configs(cfg, "p_partkey", "message", "threads", "max_messages")


def pass_through(spark, d):
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "src", "type": "table_source", "output_queue": "q1", "config": {"table": v}},
        {"name": "t", "type": "noop_transform", "threads": 2, "input_queue": "q1", "output_queue": "q2",
         "config": {"verbose": True, "delay_ms": 50}},
        {"name": "out", "type": "table_sink", "input_queue": "q2"}], ["q1", "q2"]))
    return run.sinks["out"].select("event_id", "schema_id", "flags", "trace_id", "span_id")


def text_sink(spark, d):
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "src", "type": "table_source", "output_queue": "q1", "config": {"table": v}},
        {"name": "sink", "type": "stdout_sink", "input_queue": "q1"}], ["q1"]))
    return run.sinks["sink"]


def competing_split(spark, d):
    """Both branches of the operator itself, on a key that is null for every third row."""
    p = X.payloads(spark, d).withColumn("_key", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    parts = split_rows(p, 2, "_key", "q")
    return merge([x.select("event_id", F.lit(i).cast("long").alias("consumer")) for i, x in enumerate(parts)])


def fan_in(spark, d):
    """Two competing transforms of one queue write into one merged queue."""
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "src", "type": "table_source", "output_queue": "q_in", "config": {"table": v}},
        {"name": "a", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_out"},
        {"name": "b", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_out"},
        {"name": "sink", "type": "table_sink", "input_queue": "q_out"}], ["q_in", "q_out"]))
    return run.sinks["sink"].select("event_id", "schema_id")


def flow_simple_pipeline(spark, d):
    """simple.pipeline shape over the documents table."""
    load(spark, d, "documents").createOrReplaceTempView("pw_documents")
    run = run_flow(spark, _spec([
        {"name": "source", "type": "table_source", "output_queue": "q1",
         "config": {"table": "pw_documents", "payload_col": "text"}},
        {"name": "transform", "type": "noop_transform", "threads": 2, "input_queue": "q1", "output_queue": "q2",
         "config": {"verbose": True, "delay_ms": 50}},
        {"name": "sink", "type": "stdout_sink", "input_queue": "q2"}], ["q1", "q2"]))
    return run.sinks["sink"]


def flow_fanout(spark, d):
    """fanout shape: two transforms compete for q_in, each feeds its sink."""
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "source", "type": "table_source", "output_queue": "q_in", "config": {"table": v}},
        {"name": "transform_a", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_a"},
        {"name": "transform_b", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_b"},
        {"name": "sink_a", "type": "stdout_sink", "input_queue": "q_a"},
        {"name": "sink_b", "type": "stdout_sink", "input_queue": "q_b"}],
        [{"name": "q_in", "capacity": 512}, "q_a", "q_b"]))
    return (run.sinks["sink_a"].withColumn("sink", F.lit("sink_a"))
            .unionByName(run.sinks["sink_b"].withColumn("sink", F.lit("sink_b"))))


def flow_job_mode(spark, d):
    """The schema sample flow run to completion; per-stage counters (§2.F).
    The pass-through inherits ``events`` into ``events_normalized``, so the
    sink receives nothing and every admitted row is an output error."""
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "source", "type": "table_source", "output_queue": "trade", "config": {"table": v}},
        {"name": "normalize", "type": "noop_transform", "input_queue": "trade", "output_queue": "trade_normalized"},
        {"name": "sink", "type": "stdout_sink", "input_queue": "trade_normalized"}],
        [{"name": "trade", "capacity": 128, "schema": {"schema_id": "events"}},
         {"name": "trade_normalized", "capacity": 128, "schema": {"schema_id": "events_normalized"}}]))
    return run.metrics()


def custom_transform(spark, d):
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "src", "type": "table_source", "output_queue": "q1", "config": {"table": v}},
        {"name": "up", "type": "upper_payload", "input_queue": "q1", "output_queue": "q2"},
        {"name": "sink", "type": "stdout_sink", "input_queue": "q2"}], ["q1", "q2"]))
    return run.sinks["sink"]


def csv_ingest(spark, d):
    """CSV text records → csv_parser → table writer."""
    o = load(spark, d, "orders")
    o.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").alias("line")) \
     .createOrReplaceTempView("pw_csv_lines")
    run = run_flow(spark, _spec([
        {"name": "listener", "type": "table_source", "output_queue": "raw",
         "config": {"table": "pw_csv_lines", "payload_col": "line"}},
        {"name": "parser", "type": "csv_parser", "input_queue": "raw", "output_queue": "parsed",
         "config": {"schema": ORDERS_DDL, "column": "line"}},
        {"name": "writer", "type": "table_sink", "input_queue": "parsed"}],
        [{"name": "raw", "capacity": 65536}, {"name": "parsed", "capacity": 65536}]))
    return run.sinks["writer"].select("record.*")


def enqueue_stamp(spark, d):
    """Every push of the runner stamps ``enqueue_ts``, here by event time: the
    source at it, the transform when it finishes (dwell + processing later)."""
    v = _payload_view(spark, d)
    run = run_flow(spark, _spec([
        {"name": "src", "type": "table_source", "output_queue": "q1", "config": {"table": v}},
        {"name": "t", "type": "noop_transform", "input_queue": "q1", "output_queue": "q2"},
        {"name": "out", "type": "table_sink", "input_queue": "q2"}], ["q1", "q2"]),
        clock=lambda s, rows: F.col("ts") if s["name"] == "src" else T.add_ms("ts", F.col("value") * 2))
    hops = [run.queues["q1"].select("event_id", F.lit("source").alias("hop"), "enqueue_ts"),
            run.sinks["out"].select("event_id", F.lit("transform").alias("hop"), "enqueue_ts")]
    return merge(hops)


FLOWS = {
    "seq_source": seq_source, "pass_through": pass_through, "text_sink": text_sink,
    "competing_split": competing_split, "fan_in": fan_in, "flow_simple_pipeline": flow_simple_pipeline,
    "flow_fanout": flow_fanout, "flow_job_mode": flow_job_mode, "custom_transform": custom_transform,
    "csv_ingest": csv_ingest, "enqueue_stamp": enqueue_stamp,
}
