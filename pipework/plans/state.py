"""Named queries for versioned history (D), the schema registry and gates
(B), envelope metadata and scalar helpers (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipework.functions import attrs as A
from pipework.functions import scalars as S
from pipework.operators import history as H
from pipework.operators import registry as R
from pipework.operators import schema_gate as G
from pipework.sources import fixtures as X
from pipework.sources.tables import load

SNAPSHOT = "1998-01-01 00:00:00"   # deployed state = history before this instant


def _flows(spark, d, oplog=None):
    op = oplog if oplog is not None else X.oplog(spark, d)
    return H.flow_list(H.current_versions(H.replay(op)))


def _status(spark, d):
    return H.latest_status(X.reconcile_log(spark, d))


# D ------------------------------------------------------------------------
def history_replay(spark, d):
    return H.current_versions(H.replay(X.oplog(spark, d)))


def history_replay_pointer(spark, d):
    return H.replay_pointer(X.oplog(spark, d))


def rollback_errors(spark, d):
    return H.rollback_errors(H.replay(X.oplog(spark, d)))


def flow_list(spark, d):
    return _flows(spark, d)


def flow_summaries(spark, d):
    return H.flow_summaries(_flows(spark, d), _status(spark, d))


def flow_get(spark, d):
    req = load(spark, d, "customer").select(F.concat(F.lit("flow_"), F.col("c_custkey").cast("string")).alias("name"))
    return H.flow_get(req, X.kv_log(spark, d), _status(spark, d))


def watch_events(spark, d):
    return H.watch_events(X.kv_log(spark, d)).select("rev", "flow", "event_type", "version", "spec")


def flow_upsert(spark, d):
    return H.upserts(X.upsert_requests(spark, d)).select("seq", "op", "target", "error")


def watch_event_counts(spark, d):
    return H.watch_event_counts(H.watch_events(X.kv_log(spark, d)))


def coalesced_lag(spark, d):
    lag = H.coalesced_lag(X.work_log(spark, d))
    return lag.select("key", "seq", "ts", F.round("lag_s", 6).alias("lag_s"))


def desired_state_plan(spark, d):
    replayed = H.replay(X.oplog(spark, d))   # the snapshot is a prefix of the same log
    desired = H.flow_list(H.current_versions(replayed))
    actual = H.flows_as_of(replayed, F.col("ts") < F.lit(SNAPSHOT).cast("timestamp_ntz"))
    render = lambda f: f.withColumn("rendered", F.col("spec").cast("decimal(18,2)").cast("string"))
    return H.desired_state_plan(render(desired), render(actual), rendered="rendered")


def latest_status(spark, d):
    return H.latest_status(X.reconcile_log(spark, d), X.kv_log(spark, d))


# B ------------------------------------------------------------------------
def _registry(spark, d):
    return R.current(R.replay(X.schema_ops(spark, d)))


def schema_create(spark, d):
    return R.created_versions(R.replay(X.schema_ops(spark, d)))


def schema_create_errors(spark, d):
    return R.create_errors(X.schema_ops(spark, d))


def schema_get(spark, d):
    p = load(spark, d, "part")
    req = p.select(F.col("p_brand").alias("schema_id"), (F.col("p_size") % 3 + 1).cast("long").alias("version")).distinct()
    return R.get(_registry(spark, d), req).select("schema_id", "requested_version", "version", "format", "result")


def schema_active(spark, d):
    v = _registry(spark, d)
    req = v.select("schema_id").distinct().withColumn("version", F.lit(0).cast("long"))
    return R.get(v, req).select("schema_id", "version", "format", "raw_schema")


def schema_resolve(spark, d):
    return R.resolve(X.schema_refs(spark, d), _registry(spark, d))


def schema_list(spark, d):
    return R.list_versions(_registry(spark, d))


def schema_history(spark, d):
    return _registry(spark, d)


def schema_stamp(spark, d):
    s = G.stamp_output(X.payloads(spark, d), X.QUEUE_SCHEMA_ID)
    return s.select("event_id", "schema_id")


def schema_gate(spark, d):
    return G.gate_input(X.payloads(spark, d), X.QUEUE_SCHEMA_ID).select("event_id", "schema_id")


def schema_rejects(spark, d):
    r = G.rejects(X.payloads(spark, d), X.QUEUE_SCHEMA_ID, queue="events")
    return r.select("event_id", "queue", "expected_schema_id", "reason")


def schema_pipeline(spark, d):
    """Source stamps queue ``events`` → pass-through transform → queue
    ``events_normalized``. Inheriting the id drops everything (reference
    behaviour); ``set_schema`` delivers every admitted row."""
    src = G.stamp_output(X.payloads(spark, d), X.QUEUE_SCHEMA_ID)
    inherit = G.gated_transform(src, X.QUEUE_SCHEMA_ID, "events_normalized")
    fixed = G.gated_transform(src, X.QUEUE_SCHEMA_ID, "events_normalized", set_schema=True)
    return (inherit.select("event_id", "schema_id", F.lit("inherit").alias("mode"))
            .unionByName(fixed.select("event_id", "schema_id", F.lit("set_schema").alias("mode"))))


# G ------------------------------------------------------------------------
def attr_get(spark, d):
    p = X.payloads(spark, d)
    return p.select("event_id", A.attr_get("attrs", "k", "bigint").alias("k"),
                    A.attr_get("attrs", "tenant").alias("tenant"))


def attr_set(spark, d):
    p = X.payloads(spark, d)
    doubled = A.attr_get("attrs", "k", "bigint") * 2
    new = A.attr_set(A.attr_set("attrs", "k", doubled), "tenant", "acme")
    return p.select("event_id", A.attr_get("attrs", "k", "bigint").alias("k_before"),
                    A.attr_get(new, "k", "bigint").alias("k_after"),
                    A.attr_get(new, "tenant").alias("tenant"), F.size(new).alias("n_attrs"))


def attr_erase(spark, d):
    p = X.payloads(spark, d)
    one = A.attr_erase("attrs", "k")
    two = A.attr_erase(one, "user")
    return p.select("event_id", A.attr_found("attrs", "k").alias("found_k"),
                    A.attr_found(one, "k").alias("found_k_again"),
                    F.size(one).alias("n_after_one"), two.isNull().alias("null_after_two"))


def attr_typed(spark, d):
    """G1-G3 on typed maps: four types set, one replaced by another type, one erased, read back."""
    p = X.payloads(spark, d)
    m = A.typed_set(A.typed_attrs("attrs"), "partition", F.col("event_id") % 16, "bigint")
    m = A.typed_set(m, "value", F.col("value"), "double")
    m = A.typed_set(m, "failed", F.col("event_type") == "error", "boolean")
    m = A.typed_set(m, "k", A.attr_get("attrs", "k", "bigint"), "bigint")
    one = p.select("event_id", A.attr_erase(m, "user").alias("m"))
    return one.select(
        "event_id", A.typed_get("m", "partition", "bigint").alias("partition"), A.typed_get("m", "value", "double").alias("value"),
        A.typed_get("m", "failed", "boolean").alias("failed"), A.typed_get("m", "k", "bigint").alias("k"),
        A.typed_get("m", "k", "string").alias("k_as_string"), A.attr_type("m", "k").alias("k_type"),
        A.attr_type("m", "user").alias("user_type"), F.size("m").alias("n_attrs"))


def attr_has(spark, d):
    p = X.payloads(spark, d)
    m = F.when(F.col("event_type") == "view", A.clear_attrs()).otherwise(F.col("attrs"))
    return p.select("event_id", A.has_attrs(m).alias("has_attrs"))


def has_trace(spark, d):
    p = X.payloads(spark, d)
    t = F.when(F.col("user_id") % 10 == 0, F.lit(A.ZERO_TRACE)).otherwise(F.col("trace_id"))
    return p.select("event_id", A.has_trace(t).alias("has_trace"))


def is_empty(spark, d):
    p = X.payloads(spark, d)
    return p.select("event_id", A.is_empty("payload", "size").alias("is_empty"),
                    A.has_schema_id("schema_id").alias("has_schema_id"))


def flag_bits(spark, d):
    p = X.payloads(spark, d)
    return p.select("event_id", "flags", A.trace_flags("flags").alias("trace_flags"))


def key_parse(spark, d):
    kv = X.kv_log(spark, d)
    return kv.select("rev", "key", S.key_name("key").alias("name"), S.key_leaf("key").alias("leaf"),
                     S.version_key(S.key_name("key"), F.lit(1)).alias("version_key"))


def format_alias(spark, d):
    ops = X.schema_ops(spark, d)
    return ops.select("seq", "format", S.format_alias("format").alias("canonical"),
                      S.format_error("format").alias("error"))


def version_parse(spark, d):
    v = X.version_texts(spark, d)
    return v.select("p_partkey", "text", S.version_parse("text").alias("version"),
                    S.version_error("text").alias("error"))


STATE = {
    "history_replay": history_replay, "history_replay_pointer": history_replay_pointer,
    "rollback_errors": rollback_errors, "flow_list": flow_list, "flow_summaries": flow_summaries,
    "flow_get": flow_get, "flow_upsert": flow_upsert, "watch_events": watch_events, "watch_event_counts": watch_event_counts,
    "coalesced_lag": coalesced_lag, "desired_state_plan": desired_state_plan, "latest_status": latest_status,
    "schema_create": schema_create, "schema_create_errors": schema_create_errors,
    "schema_get": schema_get, "schema_active": schema_active,
    "schema_resolve": schema_resolve, "schema_list": schema_list, "schema_history": schema_history,
    "schema_stamp": schema_stamp, "schema_gate": schema_gate, "schema_rejects": schema_rejects,
    "schema_pipeline": schema_pipeline,
    "attr_get": attr_get, "attr_set": attr_set, "attr_erase": attr_erase, "attr_typed": attr_typed, "attr_has": attr_has,
    "has_trace": has_trace, "is_empty": is_empty, "flag_bits": flag_bits,
    "key_parse": key_parse, "format_alias": format_alias, "version_parse": version_parse,
}
