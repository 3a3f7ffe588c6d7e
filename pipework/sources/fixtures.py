"""Derived inputs built from the base tables.

Every derived input is a plain projection / aggregation of a base table, so
its size grows with the data and an independent SQL engine can rebuild it
(see ``pipework.plans.oracle``). No row is synthesised out of thin air.

Fixed values (the derivation rules themselves) are kept together here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipework.functions import time as T
from pipework.sources.tables import load

# --- fixed values: derivation rules -------------------------------------
API_SERVICE = "flow-api"
CONTROLLER_SERVICE = "flow-controller"
RUNTIME_SERVICE = "flow-runtime"
RPC_PREFIX = "/pipelines.v1.FlowService/"
QUEUE_SCHEMA_ID = "events"          # schema id declared on every event queue
LOG_EPOCH = "2024-01-01 00:00:00"   # logs: ts = LOG_EPOCH + doc_id minutes
N_FLOWS = 20                        # reconcile_log: flow_<user_id % 20>
# -------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k").cast("long")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Envelope rows: one payload per event."""
    e = events(spark, d)
    k = _k()
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.encode("props", "UTF-8").alias("payload"),
        F.octet_length("props").cast("long").alias("size"),
        F.col("ts").alias("enqueue_ts"),
        F.md5(F.col("user_id").cast("string")).alias("trace_id"),
        F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("span_id"),
        (k * 3).alias("flags"),
        F.when(F.col("event_type") == "click", F.lit(""))
         .when(F.col("event_type") == "error", F.lit("wrong"))
         .otherwise(F.lit(QUEUE_SCHEMA_ID)).alias("schema_id"),
        F.create_map(F.lit("k"), k.cast("string"),
                     F.lit("user"), F.col("user_id").cast("string")).alias("attrs"),
    )


def access_log(spark: SparkSession, d: str) -> DataFrame:
    """API access log: one HTTP (and gRPC) request per event."""
    e = events(spark, d)
    k = _k()
    return e.select(
        "ts", F.col("event_id").alias("request_id"), "user_id", "event_type",
        k.alias("k"),
        F.when(k % 2 == 0, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.concat(F.lit("/v1/"), F.col("event_type")).alias("route"),
        F.when(k % 20 == 0, F.lit(503)).when(k % 10 == 5, F.lit(404))
         .otherwise(F.lit(200)).cast("long").alias("status"),
        F.col("value").alias("latency_ms"),
        F.concat(F.lit(RPC_PREFIX), F.col("event_type")).alias("rpc_method"),
        F.lit(API_SERVICE).alias("service"),
    )


def reconcile_log(spark: SparkSession, d: str) -> DataFrame:
    """Controller reconcile attempts: one per access_log row."""
    a = access_log(spark, d)
    return a.select(
        "ts", "request_id",
        F.concat(F.lit("flow_"), (F.col("user_id") % N_FLOWS).cast("string")).alias("flow_name"),
        (F.col("status") < 500).alias("ok"),
        F.col("latency_ms").alias("duration_ms"),
        F.lit(CONTROLLER_SERVICE).alias("service"),
    )


def work_log(spark: SparkSession, d: str) -> DataFrame:
    """Controller work-queue operations: ``get`` for views, else ``add``."""
    e = events(spark, d)
    return e.select(
        "ts", F.col("event_id").alias("seq"), F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "view", F.lit("get")).otherwise(F.lit("add")).alias("op"),
    )


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Log records: whole document text as the message."""
    doc = load(spark, d, "documents")
    return doc.select(
        (F.lit(LOG_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id"))).alias("ts"),
        F.col("source").alias("service"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("error")).otherwise(F.lit("info")).alias("severity"),
        F.col("text").alias("message"),
        F.col("doc_id"),
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    """One span per payload; parent = previous span of the same trace."""
    from pipework.operators.scan import hour_chunk, ordered_scan
    p = payloads(spark, d).select("trace_id", "span_id", "event_type", "ts", "value", "event_id")
    return _span(ordered_scan(p, ["trace_id"], ["ts", "event_id"], hour_chunk("ts"),
                              prevs={"parent_span_id": F.col("span_id")}), "parent_span_id")


def span_times(spark: SparkSession, d: str) -> DataFrame:
    """The same spans without their parents: a plain projection."""
    return _span(payloads(spark, d))


def _span(p: DataFrame, *parent: str) -> DataFrame:
    return p.select(
        "trace_id", "span_id", *parent,
        F.lit("stage.process").alias("name"),
        F.col("event_type").alias("service"),
        F.col("ts").alias("start_ts"),
        T.add_ms("ts", F.col("value")).alias("end_ts"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        "event_id",
    )


def oplog(spark: SparkSession, d: str) -> DataFrame:
    """Flow-version operations from orders: O → put, P → delete,
    F → rollback to 1 + o_orderkey % 3. Ordered by (ts, seq)."""
    o = load(spark, d, "orders")
    return o.select(
        F.concat(F.lit("flow_"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", F.lit("put"))
         .when(F.col("o_orderstatus") == "P", F.lit("delete"))
         .otherwise(F.lit("rollback")).alias("op"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 3 + 1)).alias("version"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("spec"),
    )


def kv_log(spark: SparkSession, d: str) -> DataFrame:
    """Key-value store change log from orders, dealt over the thirty days of the
    events (one order a second, no two at once): status keys, active pointers
    (a version, or a text for every 29th) and ``versions/<n>/spec`` keys."""
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    version = (1 + F.floor(k / 4) % 3).cast("string")
    leaf = (F.when(k % 4 == 0, F.lit("/status")).when(k % 4 == 1, F.lit("/active"))
             .otherwise(F.concat(F.lit("/versions/"), version, F.lit("/spec"))))
    value = (F.when(k % 4 != 1, F.floor("o_totalprice").cast("string"))
              .when(k % 29 == 0, F.lit("latest")).otherwise(version))
    return o.select(
        F.expr("timestampadd(SECOND, CAST((o_orderkey * 7919) % 2592000 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
        k.alias("rev"),
        F.concat(F.lit("/pipelines/flows/flow_"), F.col("o_custkey").cast("string"), leaf).alias("key"),
        F.when(F.col("o_orderstatus") == "P", F.lit("delete")).otherwise(F.lit("put")).alias("op"),
        F.when(F.col("o_orderstatus") != "P", value).alias("value"),
    )


def upsert_requests(spark: SparkSession, d: str) -> DataFrame:
    """Create and update requests from orders: even keys create, every seventh spec has no name."""
    o = load(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("create")).otherwise(F.lit("update")).alias("op"),
        F.concat(F.lit("flow_"), F.col("o_custkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("spec_"), (F.col("o_orderkey") % 100).cast("string"))).alias("spec_name"))


def spec_lines(spark: SparkSession, d: str) -> DataFrame:
    """Flat stage/queue declarations derived from lineitem (one per line)."""
    li = load(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("flow_id"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("f"), F.col("l_orderkey").cast("string"))).alias("flow"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("s"), (F.col("l_partkey") % 50).cast("string")).alias("stage_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.col("l_returnflag")).alias("stage_type"),
        (F.col("l_quantity").cast("long") % 4).alias("threads"),
        F.concat(F.lit("q"), (F.col("l_suppkey") % 10).cast("string")).alias("input_queue"),
        F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit("q"), ((F.col("l_suppkey") + 1) % 10).cast("string"))).alias("output_queue"),
        (F.col("l_linenumber") % 5 != 0).alias("declares_queue"),
        ((F.col("l_linenumber") % 3) * 64).cast("long").alias("capacity"),
        F.col("l_shipdate").alias("shipdate"),
    )


def specs(spark: SparkSession, d: str) -> DataFrame:
    """One nested flow spec per order.

    Arrays are bounded by lines per order, so ``collect_list`` per key is a
    small aggregation (of one order each, not combined map-side)."""
    return specs_from_lines(spec_lines(spark, d))


#: Kinds of the stage types that spec lines have ("" is no type).
STAGE_KINDS = {"A": "source", "N": "transform"}


def typed_specs(spark: SparkSession, d: str) -> DataFrame:
    """:func:`specs` whose queues say a type: q7 a kind that no runtime has, q8 none, the others in memory."""
    kind = lambda q: F.when(q["name"] == "q7", F.lit("QUEUE_TYPE_DURABLE")).when(q["name"] != "q8", F.lit("QUEUE_TYPE_IN_MEMORY"))
    return specs(spark, d).withColumn("queues", F.transform("queues", lambda q: q.withField("type", kind(q))))


def queue_schema_id():
    """Queue schema of a spec line: '' (declared but empty) for line % 4 = 0,
    'orders' for line % 4 = 1, none otherwise."""
    return F.when(F.col("pos") % 4 == 0, F.lit("")).when(F.col("pos") % 4 == 1, F.lit("orders"))


def specs_from_lines(s: DataFrame) -> DataFrame:
    """Nest flat spec lines into one FlowSpec-shaped row per flow."""
    stages = F.struct(
        F.col("stage_name").alias("name"), F.col("stage_type").alias("type"),
        F.col("threads"), F.col("input_queue"), F.col("output_queue"), F.col("pos"))
    queue = F.struct(
        F.col("input_queue").alias("name"), F.col("capacity"),
        queue_schema_id().alias("schema_id"), F.col("pos"))
    grouped = s.groupBy("flow_id", "flow").agg(
        F.array_sort(F.collect_list(stages)).alias("stages"),
        F.array_sort(F.collect_list(F.when(F.col("declares_queue"), queue))).alias("queues"))
    return grouped.select(
        "flow_id", F.col("flow").alias("name"),
        F.transform("stages", lambda x: x.dropFields("pos")).alias("stages"),
        F.array_distinct(F.transform("queues", lambda x: x.dropFields("pos"))).alias("queues"),
    )


# --- fixed values: registry derivation -----------------------------------
FORMAT_SPELLINGS = ("json", " Apache-Arrow ", "proto", "FlatBuffer", "protobuf", "arrow", "xml", "")
# -------------------------------------------------------------------------


def schema_ops(spark: SparkSession, d: str) -> DataFrame:
    """Schema registry op log from part: one create per part under schema id
    ``p_brand`` (ordered by p_partkey); parts with p_size % 13 = 0 delete the
    id instead. Format spelled by p_partkey % 8, payload = p_type."""
    p = load(spark, d, "part")
    spell = F.element_at(F.array(*[F.lit(s) for s in FORMAT_SPELLINGS]),
                         (F.col("p_partkey") % len(FORMAT_SPELLINGS) + 1).cast("int"))
    return p.select(
        F.col("p_brand").alias("schema_id"),
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 13 == 0, F.lit("delete")).otherwise(F.lit("put")).alias("op"),
        spell.alias("format"),
        F.col("p_type").alias("raw_schema"),
    )


def schema_refs(spark: SparkSession, d: str) -> DataFrame:
    """Queue schema references: (p_brand, p_size % 4), 0 = active."""
    p = load(spark, d, "part")
    return p.select(F.col("p_brand").alias("schema_id"),
                    (F.col("p_size") % 4).cast("long").alias("version")).distinct()


def version_texts(spark: SparkSession, d: str) -> DataFrame:
    """Version strings as typed by users: p_size - 3 as text, or the brand
    name for every fifth part (not a number)."""
    p = load(spark, d, "part")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand"))
                    .otherwise((F.col("p_size") - 3).cast("string")).alias("text"))
