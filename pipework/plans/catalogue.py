"""Named queries for spec-catalogue quality (C1-C15) over the whole
lineitem-derived spec table and the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipework.operators import history as H
from pipework.operators import quality as Q
from pipework.sources import fixtures as X
from pipework.sources.specfiles import parse_specs
from pipework.sources.tables import load

SNAPSHOT = "1997-01-01 00:00:00"   # previous spec version = lines shipped before this


def _specs(spark, d):
    return X.specs(spark, d)


def _both_sides(specs):
    """Normalised queues and stages as rows of one explode: the specs are built once."""
    side = lambda kind, col, cap: F.transform(col, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("long").alias("pos"), x["name"].alias("name"), cap(x).alias("capacity")))
    n = Q.normalize(specs)
    rows = F.concat(side("queue", "queues", lambda x: x["capacity"]), side("stage", "stages", lambda x: F.lit(None).cast("long")))
    return n.select("flow_id", F.explode(rows).alias("r")).select("flow_id", "r.*")


def spec_normalize(spark, d):
    s = _specs(spark, d)
    both = _both_sides(s)
    return both.select("flow_id", "kind", "pos", "name", "capacity")


def dq_not_null(spark, d):
    out = None
    for t in ("lineitem", "orders", "customer"):
        n = Q.null_counts(load(spark, d, t), t)
        out = n if out is None else out.unionByName(n)
    return out


def dq_required(spark, d):
    c = Q.required_counts(load(spark, d, "customer"), "customer", ["c_name", "c_mktsegment"])
    o = Q.required_counts(load(spark, d, "orders"), "orders", ["o_orderstatus", "o_orderpriority"])
    s = Q.required_counts(X.spec_lines(spark, d).withColumnRenamed("stage_type", "type"), "specs.stages",
                          ["stage_name", "type"])
    f = Q.required_counts(_specs(spark, d), "specs", ["name"])
    return c.unionByName(o).unionByName(s).unionByName(f)


def dq_non_empty(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    return Q.non_empty(o, load(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"])


def _lines(spark, d):
    return X.spec_lines(spark, d).withColumn("schema_id", X.queue_schema_id())


def dq_unique(spark, d):
    """Queue and stage names per flow, and line numbers per order, from one pass over the lines."""
    return Q.line_duplicates(_lines(spark, d), more={"lineitem": F.col("pos").cast("string")}).select("flow_id", "name", "n", "kind")


def dq_min_value(spark, d):
    st = Q.line_positions(_lines(spark, d)).withColumnRenamed("stage_name", "name")
    return Q.below_min(st, "threads", 1).select("flow_id", "pos", "name", "threads")


def dq_foreign_key(spark, d):
    own = Q.line_references(_lines(spark, d))
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_id"),
                                           F.col("l_linenumber").cast("long").alias("pos"), "l_partkey")
    fk = (Q.missing_reference(li, load(spark, d, "part"), ["l_partkey"], ["p_partkey"])
           .select("flow_id", "pos", F.col("l_partkey").cast("string").alias("queue"),
                   F.lit("lineitem.l_partkey").alias("side")))
    return own.unionByName(fk)


def dq_conditional(spark, d):
    q = Q.normalized_queues(_specs(spark, d))
    v = Q.conditional(q, F.col("schema_id").isNotNull(), F.col("schema_id") != "")
    return v.select("flow_id", "pos", "name", F.format_string(Q.MSG_SCHEMA_ID, F.col("name")).alias("message"))


def row_fingerprint(spark, d):
    o = load(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "o_orderdate", "o_orderpriority"]
    return o.select("o_orderkey", Q.fingerprint(cols).alias("fingerprint"))


def spec_fingerprint(spark, d):
    return Q.spec_fingerprint(_specs(spark, d))


def spec_diff(spark, d):
    """Previous version (lines shipped before SNAPSHOT, original names) vs
    current, both counted in ONE aggregation over the lines (exact distinct
    counts, planned as partial aggregations — no per-flow collect)."""
    lines = X.spec_lines(spark, d)
    prev = F.col("shipdate") < F.lit(SNAPSHOT).cast("timestamp_ntz")
    queue = F.struct("input_queue", "capacity", X.queue_schema_id().alias("schema_id"))
    per = lines.groupBy("flow_id", "flow").agg(
        F.count(F.when(prev, 1)).alias("a_s"),
        F.count(F.lit(1)).alias("b_s"),
        F.count_distinct(F.when(prev & F.col("declares_queue"), queue)).alias("a_q"),
        F.count_distinct(F.when(F.col("declares_queue"), queue)).alias("b_q"))
    pairs = per.where(F.col("a_s") > 0).select(
        "flow_id", F.concat(F.lit("f"), F.col("flow_id").cast("string")).alias("a_name"),
        F.col("flow").alias("b_name"), "a_q", "a_s", "b_q", "b_s")
    return Q.diff_lines(pairs)


def spec_version_diff(spark, d):
    """Diff lines between each version of a flow and the one before it (D1's chain): an
    order that puts a version has the spec of its lines."""
    queue = F.struct("input_queue", "capacity", "schema_id")
    sizes = _lines(spark, d).groupBy(F.col("flow_id").alias("seq")).agg(
        F.count_distinct(F.when(F.col("declares_queue"), queue)).alias("queues"), F.count(F.lit(1)).alias("stages"))
    named = sizes.withColumn("spec_name", F.concat(F.lit("spec_"), (F.col("seq") % 3).cast("string")))
    chain = H.version_chain(H.replay(X.oplog(spark, d)), named)
    return Q.diff_lines(chain, "name", "epoch", "version")


def json_roundtrip(spark, d):
    return Q.json_roundtrip(_specs(spark, d))


def spec_load(spark, d):
    """Specs rendered to FlowSpec JSON (every 50th with a stray field), then
    bulk-loaded back."""
    s = _specs(spark, d)
    queues = F.transform("queues", lambda q: F.struct(
        q["name"].alias("name"), q["capacity"].alias("capacity"),
        F.when(q["schema_id"].isNotNull(), F.struct(q["schema_id"].alias("schema_id"))).alias("schema")))
    js = F.to_json(F.struct("name", "stages", queues.alias("queues")))
    js = F.when(F.col("flow_id") % 50 == 0, F.concat(F.lit('{"extra":1,'), F.expr("substring(json0, 2)"))) \
          .otherwise(F.col("json0"))
    text = s.select("flow_id", F.to_json(F.struct("name", "stages", queues.alias("queues"))).alias("json0")) \
            .select("flow_id", js.alias("json"))
    p = parse_specs(text)
    return p.select("flow_id", F.col("spec.name").alias("name"), F.size("spec.stages").cast("long").alias("n_stages"),
                    F.size("spec.queues").cast("long").alias("n_queues"), "error")


def spec_validate(spark, d):
    return Q.validate(X.typed_specs(spark, d), kinds=X.STAGE_KINDS)


def spec_first_error(spark, d):
    return Q.first_error(X.typed_specs(spark, d), kinds=X.STAGE_KINDS)


def spec_validation_summary(spark, d):
    return Q.validation_summary(X.typed_specs(spark, d), kinds=X.STAGE_KINDS)


CATALOGUE = {
    "spec_normalize": spec_normalize, "dq_not_null": dq_not_null, "dq_required": dq_required,
    "dq_non_empty": dq_non_empty, "dq_unique": dq_unique, "dq_min_value": dq_min_value,
    "dq_foreign_key": dq_foreign_key, "dq_conditional": dq_conditional, "row_fingerprint": row_fingerprint,
    "spec_fingerprint": spec_fingerprint,
    "spec_diff": spec_diff, "spec_version_diff": spec_version_diff, "json_roundtrip": json_roundtrip, "spec_load": spec_load,
    "spec_validate": spec_validate, "spec_first_error": spec_first_error,
    "spec_validation_summary": spec_validation_summary,
}
