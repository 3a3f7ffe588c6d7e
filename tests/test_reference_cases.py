"""Small cases read from the reference's own tests (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

from pipework.functions import attrs as A
from pipework.operators import history as H
from pipework.operators import quality as Q
from pipework.operators import registry as R
from pipework.operators import schema_gate as G
from pipework.operators.flow import run_flow
from pipework.operators.stages import sequence_rows  # noqa: F401 (registers stages)

ENV = "event_id long, schema_id string, flags long, attrs map<string,string>, payload binary, size long"


def _env(spark, rows):
    return spark.createDataFrame(rows, ENV)


def test_stamp_empty_id(spark):
    df = _env(spark, [(1, "", 0, None, b"x", 1)])
    out = G.stamp_output(df, "schema-1").collect()
    assert [(r.event_id, r.schema_id) for r in out] == [(1, "schema-1")]


def test_output_mismatch_dropped(spark):
    df = _env(spark, [(1, "schema-wrong", 0, None, b"x", 1)])
    assert G.stamp_output(df, "schema-correct").count() == 0
    rej = G.rejects(df, "schema-correct", stage_input=False).collect()
    assert rej[0].reason == G.MISMATCH


def test_input_missing_and_mismatch(spark):
    df = _env(spark, [(1, "", 0, None, b"x", 1), (2, "schema-wrong", 0, None, b"x", 1),
                      (3, None, 0, None, b"x", 1), (4, "schema-a", 0, None, b"x", 1)])
    assert [r.event_id for r in G.gate_input(df, "schema-a").collect()] == [4]
    reasons = {r.event_id: r.reason for r in G.rejects(df, "schema-a").collect()}
    assert reasons == {1: G.MISSING, 2: G.MISMATCH, 3: G.MISSING}


def test_metadata_kept_through_transform(spark):
    df = _env(spark, [(1, "schema-1", 7, {"partition": "5"}, b"x", 1)])
    out = G.gated_transform(df, "schema-1", "schema-1", fn=lambda d: d).collect()[0]
    assert (out.flags, out.schema_id, out.attrs["partition"]) == (7, "schema-1", "5")


def test_schema_inheritance_drops_everything(spark):
    df = _env(spark, [(i, "trade", 0, None, b"x", 1) for i in range(10)])
    assert G.gated_transform(df, "trade", "trade_normalized").count() == 0
    assert G.gated_transform(df, "trade", "trade_normalized", set_schema=True).count() == 10


def test_typed_attrs_keep_their_types(spark):
    """int64, double, bool and string survive set, get, copy and erase; a read of another type is null."""
    df = spark.createDataFrame([({"s": "3"},), (None,)], "attrs map<string,string>")
    m = A.typed_attrs("attrs")
    for key, value, kind in (("i", 2**62, "bigint"), ("d", 3.0, "double"), ("b", False, "boolean"), ("t", "true", "string")):
        m = A.typed_set(m, key, value, kind)
    m2 = A.attr_erase(A.typed_set(m, "i", "now text", "string"), "d")
    r = df.select(m.alias("m"), m2.alias("m2")).select(
        *[A.attr_type("m", k).alias("type_" + k) for k in "idbts"], A.typed_get("m", "i", "bigint").alias("i"), A.typed_get("m", "d", "double").alias("d"),
        A.typed_get("m", "b", "boolean").alias("b"), A.typed_get("m", "t", "string").alias("t"), A.typed_get("m", "t", "boolean").alias("no_bool"),
        A.typed_get("m", "d", "bigint").alias("no_int"), A.typed_get("m2", "i", "string").alias("i2"), A.attr_found("m2", "d").alias("d2"),
        F.size("m2").alias("n2")).collect()
    assert [(x.type_i, x.type_d, x.type_b, x.type_t) for x in r] == [("BIGINT", "DOUBLE", "BOOLEAN", "STRING")] * 2
    assert [x.type_s for x in r] == ["STRING", None]
    assert all((x.i, x.d, x.b, x.t, x.no_bool, x.no_int, x.i2, x.d2) == (2**62, 3.0, False, "true", None, None, "now text", False) for x in r)
    assert [x.n2 for x in r] == [4, 3]
    with pytest.raises(ValueError):
        A.typed_set(m, "x", 1, "date")


def test_attr_copy_on_write_and_erase(spark):
    df = spark.createDataFrame([({"pipeline.partition": "3"},)], "attrs map<string,string>")
    r = df.select("attrs", A.attr_set("attrs", "pipeline.partition", 8).alias("copy")).collect()[0]
    assert r.attrs["pipeline.partition"] == "3" and r.copy["pipeline.partition"] == "8"
    df2 = spark.createDataFrame([({"a": "1", "b": "2"},)], "attrs map<string,string>")
    one = A.attr_erase("attrs", "a")
    r = df2.select(A.attr_found("attrs", "a").alias("fa"), A.attr_erase(one, "b").alias("m"),
                   A.attr_found(A.attr_erase(one, "b"), "b").alias("missing")).collect()[0]
    assert r.fa is True and r.m is None and r.missing is False


def test_sequence_source_and_threads(spark):
    spec = {"queues": [{"name": "q1", "capacity": 256}],
            "stages": [{"name": "source", "type": "noop_source", "threads": 2, "output_queue": "q1",
                        "config": {"message": "DEADBEEF", "max_messages": 20, "delay_ms": 200}},
                       {"name": "sink", "type": "stdout_sink", "input_queue": "q1"}]}
    lines = [r.value for r in run_flow(spark, spec).sinks["sink"].collect()]
    assert len(lines) == 40 and len(set(lines)) == 20
    assert set(lines) == {f"DEADBEEF #{i}" for i in range(20)}


def test_fanout_disjoint_and_complete(spark):
    spec = {"queues": [{"name": "q_in", "capacity": 512}, {"name": "q_a", "capacity": 256},
                       {"name": "q_b", "capacity": 256}],
            "stages": [{"name": "source", "type": "noop_source", "output_queue": "q_in",
                        "config": {"message": "FOOBAR", "max_messages": 20}},
                       {"name": "transform_a", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_a"},
                       {"name": "transform_b", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_b"},
                       {"name": "sink_a", "type": "stdout_sink", "input_queue": "q_a"},
                       {"name": "sink_b", "type": "stdout_sink", "input_queue": "q_b"}]}
    run = run_flow(spark, spec)
    a = [r.value for r in run.sinks["sink_a"].collect()]
    b = [r.value for r in run.sinks["sink_b"].collect()]
    assert len(a) + len(b) == 20 and not set(a) & set(b) and a and b


def test_schema_sample_flow_counters(spark):
    rows = [(i, "", 0, None, b'{"trade_id":"t-123"}', 20) for i in range(10)]
    _env(spark, rows).createOrReplaceTempView("t_trades")
    spec = {"queues": [{"name": "trade", "capacity": 128, "schema": {"schema_id": "trade"}},
                       {"name": "trade_normalized", "capacity": 128, "schema": {"schema_id": "trade_normalized"}}],
            "stages": [{"name": "source", "type": "table_source", "output_queue": "trade", "config": {"table": "t_trades"}},
                       {"name": "normalize", "type": "noop_transform", "input_queue": "trade",
                        "output_queue": "trade_normalized"},
                       {"name": "sink", "type": "stdout_sink", "input_queue": "trade_normalized"}]}
    run = run_flow(spark, spec)
    m = {r.stage_name: r for r in run.metrics().collect()}
    assert (m["normalize"].dequeue, m["normalize"].process, m["normalize"].error, m["normalize"].enqueue) == (10, 10, 10, 0)
    assert run.sinks["sink"].count() == 0
    # invariants: dequeue = process + input errors; process = enqueue + output errors
    t = m["normalize"]
    assert t.process == t.enqueue + t.error


def _specs(spark, flows):
    schema = ("flow_id long, name string, "
              "stages array<struct<name:string,type:string,threads:long,input_queue:string,output_queue:string>>, "
              "queues array<struct<name:string,capacity:long,schema_id:string>>")
    return spark.createDataFrame(flows, schema)


def test_normalise(spark):
    df = _specs(spark, [(1, "f", [("b", "t", 1, None, None), ("a", "t", 1, None, None)],
                         [("z", 0, None), ("a", 256, None), ("m", None, None)])])
    q = [(r.name, r.capacity) for r in Q.normalized_queues(df).orderBy("pos").collect()]
    assert q == [("a", 256), ("m", 128), ("z", 128)]
    s = [r.name for r in Q.normalized_stages(df).orderBy("pos").collect()]
    assert s == ["a", "b"]


def test_validation_messages(spark):
    df = _specs(spark, [
        (1, "", [("s", "t", 1, None, None)], []),
        (2, "f", [], []),
        (3, "f", [("s", "t", 1, None, None)], [("q", 1, None), ("q", 2, None)]),
        (4, "f", [("s", "", 1, None, None)], []),
        (5, "f", [("s", "t", 1, "nope", "gone")], []),
        (6, "f", [("stage", "t", 0, None, None), ("stage", "t", 0, None, None)], []),
    ])
    first = {r.flow_id: (r.field, r.message) for r in Q.first_errors(Q.validate(df)).collect()}
    assert first[1] == ("name", "flow name is required")
    assert first[2] == ("stages", "flow must contain at least one stage")
    assert first[3] == ("queues.name", 'duplicate queue name "q"')
    assert first[4] == ("stages.type", 'stage "s" missing type')
    assert first[5] == ("stages.input_queue", 'stage "s" references unknown input queue "nope"')
    # the code (not the stale test) reports the threads error before the duplicate
    assert first[6] == ("stages.threads", 'stage "stage" must declare at least one thread')


def test_diff(spark):
    a = _specs(spark, [(1, "a", [("s", "t", 1, None, None)], [("q", 1, None)])])
    b = _specs(spark, [(1, "b", [("s", "t", 1, None, None), ("s2", "t", 1, None, None)],
                        [("q", 1, None), ("q2", 1, None)])])
    lines = sorted(r.change for r in Q.diff(a, b).collect())
    assert lines == ['name: "a" → "b"', "queues: 1 → 2", "stages: 1 → 2"]


def test_registry_lifecycle(spark):
    ops = spark.createDataFrame([("orders", 1, "put", "json", '{"type":"object"}'),
                                 ("orders", 2, "put", "json", '{"type":"object","version":2}')],
                                "schema_id string, seq long, op string, format string, raw_schema string")
    cur = R.current(R.replay(ops))
    assert sorted((r.version, r.is_active) for r in cur.collect()) == [(1, False), (2, True)]
    act = R.get(cur, spark.createDataFrame([("orders", 0)], "schema_id string, version long")).collect()
    assert act[0].version == 2
    deleted = ops.unionByName(spark.createDataFrame([("orders", 3, "delete", None, None)], ops.schema))
    assert R.current(R.replay(deleted)).count() == 0
    again = deleted.unionByName(spark.createDataFrame([("orders", 4, "put", "proto", "x")], ops.schema))
    assert [r.version for r in R.current(R.replay(again)).collect()] == [1]


KV = "ts string, rev long, key string, op string, value string"


def _kv(spark, rows):
    """(rev, key below the flow's folder, value; None deletes)"""
    out = [("2024-01-01 00:%02d:%02d" % divmod(rev, 60), rev, f"/pipelines/flows/{key}", "delete" if v is None else "put", v) for rev, key, v in rows]
    return spark.createDataFrame(out, KV).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("heavy", [None, 0])
def test_watch_events(spark, heavy):
    kv = _kv(spark, [
        (1, "a/versions/1/spec", "one"), (2, "a/active", "1"), (3, "a/versions/1/spec", "one again"), (4, "a/active", "01"),
        (5, "a/versions/1/spec", None), (6, "a/active", "1"), (7, "a/active", "2"), (8, "a/versions/2/spec", "two, too late"),
        (9, "a/active", None), (10, "a/active", None), (11, "a/active", "latest"), (12, "a/active", "2"), (13, "a/status", "x"),
        (14, "b/active", "-1"), (15, "b/active", ""), (16, "b/active", "18446744073709551616"), (17, "b/versions/2/spec", "b two"), (18, "b/active", "2"),
        (19, "b/versions/02/spec", "never looked up"), (20, "c/active", None)])
    ev = [(r.rev, r.event_type, r.flow, r.version, r.spec) for r in H.watch_events(kv, heavy).orderBy("rev").collect()]
    assert ev == [(2, "ADDED", "a", 1, "one"), (4, "UPDATED", "a", 1, "one again"), (6, "UPDATED", "a", 1, None), (7, "UPDATED", "a", 2, None),
                  (9, "DELETED", "a", None, None), (12, "UPDATED", "a", 2, "two, too late"), (18, "UPDATED", "b", 2, "b two")]


@pytest.mark.parametrize("heavy", [None, 0])
def test_status_holds_the_version_of_its_reconcile(spark, heavy):
    kv = _kv(spark, [(10, "a/versions/1/spec", "one"), (20, "a/active", "1"), (30, "a/versions/2/spec", "two"), (40, "a/active", "2"), (50, "a/versions/2/spec", None),
                     (10, "b/active", "7"), (10, "c/versions/1/spec", "x"), (20, "c/active", "1"), (30, "c/active", None)])
    rec = spark.createDataFrame([("a", 15, True), ("a", 20, True), ("a", 35, True), ("a", 45, False), ("a", 55, True), ("b", 60, True), ("c", 25, True), ("c", 60, True), ("d", 60, True)],
                                "flow_name string, at int, ok boolean")
    rec = rec.withColumn("ts", F.expr("timestampadd(SECOND, at, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    got = {r.name: (r.active_version, r.last_updated.minute * 60 + r.last_updated.second) for r in H.latest_status(rec, kv, heavy_rows=heavy).collect()}
    assert got == {"a": (1, 35), "c": (1, 25)}


def test_get_reports_the_stores_errors(spark):
    kv = _kv(spark, [(1, "a/versions/1/spec", "one"), (2, "a/active", "1"), (3, "b/active", "4"), (4, "c/active", "v1"), (5, "d/active", "1"), (6, "d/active", None)])
    req = spark.createDataFrame([(n,) for n in "abcdda"], "name string")
    st = spark.createDataFrame([("a", "UP", "a-runtime"), ("b", "UP", "b-runtime")], "name string, state string, workload string")
    got = {r.name: (r.active_version, r.spec, r.state, r.result) for r in H.flow_get(req, kv, st).collect()}
    assert got == {"a": (1, "one", "UP", "ok"), "b": (None, None, None, 'spec missing for "b" version 4'), "c": (None, None, None, "invalid active version"),
                   "d": (None, None, None, 'flow "d" not found')}


def test_upsert_names(spark):
    r = spark.createDataFrame([(1, "create", "arg", "own"), (2, "create", "arg", ""), (3, "create", "arg", None), (4, "update", "arg", "own"), (5, "update", "arg", None)],
                              "seq int, op string, name string, spec_name string")
    got = {x.seq: (x.target, x.error) for x in H.upserts(r).collect()}
    assert got == {1: ("own", None), 2: (None, "flow name is required"), 3: (None, "flow name is required"), 4: ("arg", None), 5: ("arg", None)}


def test_rollback_rules(spark):
    ops = spark.createDataFrame([
        ("f", 1, "put", None, 1.0), ("f", 2, "put", None, 2.0), ("f", 3, "put", None, 3.0),
        ("f", 4, "rollback", 1, None), ("f", 5, "put", None, 5.0)],
        "name string, seq long, op string, version long, spec double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    imm = {r.version: (r.spec, r.is_active) for r in H.current_versions(H.replay(ops)).collect()}
    assert imm[4] == (5.0, True) and len(imm) == 4
    ptr = {r.version: (r.spec, r.is_active) for r in H.replay_pointer(ops).collect()}
    assert ptr[2] == (5.0, True) and sorted(ptr) == [1, 2, 3]
    bad = ops.unionByName(spark.createDataFrame([("f", 6, "rollback", 9, None)], ops.drop("ts").schema)
                          .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    errs = H.rollback_errors(H.replay(bad)).collect()
    assert [e.error for e in errs] == ["version 9 does not exist"]


def test_shared_queue_checkpointed_once(spark):
    spec = {"queues": [{"name": "q_in", "capacity": 8}, {"name": "q_a", "capacity": 8}, {"name": "q_b", "capacity": 8}],
            "stages": [{"name": "source", "type": "noop_source", "output_queue": "q_in",
                        "config": {"message": "M", "max_messages": 50}},
                       {"name": "a", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_a"},
                       {"name": "b", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_b"},
                       {"name": "sink_a", "type": "stdout_sink", "input_queue": "q_a"},
                       {"name": "sink_b", "type": "stdout_sink", "input_queue": "q_b"}]}
    run = run_flow(spark, spec, share_queues=True)
    a = {r.value for r in run.sinks["sink_a"].collect()}
    b = {r.value for r in run.sinks["sink_b"].collect()}
    assert len(a) + len(b) == 50 and not a & b and a and b   # split, disjoint, complete


def test_runtime_rules_on_a_table_of_specs_and_on_one(spark):
    """The catalogue and the runner say the same of queue types, capacities and wiring."""
    import pytest as pt
    from pipework.operators.flow import FlowError, check_spec
    kinds = {"noop_source": "source", "noop_transform": "transform", "stdout_sink": "sink"}
    good = ([("q", 8, None, "QUEUE_TYPE_IN_MEMORY"), ("r", 1, "s", None)],
            [("a", "noop_source", 1, None, "q"), ("b", "noop_transform", 1, "q", "r"), ("c", "stdout_sink", 1, "r", None)])
    bad = {
        "queue capacity must be > 0: q": lambda q, s: (q.__setitem__(0, ("q", 0, None, None))),
        "queue schema_id is required: r": lambda q, s: (q.__setitem__(1, ("r", 1, "", None))),
        "unsupported queue type for queue: r": lambda q, s: (q.__setitem__(1, ("r", 1, None, "QUEUE_TYPE_KAFKA"))),
        "invalid source stage wiring: a": lambda q, s: (s.__setitem__(0, ("a", "noop_source", 1, "q", "q"))),
        "invalid transform stage wiring: b": lambda q, s: (s.__setitem__(1, ("b", "noop_transform", 1, "q", None))),
        "invalid sink stage wiring: c": lambda q, s: (s.__setitem__(2, ("c", "stdout_sink", 1, "r", "q"))),
    }
    rows, want = [(0, "f", *good)], {}
    for i, (message, change) in enumerate(bad.items(), 1):
        q, s = list(good[0]), list(good[1])
        change(q, s)
        rows.append((i, "f", q, s))
        want[i] = message
        spec = {"name": "f", "queues": [{"name": n, "capacity": c, **({"schema": {"schema_id": i}} if i is not None else {}), **({"type": t} if t else {})} for n, c, i, t in q],
                "stages": [{"name": n, "type": t, "threads": k, "input_queue": a, "output_queue": b} for n, t, k, a, b in s]}
        with pt.raises(FlowError, match=message.replace("> 0", "> 0")):
            check_spec(spec)
    specs = spark.createDataFrame(rows, "flow_id long, name string, queues array<struct<name:string,capacity:long,schema_id:string,type:string>>, "
                                        "stages array<struct<name:string,type:string,threads:long,input_queue:string,output_queue:string>>")
    assert {r.flow_id: r.message for r in Q.validate(specs, kinds=kinds).collect()} == want
    assert {r.flow_id: r.message for r in Q.first_error(specs, kinds=kinds).collect()} == want
    assert Q.validate(specs).count() == 0   # without kinds only the spec's own rules
