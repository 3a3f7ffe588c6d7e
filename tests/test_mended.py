"""Cases that once lost or invented rows."""

import pytest
from pyspark.sql import functions as F

import pipework.operators.stages  # noqa: F401
from pipework.functions import scalars as S
from pipework.functions.attrs import to_envelope
from pipework.operators import flow as FL
from pipework.operators import promql as P
from pipework.operators import quality as Q
from pipework.operators.history import gauge
from pipework.sources.sequence import sequence_config_errors, sequence_from_configs
from pipework.sources.specfiles import parse_specs


def test_split_is_complete_and_shared(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"k{i}") for i in range(60)], "id long, k string")
    parts = FL.competing_split(df, 2, "k")
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(60))
    whole = to_envelope(spark.range(1000), ["id"])
    first = FL.competing_split(whole, 2, "span_id", "q1")
    assert all(300 < p.count() < 700 for p in first)
    again = [p.count() for p in FL.competing_split(first[0], 2, "span_id", "q2")]   # a queue after a queue
    assert min(again) > 100


def test_stage_names_are_unique():
    q = [{"name": "q", "capacity": 1}]
    src = {"name": "src", "type": "noop_source", "output_queue": "q", "config": {"max_messages": 3}}
    sink = {"name": "sink", "type": "stdout_sink", "input_queue": "q"}
    with pytest.raises(FL.FlowError, match="duplicate stage name"):
        FL.check_spec({"stages": [src, sink, dict(sink)], "queues": q})
    with pytest.raises(FL.FlowError, match="stage name is required"):
        FL.check_spec({"stages": [src, {**sink, "name": ""}], "queues": q})


def test_metrics_judge_what_was_produced(spark):
    spec = {"stages": [{"name": "src", "type": "noop_source", "output_queue": "a", "config": {"max_messages": 100}},
                       {"name": "t", "type": "noop_transform", "input_queue": "a", "output_queue": "b"},
                       {"name": "sink", "type": "stdout_sink", "input_queue": "b"}],
            "queues": [{"name": "a", "capacity": 1, "schema": {"schema_id": "x"}}, {"name": "b", "capacity": 1, "schema": {"schema_id": "y"}}]}
    m = {r.stage_name: (r.dequeue, r.process, r.error, r.enqueue) for r in FL.run_flow(spark, spec, set_schema=True).metrics().collect()}
    assert m == {"src": (None, 100, 0, 100), "t": (100, 100, 0, 100), "sink": (100, 100, 0, None)}
    m = {r.stage_name: (r.dequeue, r.process, r.error, r.enqueue) for r in FL.run_flow(spark, spec).metrics().collect()}
    assert m == {"src": (None, 100, 0, 100), "t": (100, 100, 100, 0), "sink": (0, 0, 0, None)}


def test_grid_rejects_uneven_windows(spark):
    df = spark.createDataFrame([(1,)], "n long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    for window in (30, 90):
        with pytest.raises(ValueError):
            P.eval_grid(df, 60, window)


def test_sequences_without_messages(spark):
    cfg = spark.createDataFrame([(1, "m", 2, 3), (2, "m", 1, 0), (3, "m", 0, 5), (4, "m", 1, 20_001), (5, "m", None, 1)], "k long, m string, t int, n int")
    got = sequence_from_configs(cfg, "k", "m", "t", "n").groupBy("k").agg(F.count("*").alias("c"), F.max("seq").alias("x"), F.countDistinct("worker", "seq").alias("d"))
    assert {r.k: (r.c, r.x, r.d) for r in got.collect()} == {1: (6, 2, 6), 4: (20_001, 20_000, 20_001)}
    assert {r.k for r in sequence_config_errors(cfg, "k", "t", "n").collect()} == {2, 3, 5}


def test_buckets_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (99.0,)], "v double")
    assert {(r.le, r.cnt) for r in P.bucket_counts(df, "v", [5.0, 10.0]).collect()} == {(5.0, 1), (float("inf"), 1)}


def test_fingerprints_differ(spark):
    rows = [(None, "x"), ("", "x"), ("a~b", "c"), ("a", "b~c"), ("1:a", None), ("1", ":a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(Q.fingerprint(["a", "b"]).alias("f")).distinct().count() == len(rows)


def test_spec_fingerprint_ignores_order(spark):
    ddl = "flow_id long, name string, queues array<struct<name:string,capacity:long,schema_id:string>>, stages array<struct<name:string,type:string,threads:long,input_queue:string,output_queue:string>>"
    q1, q2, s = ("a", 0, None), ("b", 5, "x"), ("s", "t", 1, "a", None)
    df = spark.createDataFrame([(1, "f", [q1, q2], [s]), (2, "f", [q2, ("a", 128, None)], [s]), (3, "f", [q1], [s])], ddl)
    f = {r.flow_id: r.fingerprint for r in Q.spec_fingerprint(df).collect()}
    assert f[1] == f[2] != f[3]


def test_strict_spec_loading(spark):
    texts = ['{"name": "f", "stages": [{"name": "s", "threads": 1}]}', '{"name": "f", "stages": [{"name": "s", "threads": "many"}]}',
             '{"name": "f", "queues": [{"name": "q", "depth": 1}]}', '{"name": "f", "queues": [{"name": "q", "schema": {"id": 1}}]}',
             '{"name": "f", "x": 1}', 'no json']
    got = [r.error for r in parse_specs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")).orderBy("i").collect()]
    assert got == [None, "invalid value", 'unknown field "depth"', 'unknown field "id"', 'unknown field "x"', "invalid JSON"]


def test_keys_and_versions(spark):
    df = spark.createDataFrame([("nokey",), ("/pipelines/flows/f/active",)], "k string")
    assert [r.n for r in df.select(S.key_name("k").alias("n")).collect()] == [None, "f"]
    v = spark.createDataFrame([(t,) for t in ("00000000000007", "4294967295", "4294967296", "99999999999999999999", "0", "x")], "t string")
    assert [r.v for r in v.select(S.version_parse("t").alias("v")).collect()] == [7, 4294967295, None, None, None, None]


def test_gauge_holds_across_days(spark):
    per = spark.createDataFrame([(10, 3), (12, -1), (1440 * 3 + 2, 5)], "_b long, _d long")
    got = [(r.ts, r.depth) for r in gauge(per, 60, "depth").orderBy("ts").collect()]
    assert len(got) == 1440 * 3 + 2 - 10 + 1
    assert [d for _, d in got[:3]] == [3, 3, 2] and got[-2][1] == 2 and got[-1][1] == 7


def test_windows_and_alerts_across_days(spark):
    ts = F.timestamp_seconds(F.col("i") * 60).cast("timestamp_ntz")
    df = spark.range(1430, 1460).withColumnRenamed("id", "i").where("i <> 1450").withColumn("ts", ts).withColumn("v", F.when(F.col("i") == 1435, 9).otherwise(1))
    m = {r.ts.hour * 60 + r.ts.minute + (r.ts.day - 1) * 1440: r.max_over_time for r in P.max_over_time(df, 600, value="v").collect()}
    assert all(m[i] == (9 if 1435 <= i < 1445 else 1) for i in m) and len(m) == 29
    a = {r.i: (r.active_since.hour * 60 + r.active_since.minute + (r.active_since.day - 1) * 1440, r.state) for r in P.alert_for(df, 60, 600).collect()}
    assert a[1439] == (1430, "pending") and a[1440] == (1430, "firing") and a[1449] == (1430, "firing") and a[1459] == (1451, "pending")
