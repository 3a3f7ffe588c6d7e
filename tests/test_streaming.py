"""Batch = streaming(availableNow) for flows, idempotent batch sinks,
stop-on-failure, and windowed rates on streams."""

import os

import pytest
from pyspark.sql import functions as F

import pipework.streaming.runner as S
from pipework.operators.flow import run_flow
from pipework.sources import fixtures as X
from tests.conftest import SF001


def _spec(src_cfg, src_type="file_source"):
    return {"name": "gate", "queues": [{"name": "in", "capacity": 4, "schema": {"schema_id": "events"}},
                                       {"name": "out", "capacity": 4}],
            "stages": [{"name": "src", "type": src_type, "output_queue": "in", "config": src_cfg},
                       {"name": "t", "type": "noop_transform", "input_queue": "in", "output_queue": "out"},
                       {"name": "sink", "type": "table_sink", "input_queue": "out"}]}


def test_job_mode_equals_batch(spark, scratch):
    """The same gated flow, run as a batch over a table and as a streaming
    job (availableNow, one file per trigger), delivers the same rows."""
    src = os.path.join(scratch, "payloads")
    X.payloads(spark, SF001).drop("attrs").repartition(3).write.parquet(src)
    ddl = spark.read.parquet(src).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    spark.read.parquet(src).createOrReplaceTempView("pw_t")
    batch = run_flow(spark, _spec({"table": "pw_t"}, "table_source")).sinks["sink"]
    out = os.path.join(scratch, "out")
    qs = S.run_job(spark, _spec({"path": src, "format": "parquet", "schema": ddl, "max_files_per_trigger": 1}),
                   out, name="gate_job")
    assert all(not q.isActive for q in qs)
    streamed = S.read_sink(spark, out, "sink")
    cols = ["event_id", "schema_id", "flags", "trace_id"]
    assert sorted(streamed.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert streamed.count() == spark.read.parquet(src).where(F.col("schema_id").isin("", "events")).count()
    assert S.admission_limits(_spec({}, "file_source")) == {"src": 4}


def test_foreach_batch_idempotent(spark, scratch):
    lines = os.path.join(scratch, "csv")
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    o.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")).repartition(2) \
     .write.text(lines)
    out, ck = os.path.join(scratch, "tbl"), os.path.join(scratch, "ck")
    q = S.csv_ingest_stream(spark, lines, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE",
                            out, ck, max_files=1)
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == o.count()
    # a replay of the same input (new checkpoint, same batch ids) overwrites, never duplicates
    q2 = S.csv_ingest_stream(spark, lines, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE",
                             out, os.path.join(scratch, "ck2"), max_files=1)
    q2.awaitTermination()
    assert spark.read.parquet(out).count() == o.count()


def test_stop_on_first_failure(spark, scratch):
    src = os.path.join(scratch, "bad")
    spark.createDataFrame([("x",)], "v string").write.text(src)
    bad = (spark.readStream.format("text").load(src)
           .select(F.raise_error(F.lit("boom")).alias("v")))
    q = bad.writeStream.format("noop").option("checkpointLocation", os.path.join(scratch, "ckb")) \
           .trigger(availableNow=True).start()
    with pytest.raises(Exception):
        S.await_all([q])
    assert not q.isActive


def test_stream_rate_matches_batch(spark, scratch):
    src = os.path.join(scratch, "ev")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(2).write.parquet(src)
    schema = spark.read.parquet(src).schema
    st = spark.readStream.schema(schema).parquet(src)
    rates = S.stream_rate(st, 3600, ["event_type"], watermark="0 seconds")
    q = rates.writeStream.format("memory").queryName("pw_rates").outputMode("append") \
             .option("checkpointLocation", os.path.join(scratch, "ckr")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT count(*) AS n FROM pw_rates").collect()[0].n
    from pipework.operators.promql import window_rate
    ref = window_rate(spark.read.parquet(src), 3600, ["event_type"]).count()
    # the last window per key may stay open behind the watermark
    assert ref - 5 <= got <= ref


def test_watch_events_stream_equals_batch(spark, scratch):
    """A log cut into shuffled micro-batches gives the events, versions and specs of
    the batch operator; a row behind the watermark is dropped."""
    from pipework.operators.history import watch_events
    from pipework.streaming.watch import STATE_STORE, watch_events_stream
    src = os.path.join(scratch, "kv")
    kv = X.kv_log(spark, SF001).cache()
    for i in range(3):
        kv.where(F.abs(F.hash("rev", "key")) % 3 == i).coalesce(1).write.mode("append").parquet(src)
    far = kv.orderBy(F.desc("rev")).limit(1).withColumn("ts", F.expr("timestampadd(DAY, 400, ts)")).withColumn("key", F.lit("/x/flows/far/active"))
    far.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    before = {k: spark.conf.get(k) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)

        def run():
            q = (watch_events_stream(stream, "100 days").writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", os.path.join(scratch, "ckw")).trigger(availableNow=True).start(os.path.join(scratch, "watched")))
            q.awaitTermination()
            return spark.read.parquet(os.path.join(scratch, "watched"))
        cols = ["ts", "rev", "key", "flow", "event_type", "version", "spec"]
        want = sorted(map(repr, watch_events(kv).select(*cols).collect()))
        assert sorted(map(repr, run().select(*cols).collect())) == want and len(want) > 100
        assert any("spec=None" not in r for r in want)
        # taken up again from the checkpoint: what is late changes nothing
        kv.limit(5).coalesce(1).write.mode("append").parquet(src)
        assert sorted(map(repr, run().select(*cols).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_streaming_mode_runs_until_stopped(spark, scratch):
    src = os.path.join(scratch, "txt")
    spark.createDataFrame([("a",), ("b",)], "value string").write.text(src)
    spec = {"name": "live", "queues": [{"name": "q", "capacity": 8}],
            "stages": [{"name": "src", "type": "file_source", "output_queue": "q",
                        "config": {"path": src, "format": "text", "max_files_per_trigger": 1}},
                       {"name": "sink", "type": "stdout_sink", "input_queue": "q"}]}
    out = os.path.join(scratch, "live_out")
    qs = S.start_flow(spark, spec, out, mode="streaming", interval="1 second", fmt="text", name="live")
    for q in qs:
        q.processAllAvailable()
        assert q.isActive          # streaming mode keeps running when sources are drained
    S.stop_all(qs)
    assert sorted(r.value for r in S.read_sink(spark, out, "sink", "text").collect()) == ["a", "b"]


def test_rate_source_paced_sequence(spark, scratch):
    """A2: a paced sequence source; each worker counts from 0 and stops at
    max_messages (threads 2 x 5 messages = 10 rows, 5 distinct)."""
    import time
    spec = {"name": "paced", "queues": [{"name": "q", "capacity": 8}],
            "stages": [{"name": "src", "type": "rate_source", "threads": 2, "output_queue": "q",
                        "config": {"message": "DEADBEEF", "delay_ms": 100, "max_messages": 5}},
                       {"name": "sink", "type": "stdout_sink", "input_queue": "q"}]}
    out = os.path.join(scratch, "paced_out")
    qs = S.start_flow(spark, spec, out, mode="streaming", interval="1 second", fmt="text", name="paced")
    try:
        # a rate source always has new data, so poll the sink instead of
        # processAllAvailable(); the max_messages filter caps the output at 10
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(2)
            rows = S.read_sink(spark, out, "sink", "text")
            if rows is not None and rows.count() >= 10:
                break
    finally:
        S.stop_all(qs)
    lines = [r.value for r in S.read_sink(spark, out, "sink", "text").collect()]
    assert sorted(lines) == sorted([f"DEADBEEF #{i}" for i in range(5)] * 2)


FAN = {"name": "fan", "queues": [{"name": "in", "capacity": 7}, {"name": "a", "capacity": 2}, {"name": "b", "capacity": 5}],
       "stages": [{"name": "src", "type": "file_source", "output_queue": "in"},
                  {"name": "left", "type": "noop_transform", "input_queue": "in", "output_queue": "a"},
                  {"name": "right", "type": "noop_transform", "input_queue": "in", "output_queue": "b"},
                  {"name": "sink_a", "type": "stdout_sink", "input_queue": "a"},
                  {"name": "sink_b1", "type": "stdout_sink", "input_queue": "b"},
                  {"name": "sink_b2", "type": "stdout_sink", "input_queue": "b"}]}


def _fan(path):
    stages = [{**s, "config": {"path": path, "format": "text"}} if s["name"] == "src" else s for s in FAN["stages"]]
    return {**FAN, "stages": stages}


def test_one_query_reads_the_source_once_for_all_sinks(spark, scratch):
    src, out = os.path.join(scratch, "txt"), os.path.join(scratch, "out")
    lines = [f"line {i}" for i in range(60)]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(7).write.text(src)
    assert S.admission_limits(_fan(src)) == {"src": 2}
    (q,) = S.run_job(spark, _fan(src), out, fmt="text", name="fan_once")
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    assert sum(p["numInputRows"] for p in batches) == 60          # not once for each sink
    assert len(batches) == 4                                      # 7 files, 2 at a time
    rows = {s: [r.value for r in S.read_sink(spark, out, s, "text").collect()] for s in ("sink_a", "sink_b1", "sink_b2")}
    assert sorted(sum(rows.values(), [])) == sorted(lines)        # none lost, none twice
    assert all(rows.values())
    marks = set(os.listdir(os.path.join(out, "_batches")))
    marks = {m for m in marks if not m.startswith(".")}
    for s in rows:   # every sink stands at the same batches
        assert {d.removeprefix("batch_id=") for d in os.listdir(os.path.join(out, s)) if d.startswith("batch_id=")} == marks


def test_replayed_batches_change_nothing(spark, scratch):
    src, out = os.path.join(scratch, "txt"), os.path.join(scratch, "out")
    spark.createDataFrame([(f"line {i}",) for i in range(20)], "value string").repartition(2).write.text(src)
    S.run_job(spark, _fan(src), out, fmt="text", name="fan_first")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(out) for f in fs}
    before = files()
    S.run_job(spark, _fan(src), out, fmt="text", name="fan_second")   # a new checkpoint sees the same batches again
    assert files() == before
    # a batch that ended before its mark is written anew, over its own folders
    mark = next(f for f in before if f.endswith("_batches/0"))
    os.remove(mark)
    S.run_job(spark, _fan(src), out, fmt="text", name="fan_third")
    got = sorted(r.value for s in ("sink_a", "sink_b1", "sink_b2") for r in S.read_sink(spark, out, s, "text").collect())
    assert got == sorted(f"line {i}" for i in range(20))


def test_batch_sinks_are_published_together(spark, scratch):
    from pipework.operators import flow as L
    out = os.path.join(scratch, "job")
    good = spark.range(5).select(F.col("id").cast("string").alias("value"))
    bad = good.select(F.raise_error(F.lit("boom")).cast("string").alias("value"))
    L.write_sinks(L.FlowRun(sinks={"one": good, "two": good.limit(2)}), out, "text")
    assert [spark.read.text(f"{out}/{s}").count() for s in ("one", "two")] == [5, 2]
    with pytest.raises(Exception, match="boom"):
        L.write_sinks(L.FlowRun(sinks={"one": good.limit(1), "two": bad}), out, "text")
    assert [spark.read.text(f"{out}/{s}").count() for s in ("one", "two")] == [5, 2]   # as they were
    # a run that died after its commit is finished by the next one
    good.limit(3).write.text(f"{out}/_staging/one")
    os.makedirs(f"{out}/_publish")
    open(f"{out}/_publish/one", "w").close()
    L._finish_publish(spark, out)
    assert [spark.read.text(f"{out}/{s}").count() for s in ("one", "two")] == [3, 2]
    L.write_sinks(L.FlowRun(sinks={"one": good, "two": good}), out, "text")
    assert [spark.read.text(f"{out}/{s}").count() for s in ("one", "two")] == [5, 5]
    assert not [d for d in os.listdir(out) if d.startswith("_")]
