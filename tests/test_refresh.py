"""Panels and alerts on streams, quantiles from sketches, panels with a range,
counters observed by the jobs that write the sinks."""

import os

import pytest
from pyspark.sql import functions as F

from pipework.operators import flow as L
from pipework.operators import promql as P
from pipework.operators import sketch as K
from pipework.plans import flows as FLW
from pipework.plans.panels import PANELS
from pipework.sources import fixtures as X
from pipework.streaming.panels import stream_alert, stream_quantile
from pipework.streaming.watch import STATE_STORE
from tests.conftest import SF001

BOUNDS = (0.0, 10.0, 50.0, 100.0, 500.0)


@pytest.fixture()
def state_store(spark):
    before = {k: spark.conf.get(k) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _observations(spark):
    """Two routes over two hours with pauses; ties, overflow, nulls and empty minutes."""
    t = F.timestamp_add("SECOND", (F.col("id") * 7 % 7200).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    minute = F.floor(F.col("id") * 7 % 7200 / 60)
    v = F.when(F.col("id") % 41 == 0, F.lit(None)).when(minute % 30 < 20, (F.col("id") % 90 * 8).cast("double")).otherwise(F.lit(3.0))
    return spark.range(4000).select(t.alias("ts"), F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("route"), v.alias("ms")) \
                .where(F.floor(F.minute("ts") / 10) != 4)


def test_streamed_p95_and_alert_equal_the_batch(spark, scratch, state_store):
    src = os.path.join(scratch, "obs")
    df = _observations(spark).cache()
    for i in range(3):   # micro-batches out of order, within the watermark
        df.where(F.abs(F.hash("ts", "ms")) % 3 == i).coalesce(1).write.mode("append").parquet(src)
    far = df.limit(1).withColumn("ts", F.expr("timestampadd(DAY, 5, ts)")).withColumn("ms", F.lit(1.0))
    far.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def drain(out, n):
        q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(scratch, f"ck{n}"))
             .trigger(availableNow=True).start(os.path.join(scratch, f"out{n}")))
        q.awaitTermination()
        return spark.read.parquet(os.path.join(scratch, f"out{n}"))

    # batch: five-minute windows on a one-minute grid
    per = P.bucket_counts(df.withColumn("b", F.expr("date_trunc('minute', ts)")), "ms", BOUNDS, ["b", "route"])
    per = per.withColumn("ts", F.expr("timestampadd(MINUTE, 1, b)")).drop("b")
    grid = P.eval_grid(per, 60, 300).groupBy("ts", "route", "le").agg(F.sum("cnt").alias("cnt"))
    want = P.histogram_quantile(grid, 0.95, BOUNDS, ["ts", "route"]).cache()
    p95 = stream_quantile(stream, "ms", 0.95, BOUNDS, 60, 300, ["route"], watermark="3 hours")
    near = lambda d, c: sorted((r.ts, r.route, round(r[c], 6)) for r in d.collect())
    got = near(drain(p95.drop("event_ts"), 1), "value")
    assert got == near(want, "value") and len(got) > 100

    alert = P.alert_for(want.where("value > 100"), 60, 600, ["route"])
    fired = drain(stream_alert(p95, F.col("value") > 100, 60, 600, ["route"]), 2)
    cols = ["ts", "route", "active_since", "state"]
    assert sorted(fired.select(*cols).collect()) == sorted(alert.select(*cols).collect())
    assert {r.state for r in fired.collect()} == {"pending", "firing"}


def test_bucket_quantile_equals_the_batch(spark):
    df = _observations(spark)
    counts = P.bucket_counts(df, "ms", BOUNDS, ["route"])
    for q in (0.0, 0.5, 0.95, 1.0):
        want = {r.route: r.value for r in P.histogram_quantile(counts, q, BOUNDS, ["route"]).collect()}
        rows = counts.groupBy("route").agg(F.collect_list(F.struct("le", F.col("cnt").alias("n"))).alias("b"))
        assert {r.route: r.v for r in rows.select("route", P.bucket_quantile(F.col("b"), q, BOUNDS).alias("v")).collect()} == want
    empty = spark.range(1).select(F.array().cast("array<struct<le:double,n:bigint>>").alias("b"))
    assert empty.select(P.bucket_quantile(F.col("b"), 0.5, BOUNDS).alias("v")).first().v is None
    with pytest.raises(ValueError):
        P.bucket_quantile(F.col("b"), 1.5, BOUNDS)


def test_sketched_quantiles(spark):
    """Few observations: exact. Many: the rank is within twice the 99 % bound. Nulls and
    NaN don't count, no rows give no rows, cutting the input otherwise changes no count."""
    n = 200_000
    many = spark.range(n).select(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("t0"), ((F.col("id") * 7919) % n).cast("double").alias("v"),
                                 (F.col("id") % 600).alias("s")).select(F.expr("timestampadd(SECOND, CAST(s AS INT), t0)").alias("ts"), "v")
    odd = many.limit(2).withColumn("v", F.lit(float("nan"))).unionByName(many.limit(2).withColumn("v", F.lit(None).cast("double")))
    for parts in (3, 17):
        sk = K.merged(K.step_sketches(many.unionByName(odd).repartition(parts), "v", 60))
        for q in (0.05, 0.5, 0.95, 0.99):
            r = K.quantile(sk, q).first()
            assert r.n == n and abs(r.value / n - q) <= 2 * K.rank_error()
    small = spark.createDataFrame([("2024-01-01 00:00:10", float(i)) for i in range(1, 21)], "t string, v double") \
                 .select(F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    t = {r.ts.minute: (r.n, r.value) for r in K.trailing_quantile(small, "v", 0.95, 60, 180).collect()}
    assert t == {1: (20, 19.0), 2: (20, 19.0), 3: (20, 19.0)}
    assert K.trailing_quantile(small.limit(0), "v", 0.5, 60, 60).collect() == []
    assert K.rank_error(400) < K.rank_error(200) < 0.014
    answers = spark.createDataFrame([("a", 5.0), ("b", 500.0)], "k string, value double")
    x = spark.range(1, 1001).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), F.col("id").cast("double").alias("v"))
    assert {r.k: (r.n, r.within) for r in K.rank_check(x, answers, "v", 0.5, ["k"], 0.01).collect()} == {"a": (1000, False), "b": (1000, True)}


def test_panels_take_a_range(spark):
    """A panel over the last hours has the rows of the whole panel after now less the range."""
    newest = {"rt": X.payloads(spark, SF001), "api": X.access_log(spark, SF001), "ctl": X.reconcile_log(spark, SF001)}
    for key in ("rt_enqueue", "rt_stage_p95", "api_http_rate", "api_grpc_p95", "ctl_reconcile_fail"):
        now = newest[key.split("_")[0]].agg(F.max("ts")).first()[0]
        whole, part = PANELS[key](spark, SF001).collect(), PANELS[key](spark, SF001, 48.0).collect()
        assert sorted(part) == sorted(r for r in whole if (now - r.ts).total_seconds() < 48 * 3600)
        assert 0 < len(part) < len(whole)
    logs = PANELS["rt_logs"](spark, SF001, 24.0 * 5).collect()
    assert len(logs) <= len(PANELS["rt_logs"](spark, SF001).collect())
    assert PANELS["api_traces"](spark, SF001, 24.0 * 400).collect() == PANELS["api_traces"](spark, SF001).collect()


def test_counters_come_with_the_sinks(spark, scratch):
    """Counters of the writing jobs equal those of a scan, without one; a stage that
    leads to no sink has none."""
    v = FLW._payload_view(spark, SF001)
    spec = {"name": "f", "queues": [{"name": "q_in", "capacity": 512, "schema": {"schema_id": "events"}}, {"name": "q_a", "capacity": 8},
                                    {"name": "q_b", "capacity": 8, "schema": {"schema_id": "other"}}, {"name": "q_c", "capacity": 4}],
            "stages": [{"name": "source", "type": "table_source", "output_queue": "q_in", "config": {"table": v}},
                       {"name": "ta", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_a"},
                       {"name": "tb", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_b"},
                       {"name": "tc", "type": "noop_transform", "input_queue": "q_in", "output_queue": "q_c"},
                       {"name": "sa", "type": "table_sink", "input_queue": "q_a"}, {"name": "sb", "type": "table_sink", "input_queue": "q_b"}]}
    run = L.run_flow(spark, spec, observe=True)
    L.write_sinks(run, os.path.join(scratch, "out"))
    got = run.counts()
    want = {r.stage_name: {c: r[c] for c in L.COUNTERS} for r in run.metrics().collect()}
    assert set(got["tc"].values()) == {None}
    assert {k: v for k, v in got.items() if k != "tc"} == {k: v for k, v in want.items() if k != "tc"}
    assert got["source"]["enqueue"] + got["source"]["error"] == spark.table(v).count()
    assert got["sa"]["dequeue"] == spark.read.parquet(os.path.join(scratch, "out", "sa")).count()
    with pytest.raises(L.FlowError):
        L.run_flow(spark, spec).counts()
