"""Edge cases of the monitoring operators."""

import pytest
from pyspark.sql import functions as F

from pipework.operators import promql as P


def test_histogram_quantile_interpolation(spark):
    bounds = (1.0, 2.0, 4.0)
    counts = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 0), ("a", 4.0, 10), ("a", float("inf"), 0),
                                    ("b", float("inf"), 5)], "g string, le double, cnt long")
    got = {r.g: r.value for r in P.histogram_quantile(counts, 0.5, bounds, ["g"]).collect()}
    assert got["a"] == pytest.approx(1.0)          # rank 10 → end of first bucket
    assert got["b"] == pytest.approx(4.0)          # only +Inf → highest finite bound
    q75 = P.histogram_quantile(counts, 0.75, bounds, ["g"]).where("g = 'a'").collect()[0].value
    assert q75 == pytest.approx(3.0)               # lower edge 2 (skipped empty bucket), halfway to 4
    with pytest.raises(ValueError):
        P.histogram_quantile(counts, 1.5, bounds, ["g"])


def test_increase_handles_reset(spark):
    s = spark.createDataFrame([("2024-01-01 00:01:00", 5.0), ("2024-01-01 00:02:00", 8.0),
                               ("2024-01-01 00:03:00", 2.0), ("2024-01-01 00:20:00", 4.0)], "ts string, value double") \
             .withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("k", F.lit("x"))
    inc = {str(r.ts)[11:16]: r.increase for r in P.increase(s, 600, ["k"]).collect()}
    assert inc == {"00:01": 0.0, "00:02": 3.0, "00:03": 5.0, "00:20": 2.0}


def test_regex_is_anchored(spark):
    df = spark.createDataFrame([(500,), (503,), (5030,), (404,)], "status long")
    assert sorted(r.status for r in P.select_regex(df, "status", "5..").collect()) == [500, 503]


def test_alert_for_islands(spark):
    mins = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20, 21]
    df = spark.createDataFrame([(m,) for m in mins], "m int") \
              .select(F.timestamp_seconds(F.col("m") * 60).cast("timestamp_ntz").alias("ts"))
    st = {r.ts.minute: r.state for r in P.alert_for(df, 60, 600).collect()}
    assert st[9] == "pending" and st[10] == "firing" and st[11] == "firing"
    assert st[20] == "pending" and st[21] == "pending"
