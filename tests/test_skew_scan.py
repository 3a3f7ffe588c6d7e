"""The chunked (skew-safe) replays must equal a plain sequential replay,
whatever the chunking — checked on random op logs with one hot name spread
over many tiny chunks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipework.operators import history as H
from pipework.operators import scan as S
from pipework.operators.scan import ordered_scan


def _python_replay(ops):
    """Straight sequential replay of the documented (immutable) rule."""
    state = {}
    for name, seq, op, version, spec in sorted(ops, key=lambda r: (r[0], r[1])):
        versions, active = state.get(name, ([], None))
        if op == "put":
            versions = versions + [spec]
            active = len(versions)
        elif op == "rollback":
            if version is not None and 1 <= version <= len(versions):
                active = version
        else:
            versions, active = [], None
        state[name] = (versions, active)
    return {(n, i + 1, s, i + 1 == a) for n, (vs, a) in state.items() for i, s in enumerate(vs)}


def _random_ops(seed, n=600):
    rnd = random.Random(seed)
    ops = []
    for seq in range(n):
        name = "hot" if rnd.random() < 0.6 else f"n{rnd.randrange(8)}"
        op = rnd.choices(["put", "rollback", "delete"], [6, 3, 1])[0]
        ops.append((name, seq, op, rnd.randrange(0, 6) if op == "rollback" else None,
                    float(seq) if op == "put" else None))
    return ops


def test_chunked_replay_matches_sequential(spark):
    for seed in (1, 2, 3):
        ops = _random_ops(seed)
        df = spark.createDataFrame(ops, "name string, seq long, op string, version long, spec double") \
                  .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        for chunk_rows in (7, 50, 10_000):
            chunk = F.floor(F.col("seq") / chunk_rows).cast("long")
            got = {(r.name, r.version, r.spec, r.is_active)
                   for r in H.current_versions(H.replay(df, chunk=chunk, heavy_rows=100)).collect()}
            assert got == _python_replay(ops), (seed, chunk_rows)
        assert {tuple(r) for r in H.current_versions(H.replay(df)).select("name", "version", "spec", "is_active").collect()} == _python_replay(ops)


def test_ordered_scan_matches_windows(spark):
    rnd = random.Random(7)
    rows = [("k" if rnd.random() < 0.7 else "j", i, rnd.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = ordered_scan(df, ["k"], ["seq"], F.floor(F.col("seq") / 9).cast("long"),
                       sums={"s": F.coalesce("v", F.lit(0))}, lasts={"l": F.col("v")}, prevs={"p": F.col("v")}, heavy_rows=200)
    w = Window.partitionBy("k").orderBy("seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "seq", F.sum(F.coalesce("v", F.lit(0))).over(run).alias("s"),
                     F.last("v", ignorenulls=True).over(run).alias("l"), F.lag("v").over(w).alias("p"))
    assert sorted(got.select("k", "seq", "s", "l", "p").collect()) == sorted(want.collect())


def _python_pointer(ops):
    """Straight sequential replay of the store's code rule."""
    state = {}
    for name, seq, op, version, spec in sorted(ops, key=lambda r: (r[0], r[1])):
        values, active = state.get(name, ({}, 0))
        if op == "put":
            active += 1
            values = {**values, active: spec}
        elif op == "rollback":
            if version is not None and 1 <= version <= max(values, default=0):
                active = version
        else:
            values, active = {}, 0
        state[name] = (values, active)
    return {(n, v, s, v == a) for n, (vs, a) in state.items() for v, s in vs.items()}


def test_speculative_fold_equals_the_sequential_one(spark):
    """A name of many rollbacks, with few deletes or none, over its chunks; guesses go
    wrong, as rollbacks make versions fewer than puts. Rows without a name go."""
    for seed, weights, chunk_rows in ((4, (5, 5, 0), 120), (5, (6, 5, 0.1), 70)):
        rnd = random.Random(seed)
        ops = []
        for seq in range(500):
            op = rnd.choices(["put", "rollback", "delete"], weights)[0]
            version = rnd.choice([None, 0, 1, 2, 3, 30, 200]) if op == "rollback" else None
            ops.append(("hot" if rnd.random() < 0.8 else "cold", seq, op, version, float(seq) if op == "put" else None))
        df = spark.createDataFrame([*ops, (None, 900, "put", None, 1.0)], "name string, seq long, op string, version long, spec double") \
                  .withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        chunk = F.floor(F.col("seq") / chunk_rows).cast("long")
        got = H.replay_pointer(df, chunk=chunk, heavy_rows=200)   # 5 and 8 chunks
        assert {tuple(r) for r in got.collect()} == _python_pointer(ops), seed
    assert {tuple(r) for r in H.replay_pointer(df).collect()} == _python_pointer(ops)


def test_heavy_keys_come_from_a_sketch(spark):
    """Every key over the bound is found, no light one; no rows and null keys are fine."""
    k = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    df = spark.range(90_000).select(k.alias("k"), F.lit(1).alias("v"))
    light, heavy = S.split_heavy(df, ["k"], 5_000)
    assert {r.k: r["count"] for r in heavy.groupBy("k").count().collect()} == {"hot": 30_000, None: 6_000}
    assert light.count() + heavy.count() == 90_000 and light.where("k IS NULL OR k = 'hot'").isEmpty()
    assert S.split_heavy(df, ["k"], 50_000)[1] is None
    assert S.heavy_hashes(df.limit(0), ["k"], 1) == []
    assert len(S.heavy_hashes(df, ["k", "v"], 5_000)) == 2
