"""Exact top-k search against brute force, on small and odd inputs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pipework.llm import op11_topk

ROWS = "vec_id long, embedding array<float>, label int, rid long, v string, score double"


def make(spark, rows):
    return spark.createDataFrame([(i, x, 1, -1, "x", 0.5) for i, x in rows], ROWS)


def brute(rows, k, every=20, scale=64):
    """The contract, word for word."""
    import numpy as np
    usable = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((i, [math.floor(scale * float(np.float32(c))) for c in x]))
    out = []
    for a, (i, x) in enumerate(usable):
        if i % every:
            continue
        scored = sorted((-max(-2**63, min(2**63 - 1, sum(p * q for p, q in zip(x, y)))), j, b) for b, (j, y) in enumerate(usable) if b != a)
        out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    unit = lambda n: [rng.gauss(0, 1) / n ** 0.5 for _ in range(n)]
    centres = [unit(40) for _ in range(6)]
    out = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 6]]) for i in range(300)]
    hot = [0.125] * 40
    out += [(i, hot) for i in range(300, 420)]  # a third of all rows are one vector, and tie
    out += [(420, None), (440, [0.1, None] * 20), (460, [float("nan")] * 40), (480, [float("inf")] + [0.0] * 39), (None, hot),
            (500, []), (501, [1.0, -2.0]), (520, [0.0] * 40), (521, [-0.3] * 70)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, rows, monkeypatch, small):
    if small:  # several blocks, groups and passes
        for name, n in (("ROWS", 37), ("GROUP", 5), ("DIMS", 7), ("PASS_QUERIES", 6), ("SAMPLE_ROWS", 30)):
            monkeypatch.setattr(op11_topk, name, n)
    df = make(spark, rows).repartition(4)
    assert got(op11_topk.top_k(df)) == brute(rows, 20)


def test_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (3, [0.5, 0.5]), (20, [-1.0, 0.25])]
    assert got(op11_topk.top_k(make(spark, rows))) == brute(rows, 20)
    assert got(op11_topk.top_k(make(spark, rows), F.col("vec_id") % 3 == 0, k=1)) == brute(rows, 1, every=3)


def test_no_rows_and_one_row(spark):
    none = make(spark, [(1, [0.0])]).where("vec_id > 1")
    assert op11_topk.top_k(none).count() == 0
    assert op11_topk.top_k(none).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert op11_topk.top_k(make(spark, [(20, [0.5])])).count() == 0


def test_long_vectors_and_huge_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3000)]) for i in range(25)]
    assert got(op11_topk.top_k(make(spark, rows))) == brute(rows, 20)
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, -3.0]), (3, [2.0**50, 0.0]), (4, [-1.0, 0.0]), (20, [1.0, 1.0])]
    assert got(op11_topk.top_k(make(spark, rows))) == brute(rows, 20)


def test_bounds_compact_without_loss():
    """Both ways through a block (matrix, pairs) give the pairs of the whole product."""
    import numpy as np
    rng = np.random.default_rng(1)
    for spread in (0.02, 1.0):
        c = np.round(rng.normal(0, spread, (64, 500)) * 8 + (np.arange(64)[:, None] == rng.integers(0, 64, 500)) * 60).astype(np.float32)
        q = c[:, :40].T.copy()
        full = q @ c
        least = np.sort(full, axis=1)[:, -10].astype(np.float64)
        qi, ci, s = op11_topk.survivors(q, c, least)
        want = np.nonzero(full >= least[:, None])
        assert sorted(zip(qi, ci, s)) == sorted(zip(*want, full[want]))
