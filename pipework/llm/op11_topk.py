"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates lie in vertical blocks: one array per dimension over some thousand
vectors. For a group of queries the scores are accumulated one block of
dimensions after the other, the dimensions of most query mass first. What the
dimensions still to come can add is at most the product of the remaining
masses (Cauchy-Schwarz); candidates that can't reach a query's k-th best score
any more are compacted away between two blocks. The first threshold of a query
is its k-th best score within a bounded sample of candidates, which is a lower
bound of the final one, so nothing is lost and each task keeps only few rows.

Queries go through in passes of bounded size, by broadcast; the candidates are
never shuffled, only the best rows of each task are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns, keep

#: Candidates in a vertical block, queries scored together, dimensions added at once.
ROWS, GROUP, DIMS = 4096, 128, 16
#: A pass broadcasts at most so many queries and bytes (at least one query); the sample
#: for the first thresholds has at most so many candidates and bytes.
PASS_QUERIES, PASS_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 50_000, 64 << 20, 4096, 32 << 20
LONG = 2**63 - 1
FOUND = "qrid long, query_id long, score long, vec_id long, rid long"


def prepared(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = 64) -> DataFrame:
    """rid, vec_id, v (array of floor(scale * x)) of the rows that take part."""
    d = columns(vectors, vec_id=id_col, x=vector_col)
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~odd)
    return keep(d.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale))).alias("v")), "vectors")


def matrix(lists, dims: int) -> np.ndarray:
    """Rows of a list column as an integer matrix, shorter rows filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def number_type(most_a: float, most_b: float):
    """The cheapest type in which sums of products are exact, if the vectors' masses are at most these."""
    most = np.sqrt(most_a * most_b) * 1.001
    return np.float32 if max(most, most_a, most_b) < 2**24 else np.float64 if max(most, most_a, most_b) < 2**53 else object


def mass(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return (m * m).sum(axis=1)


def _saturated(s: np.ndarray) -> np.ndarray:
    return np.array([max(-LONG - 1, min(LONG, x)) for x in s], np.int64) if s.dtype == object else s.astype(np.int64)


def survivors(q: np.ndarray, c: np.ndarray, least: np.ndarray):
    """(query, candidate, score) of the pairs whose score is at least the query's
    threshold. q: queries by dimensions; c: the block, dimensions by candidates."""
    if q.dtype == object:  # numbers beyond exact floats
        s = q @ c
        qi, ci = np.nonzero(s.astype(np.float64) >= least[:, None] - np.abs(least[:, None]) * 1e-9)
        return qi, ci, s[qi, ci]
    order = np.argsort(-(q.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, c = q[:, order], c[order]
    ends = [*range(DIMS, len(order), DIMS), len(order)]
    left_q = np.sqrt(np.maximum((q.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))
    left_c = np.sqrt(np.maximum((c.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1], 0))
    at, a = np.arange(c.shape[1]), 0
    s = np.zeros((len(q), c.shape[1]), q.dtype)
    pairs = None
    for b in ends:
        if pairs is None:
            s += q[:, a:b] @ c[a:b]
            if b == len(order):
                qi, ci = np.nonzero(s >= least[:, None])
                return qi, at[ci], s[qi, ci]
            # rounding of the roots stays far below the slack
            alive = s + left_q[:, b, None] * left_c[b] * 1.000001 + 0.01 >= least[:, None]
            some = alive.any(axis=0)
            if alive.mean() < 1 / 16:
                pairs = np.nonzero(alive)
                s = s[pairs]
            elif some.mean() < 0.7:
                s, c, left_c, at = s[:, some], c[:, some], left_c[:, some], at[some]
        else:
            qi, ci = pairs
            for k in range(a, b):
                s = s + q[qi, k] * c[k, ci]
            rest = left_q[qi, b] * left_c[b, ci] * 1.000001 + 0.01 if b < len(order) else 0
            alive = s + rest >= least[qi]
            pairs, s = (qi[alive], ci[alive]), s[alive]
        a = b
    qi, ci = pairs if pairs is not None else np.nonzero(s >= least[:, None])  # no dimension at all: every score is zero
    return qi, at[ci], s if pairs is not None else s[qi, ci]


def _best(q, score, vec, rid, k):
    """Places of the k best entries of every query, in order: high score, small vec_id."""
    order = np.lexsort((rid, vec, np.invert(score), q))  # ~score falls as score rises, without overflow
    qs = q[order]
    first = np.searchsorted(qs, qs)
    return order[np.arange(len(qs)) - first < k]


def _blocks(batches, dims, rows):
    """(rid, vec_id, vectors) of so many rows at most."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            x = b.slice(i, rows)
            yield x.column("rid").to_numpy(), x.column("vec_id").to_numpy(), matrix(x.column("v"), dims)


def searcher(queries, dims: int, k: int):
    """A function for mapInArrow: the k best candidates of the task for every query of the pass."""
    def run(batches):
        qrid, qid, qv, least = queries.value
        least = least.copy()
        most_q = mass(qv).max(initial=0.0)
        held = [np.zeros(0, np.int64)] * 4  # query, score, vec_id, rid
        for rid, vec, v in _blocks(batches, dims, ROWS):
            kind = number_type(most_q, mass(v).max(initial=0.0))
            c = np.ascontiguousarray(v.T).astype(kind)
            found = [held]
            for g in range(0, len(qv), GROUP):
                qi, ci, s = survivors(qv[g:g + GROUP].astype(kind), c, least[g:g + GROUP])
                other = qrid[g + qi] != rid[ci]
                qi, ci, s = qi[other], ci[other], s[other]
                found.append([g + qi, _saturated(s), vec[ci], rid[ci]])
            held = [np.concatenate(x) for x in zip(*found, strict=True)]
            best = _best(*held, k)
            held = [x[best] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=len(qv)) == k)
            last = np.searchsorted(held[0], full, side="right") - 1
            least[full] = held[1][last]
        q, score, vec, rid = held
        for i in range(0, len(q), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qrid[q[j]], qid[q[j]], score[j], vec[j], rid[j])], names=[f.split()[0] for f in FOUND.split(", ")])
    return run


def _first_thresholds(sample, dims: int, k: int):
    """Adds ``least``: a query's k-th best score in the sample (minus infinity if it has fewer others)."""
    def run(batches):
        rid, v = sample.value
        most = mass(v).max(initial=0.0)
        for b in batches:
            q = matrix(b.column("v"), dims)
            out = np.full(len(q), -np.inf)
            for i in range(0, len(q), GROUP):
                part = q[i:i + GROUP]
                kind = number_type(mass(part).max(initial=0.0), most)
                s = (part.astype(kind) @ v.T.astype(kind)).astype(np.float64)
                s[b.column("rid").to_numpy()[i:i + GROUP, None] == rid] = -np.inf
                if s.shape[1] >= k:
                    out[i:i + GROUP] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "least"])
    return run


def top_k(vectors: DataFrame, is_query: Column | None = None, k: int = 20, id_col="vec_id", vector_col="embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of highest integer inner product for each query row.

    ``is_query`` is a condition on vec_id (as ``vec_id``); the default takes ids divisible by 20.
    Components become floor(scale * x), x as double. Candidates are all rows but the query's own
    row; ties go to the smaller vec_id. Rows whose vector is null or holds a null, NaN or infinite
    component, and rows with a null vec_id, take no part. Shorter vectors count as filled with zeros,
    so an empty one scores 0. Rows that share an id are candidates (and queries) of their own. With
    fewer than k candidates all are returned; an empty table, or a lone row, gives no rows. Numbers
    beyond 2**53 are computed as whole numbers, and scores beyond a long stop at its limits (and tie
    there). Other columns are not read."""
    spark = vectors.sparkSession
    d = prepared(vectors, id_col, vector_col, scale)
    n, dims = d.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = dims or 0
    queries = d.where(F.col("vec_id") % 20 == 0 if is_query is None else is_query)
    rows = max(k + 1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims + 8)))
    sample = d.orderBy(F.xxhash64("rid"), "rid").limit(rows).toArrow()
    sample = spark.sparkContext.broadcast((sample.column("rid").to_numpy(), matrix(sample.column("v"), dims)))  # SAMPLE_ROWS at most
    queries = keep(queries.mapInArrow(_first_thresholds(sample, dims, k), "rid long, vec_id long, v array<long>, least double"), "queries")
    each = max(1, min(PASS_QUERIES, PASS_BYTES // (8 * dims + 24)))
    passes = max(1, -(-queries.count() // each))
    found = None
    for p in range(passes):
        q = queries.where(F.pmod(F.xxhash64("rid"), F.lit(passes)) == p).toArrow()
        if not q.num_rows:
            continue
        q = spark.sparkContext.broadcast((q.column("rid").to_numpy(), q.column("vec_id").to_numpy(), matrix(q.column("v"), dims), q.column("least").to_numpy().copy()))
        part = keep(d.mapInArrow(searcher(q, dims, k), FOUND), "found")
        q.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    place = F.row_number().over(W.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
