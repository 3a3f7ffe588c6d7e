"""Helpers shared by the operators: kept tables, inputs, byte-level text arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.session import scratch_path, ship_package

#: Text bytes that one numpy step holds at once (one document at least).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: cuts the
    lineage, survives lost executors, and fixes rows that later steps read
    more than once."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra
    columns of the caller can't clash with them."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def small(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; looks at ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


# ---- text as byte arrays (inside tasks) -------------------------------------

def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) over runs of rows of about ``limit`` bytes."""
    data, off = byte_rows(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _RNG.integers(1, 2**63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte run data[start:end], equal for equal runs."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD[15])


_LANES = _RNG.integers(1, 2**63, (2, 4), dtype=np.int64).astype(np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte run data[start:end], equal for equal runs. Up to 32 bytes go in keyed
    8-byte lanes, each through the finaliser on its own, so no linear relation between words
    carries over to their hashes; longer runs go through XXH3."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the 8 bytes from every place on
    out = size.astype(np.uint64) * ODD[15]
    for lane in range(4):
        on = np.flatnonzero((size > 8 * lane) & (size <= 32))
        if not len(on):
            break
        short = np.minimum(size[on] - 8 * lane, 8).astype(np.uint64)
        x = at[starts[on] + 8 * lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        out[on] += mix(mix(x ^ _LANES[0, lane]) + _LANES[1, lane])
    long = np.flatnonzero(size > 32)
    if len(long):
        import xxhash
        raw = data.tobytes()
        out[long] += np.array([xxhash.xxh3_64_intdigest(raw[a:b], 0x5EED) for a, b in zip(starts[long].tolist(), ends[long].tolist())], np.uint64)
    return mix(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE):
    """Start and end of every word (run of bytes outside ``gap``), and the index
    of the first word of each row (one entry more than rows)."""
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    if len(before):
        before[0] = False
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---- keys and order ---------------------------------------------------------

def unit_hash(*cols) -> "F.Column":
    """A number in [0, 1) that only the columns decide."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, list]:
    """``df`` sorted over partitions, kept, with ``chunk`` and ``idx`` (the place
    within the chunk); and the rows of every chunk in order, one driver row for
    each partition. No row passes through the driver."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("idx", F.monotonically_increasing_id())
    d = keep(d, name)
    d = d.withColumn("chunk", F.shiftright("idx", 33)).withColumn("idx", F.col("idx").bitwiseAND(F.lit((1 << 33) - 1)))
    return d, sorted((r.chunk, r.n) for r in d.groupBy("chunk").agg(F.count("*").alias("n")).collect())


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """For broadcast if it has at most ``rows`` (narrow) rows; as it is otherwise."""
    return F.broadcast(df) if small(df, rows) else df
