"""Time helpers. Event time stays ``TIMESTAMP_NTZ`` end to end, and epoch
arithmetic is done on NTZ values directly (``timestamp_diff`` /
``timestamp_add`` against the NTZ epoch), so results never depend on the
session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(ts).cast("timestamp_ntz"))


def from_epoch_us(us) -> Column:
    return F.timestamp_add("MICROSECOND", _c(us), _epoch())


def floor_to(ts, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket (aligned to the epoch)."""
    step = int(seconds) * 1_000_000
    return from_epoch_us(F.floor(epoch_us(ts) / F.lit(step)) * F.lit(step))


def bucket_index(ts, seconds: int) -> Column:
    """Integer index of the ``seconds``-wide epoch-aligned bucket."""
    return F.floor(epoch_us(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def index_to_ts(idx, seconds: int) -> Column:
    return from_epoch_us(_c(idx) * F.lit(int(seconds) * 1_000_000))


def add_seconds(ts, seconds: float) -> Column:
    return from_epoch_us(epoch_us(ts) + F.lit(int(round(seconds * 1_000_000))))


def add_ms(ts, ms) -> Column:
    """``ts`` plus a (fractional) number of milliseconds, µs precision."""
    return from_epoch_us(epoch_us(ts) + F.round(_c(ms) * F.lit(1000.0)).cast("long"))
