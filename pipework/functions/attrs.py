"""Envelope metadata helpers.

``attrs`` is a ``MAP<STRING,STRING>`` column (typed reads cast the value) or,
where a value's type has to survive, a ``MAP<STRING,VARIANT>`` one (64-bit
integers, doubles, booleans and strings; ``typed_get`` and ``typed_set``). Maps
are immutable values, so "copy-on-write" is simply returning a new map column —
the source row is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_TRACE = "0" * 32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# G1 ----------------------------------------------------------------------
def attr_get(attrs, key: str, dtype: str | None = None) -> Column:
    """Missing map or key → null."""
    v = F.try_element_at(_c(attrs), F.lit(key))
    return v.try_cast(dtype) if dtype else v


# G2 ----------------------------------------------------------------------
def attr_set(attrs, key: str, value) -> Column:
    """Replace or add ``key``; a null map becomes a one-entry map."""
    v = value if isinstance(value, Column) else F.lit(value)
    base = F.coalesce(_c(attrs), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: k != F.lit(key)),
                        F.create_map(F.lit(key), v.cast("string")))


# G1 / G2, typed ------------------------------------------------------------
#: Types that an attribute can hold, by the name of a variant's own type.
ATTR_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}


def typed_attrs(attrs=None) -> Column:
    """A typed map: of a string map (its values stay strings), or null."""
    if attrs is None:
        return F.lit(None).cast("map<string,variant>")
    return F.transform_values(_c(attrs), lambda _, v: v.cast("variant"))


def attr_type(attrs, key: str) -> Column:
    """Type of a typed attribute (a key of ``ATTR_TYPES``); null if missing."""
    return F.schema_of_variant(F.try_element_at(_c(attrs), F.lit(key)))


def typed_get(attrs, key: str, dtype: str) -> Column:
    """The value if it is there *and* of this type (bigint, double, boolean or
    string), else null: a typed read never converts."""
    name = {v: k for k, v in ATTR_TYPES.items()}[dtype]
    v = F.try_element_at(_c(attrs), F.lit(key))
    return F.when(F.schema_of_variant(v) == F.lit(name), F.try_variant_get(v, "$", dtype))


def typed_set(attrs, key: str, value, dtype: str) -> Column:
    """Replace or add ``key`` with a value of this type; a null map becomes a one-entry map."""
    if dtype not in ATTR_TYPES.values():
        raise ValueError(f"an attribute is one of {', '.join(ATTR_TYPES.values())}, not {dtype}")
    v = value if isinstance(value, Column) else F.lit(value)
    base = F.coalesce(_c(attrs), F.create_map().cast("map<string,variant>"))
    return F.map_concat(F.map_filter(base, lambda k, _: k != F.lit(key)),
                        F.create_map(F.lit(key), v.cast(dtype).cast("variant")))


# G3 ----------------------------------------------------------------------
def attr_erase(attrs, key: str) -> Column:
    """Remove ``key``; an emptied map becomes null (no attrs)."""
    m = F.map_filter(_c(attrs), lambda k, _: k != F.lit(key))
    return F.when(F.size(m) > 0, m)


def attr_found(attrs, key: str) -> Column:
    """The erase 'found' flag: false for a null map or a missing key."""
    return F.coalesce(F.map_contains_key(_c(attrs), F.lit(key)), F.lit(False))


# G4 ----------------------------------------------------------------------
def has_attrs(attrs) -> Column:
    return F.coalesce(F.size(_c(attrs)) > 0, F.lit(False))


def clear_attrs() -> Column:
    return F.lit(None).cast("map<string,string>")


# G5 / G6 / G7 ------------------------------------------------------------
def has_trace(trace_id) -> Column:
    """Any of the 16 bytes non-zero (hex string form)."""
    t = _c(trace_id)
    return t.isNotNull() & (F.lower(t) != F.lit(ZERO_TRACE))


def has_schema_id(schema_id) -> Column:
    return F.coalesce(_c(schema_id), F.lit("")) != ""


def is_empty(payload, size) -> Column:
    """No buffer or zero size."""
    return _c(payload).isNull() | (F.coalesce(_c(size), F.lit(0)) == 0)


def trace_flags(flags) -> Column:
    """W3C trace flags = low 8 bits of the flags word."""
    return _c(flags).bitwiseAND(F.lit(255))


def to_envelope(df: DataFrame, payload_cols: list[str], ts: str | None = None,
                schema_id: str = "") -> DataFrame:
    """Wrap user columns into the payload envelope: payload = JSON of
    ``payload_cols`` as UTF-8 bytes; event time (or now) as enqueue time."""
    body = F.to_json(F.struct(*payload_cols))
    enq = F.col(ts) if ts else F.current_timestamp().cast("timestamp_ntz")
    return df.select(
        "*",
        F.encode(body, "UTF-8").alias("payload"),
        F.octet_length(body).cast("long").alias("size"),
        enq.alias("enqueue_ts"),
        F.lit(ZERO_TRACE).alias("trace_id"),
        # of the whole row: competing consumers split on it
        F.substring(F.md5(F.to_json(F.struct("*"))), 1, 16).alias("span_id"),
        F.lit(0).cast("long").alias("flags"),
        F.lit(schema_id).alias("schema_id"),
        F.lit(None).cast("map<string,string>").alias("attrs"),
    )
