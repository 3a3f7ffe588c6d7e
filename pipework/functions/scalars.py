"""Scalar column functions. All built-in expressions,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: key layout and schema-format aliases ------------------
FLOWS_PREFIX = "/pipelines/flows/"
SCHEMAS_PREFIX = "/pipelines/schemas/"
# alias (after trim + lower-case) → canonical format
FORMAT_ALIASES = {
    "arrow": "IN_MEMORY_SCHEMA_FORMAT_ARROW", "apache-arrow": "IN_MEMORY_SCHEMA_FORMAT_ARROW",
    "json": "IN_MEMORY_SCHEMA_FORMAT_JSON",
    "protobuf": "IN_MEMORY_SCHEMA_FORMAT_PROTOBUF", "proto": "IN_MEMORY_SCHEMA_FORMAT_PROTOBUF",
    "flatbuffers": "IN_MEMORY_SCHEMA_FORMAT_FLATBUFFERS", "flatbuffer": "IN_MEMORY_SCHEMA_FORMAT_FLATBUFFERS",
}
UINT32_MAX = 4294967295
# -------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# G8 ----------------------------------------------------------------------
def key_name(key) -> Column:
    """``/pipelines/flows/<name>/active`` → ``<name>`` (base of the dir)."""
    return F.try_element_at(F.split(_c(key), "/"), F.lit(-2))


def key_leaf(key) -> Column:
    return F.try_element_at(F.split(_c(key), "/"), F.lit(-1))


def active_key(name) -> Column:
    return F.concat(F.lit(FLOWS_PREFIX), _c(name), F.lit("/active"))


def version_key(name, version) -> Column:
    return F.concat(F.lit(FLOWS_PREFIX), _c(name), F.lit("/versions/"), _c(version).cast("string"), F.lit("/spec"))


def status_key(name) -> Column:
    return F.concat(F.lit(FLOWS_PREFIX), _c(name), F.lit("/status"))


def schema_version_key(schema_id, version) -> Column:
    return F.concat(F.lit(SCHEMAS_PREFIX), _c(schema_id), F.lit("/versions/"), _c(version).cast("string"))


# G9 ----------------------------------------------------------------------
def format_alias(fmt) -> Column:
    """Schema-format alias parse (trim + lower-case). Unknown → null."""
    s = F.lower(F.regexp_replace(_c(fmt), r"^\s+|\s+$", ""))
    expr = None
    for alias, canon in FORMAT_ALIASES.items():
        expr = F.when(s == alias, F.lit(canon)) if expr is None else expr.when(s == alias, F.lit(canon))
    return expr


def format_error(fmt) -> Column:
    return F.when(format_alias(fmt).isNull(), F.format_string(
        "unsupported schema format \"%s\" (use arrow, json, protobuf, flatbuffers)", _c(fmt)))


# G10 ---------------------------------------------------------------------
def _parse_u32(text) -> Column:
    """Digits of any number, leading zeros included; out of range stays a number above the limit."""
    t = _c(text)
    short = F.regexp_replace(t, "^0+(?=[0-9])", "")
    return F.when(t.rlike("^[0-9]+$"), F.when(F.length(short) <= 10, short.try_cast("long")).otherwise(F.lit(UINT32_MAX + 1)))


def version_parse(text) -> Column:
    """Schema version parse: unsigned 32-bit and > 0; anything else → null."""
    p = _parse_u32(text)
    return F.when((p > 0) & (p <= F.lit(UINT32_MAX)), p)


def version_error(text) -> Column:
    """Message for a rejected version string (null when valid)."""
    p = _parse_u32(text)
    return (F.when(p.isNull() | (p > F.lit(UINT32_MAX)),
                   F.format_string("invalid schema version \"%s\"", _c(text)))
             .when(p == 0, F.lit("schema version must be greater than 0")))
