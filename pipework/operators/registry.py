"""Versioned schema registry held in tables.

The registry is the replay of an append-only op log ``(schema_id, seq, op,
format, raw_schema)``: a create takes ``active + 1`` (first 1) and becomes
active; a delete removes every version of the id (exact id equality) and the
next create restarts at 1. Creates never roll back, so the active version is
always the newest one of the current epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipework.functions.scalars import format_alias
from pipework.operators.history import replay as history_replay

# --- fixed values: validation messages -----------------------------------
MSG_ID = "schema id is required"
MSG_FORMAT = "schema format is required"
MSG_PAYLOAD = "schema payload is required"
# -------------------------------------------------------------------------



def _error() -> Column:
    """First failing create check, in the store's order (null = valid). The
    format is the canonical enum after alias parsing; unknown = unspecified."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return (F.when(empty("schema_id"), F.lit(MSG_ID))
             .when(format_alias("format").isNull(), F.lit(MSG_FORMAT))
             .when(empty("raw_schema"), F.lit(MSG_PAYLOAD)))


def create_errors(ops: DataFrame) -> DataFrame:
    """B5 validation: rejected creates with the store's message."""
    return (ops.where(F.col("op") == "put").withColumn("error", _error())
               .where(F.col("error").isNotNull()).select("schema_id", "seq", "error"))


def replay(ops: DataFrame, key: str = "schema_id", order=("seq",), chunk_rows: int = 1 << 16) -> DataFrame:
    """Version numbers for every accepted create, with the epoch.
    Rejected creates are filtered in the same pass (no join). Uses the
    skew-safe segmented replay of the flow history (creates are puts, no
    rollbacks), chunked by ``seq // chunk_rows``."""
    valid = (ops.where((F.col("op") != "put") | _error().isNull())
                .withColumn("format", format_alias("format"))
                .withColumn("version", F.lit(None).cast("long")))
    chunk = F.floor(F.col(order[0]) / F.lit(int(chunk_rows))).cast("long")
    r = history_replay(valid, key, order, chunk)
    return r.withColumn("version", F.col("put_version")).drop("put_version", "puts", "valid")


def created_versions(replayed: DataFrame) -> DataFrame:
    """The version each create received (including later-deleted ones)."""
    return replayed.where(F.col("op") == "put").select("schema_id", "seq", "version")


def current(replayed: DataFrame, key: str = "schema_id") -> DataFrame:
    """All live versions (latest epoch) with the active flag. The latest
    epoch and newest version per id are partial aggregations (skew-safe)."""
    puts = replayed.where(F.col("op") == "put")
    last = replayed.groupBy(key).agg(F.max("epoch").alias("epoch"))
    top = puts.groupBy(key, "epoch").agg(F.max("version").alias("_top"))
    cur = puts.join(last, [key, "epoch"], "left_semi").join(top, [key, "epoch"], "inner")
    return cur.select(key, "version", "format", "raw_schema", (F.col("version") == F.col("_top")).alias("is_active"))


def get(versions: DataFrame, requests: DataFrame, key: str = "schema_id") -> DataFrame:
    """Exact (id, version) lookups; version 0 / null means active.
    A request that can't be resolved is 'not found'."""
    act = versions.where("is_active").select(key, F.col("version").alias("_active"))
    r = requests.join(act, key, "left").withColumn(
        "_want", F.coalesce(F.when(F.col("version") != 0, F.col("version")), F.col("_active")))
    found = versions.withColumnRenamed("version", "_want").withColumn("_hit", F.lit(True))
    return (r.join(found, [key, "_want"], "left")
             .select(key, F.col("version").alias("requested_version"), F.when(F.col("_hit"), F.col("_want")).alias("version"),
                     "format", "raw_schema", F.when(F.col("_hit"), F.lit("ok")).otherwise(F.lit("not found")).alias("result")))


def resolve(refs: DataFrame, versions: DataFrame, key: str = "schema_id") -> DataFrame:
    """Attach the definition to many queue references (left join: an
    unresolvable reference keeps a null definition). The registry side is
    small per id; AQE turns the join into a broadcast when its measured size
    is under the broadcast threshold."""
    act = versions.where("is_active").select(key, F.col("version").alias("_active"))
    r = refs.join(act, key, "left").withColumn(
        "_want", F.coalesce(F.when(F.col("version") != 0, F.col("version")), F.col("_active")))
    v = versions.select(key, F.col("version").alias("_want"), "format")
    return (r.join(v, [key, "_want"], "left")
             .select(key, F.col("version").alias("requested_version"),
                     F.when(F.col("format").isNotNull(), F.col("_want")).alias("resolved_version"),
                     "format"))


def list_versions(versions: DataFrame, key: str = "schema_id") -> DataFrame:
    """Versions ascending."""
    return versions.select(key, "version", "is_active").orderBy(key, "version")
