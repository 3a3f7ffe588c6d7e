"""Schema gating.

Only ``schema_id`` is compared (nominal schemas); payload bytes are never
decoded. A null id counts as missing (never silently lost).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "missing_schema_id"
MISMATCH = "schema_mismatch"


def _id(col: str = "schema_id") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def output_ok(queue_schema: str | None, col: str = "schema_id") -> Column:
    """B1 predicate: queue without schema → pass; empty id → pass (stamped);
    equal → pass; different → reject."""
    if not queue_schema:
        return F.lit(True)
    return _id(col).isin("", queue_schema)


def stamp_output(df: DataFrame, queue_schema: str | None, col: str = "schema_id") -> DataFrame:
    """B1: keep rows admitted by the output queue and stamp empty ids."""
    if not queue_schema:
        return df
    return (df.where(output_ok(queue_schema, col))
              .withColumn(col, F.when(_id(col) == "", F.lit(queue_schema)).otherwise(F.col(col))))


def input_ok(queue_schema: str | None, col: str = "schema_id") -> Column:
    """B2 predicate: queue without schema → pass; else id must equal it."""
    if not queue_schema:
        return F.lit(True)
    return _id(col) == F.lit(queue_schema)


def gate_input(df: DataFrame, queue_schema: str | None, col: str = "schema_id") -> DataFrame:
    """B2: rows a consumer of the queue accepts."""
    return df.where(input_ok(queue_schema, col))


def reject_reason(queue_schema: str | None, col: str = "schema_id", stage_input: bool = True) -> Column:
    """Reason a row is rejected (null = accepted). Input gates reject an
    empty id as missing; output stamping accepts it."""
    if not queue_schema:
        return F.lit(None).cast("string")
    sid = _id(col)
    if stage_input:
        return (F.when(sid == "", F.lit(MISSING))
                 .when(sid != F.lit(queue_schema), F.lit(MISMATCH)))
    return F.when(~sid.isin("", queue_schema), F.lit(MISMATCH))


def rejects(df: DataFrame, queue_schema: str | None, col: str = "schema_id",
            stage_input: bool = True, queue: str | None = None) -> DataFrame:
    """The quarantine side output with a reason column."""
    r = reject_reason(queue_schema, col, stage_input)
    out = df.withColumn("reason", r).where(F.col("reason").isNotNull())
    if queue is not None:
        out = out.withColumn("queue", F.lit(queue))
    return out.withColumn("expected_schema_id", F.lit(queue_schema))


def split_gate(df: DataFrame, queue_schema: str | None, col: str = "schema_id",
               stage_input: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined). Both read the same input; callers that write
    both should persist or checkpoint the input once."""
    if stage_input:
        acc = gate_input(df, queue_schema, col)
    else:
        acc = stamp_output(df, queue_schema, col)
    return acc, rejects(df, queue_schema, col, stage_input)


def gated_transform(df: DataFrame, in_schema: str | None, out_schema: str | None,
                    fn=None, set_schema: bool = False, col: str = "schema_id") -> DataFrame:
    """Input gate → transform (metadata inherited) → output stamp.

    By default the transform inherits the input's ``schema_id`` (reference
    behaviour), so a flow that changes schema between queues drops every row
    at the output. ``set_schema=True`` lets the transform stamp the output
    queue's id instead."""
    x = gate_input(df, in_schema, col)
    if fn is not None:
        x = fn(x)
    if set_schema and out_schema:
        x = x.withColumn(col, F.lit(out_schema))
    return stamp_output(x, out_schema, col)
