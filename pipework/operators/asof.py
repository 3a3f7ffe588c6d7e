"""As-of joins of change streams: each row with the last change at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipework.operators.scan import ordered_scan


def asof_join(left: DataFrame, right: DataFrame, key: list[str], order: list[str], carry: list[str], name: str,
              chunk: Column | str, heavy_rows: int | None = None) -> DataFrame:
    """``left`` with ``name``: the ``carry`` columns (as a struct) of the last row of
    ``right`` with the same ``key`` at or before the row in ``order``; null if there
    is none or a key is null. At equal order the change comes first.

    Both sides go through one :func:`ordered_scan` as a union, so keys of many
    rows are cut into chunks of ``chunk`` and no key is gathered in one task."""
    value = F.struct(*carry)
    kind = right.select(value.alias("v")).schema["v"].dataType
    changes = right.select(*key, *order, F.lit(0).alias("_side"), value.alias("_change"))
    rows = left.withColumn("_side", F.lit(1)).withColumn("_change", F.lit(None).cast(kind))
    both = rows.unionByName(changes, allowMissingColumns=True)
    seen = ordered_scan(both, key, [*order, "_side"], chunk, lasts={name: F.col("_change")}, heavy_rows=heavy_rows)
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return seen.where("_side = 1").withColumn(name, F.when(known, F.col(name))).drop("_side", "_change")
