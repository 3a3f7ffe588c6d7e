"""Base table access.

Tables are parquet files ``<dir>/<name>.parquet``. Reads are lazy so Catalyst
prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_all(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register base tables as temp views (for SQL users)."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
