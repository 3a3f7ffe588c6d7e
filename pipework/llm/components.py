"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every doc of ``links`` (columns a, b): comp is the smallest doc it reaches.

    Alternates large-star and small-star steps, each a grouped minimum and a join
    of two kept tables, so that the join can split the links of a hub."""
    big, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = keep(links.where("a <> b").select(big, low).distinct(), "links")
    seen = None
    while True:
        # large star: every larger neighbour of a node links to the smallest neighbour
        both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")), "low")
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        edges = keep(edges, "large")
        # small star: a node and its smaller neighbours link to the smallest of them
        low = keep(edges.groupBy("a").agg(F.min("b").alias("m")), "low")
        edges = edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = keep(edges.select("x.*").where("a <> b").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return keep(edges.select(F.col("a").alias("doc"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("doc"), F.col("b").alias("comp"))).distinct(), "comp")
