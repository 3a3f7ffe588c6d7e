"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by their smallest doc_id. Prefix
sums of their sizes are computed by chunks; the smallest capacity at which a
greedy walk needs no more than the wanted shards is found by search, trying
several capacities in each pass over the kept prefix sums (a step of the walk
is one aggregate: the last group end within reach). Cuts are then laid within
the ranges that this capacity leaves open, as near as can be to equal shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns, keep, numbered

#: Capacities tried in one pass.
TRIES = 48


class Ends:
    """Group ends (prefix sums) of an ordered table; all lookups are aggregates."""

    def __init__(self, ends: DataFrame, total: int):
        self.ends, self.total = ends, total

    def last(self, targets: list[int], floor: int = 0) -> list[int]:
        """The last end at or below each target (floor if none)."""
        d = self.ends.where((F.col("upto") > floor) & (F.col("upto") <= max(targets)))
        row = d.agg(*[F.max(F.when(F.col("upto") <= t, F.col("upto"))).alias(f"m{i}") for i, t in enumerate(targets)]).first()
        return [floor if x is None else x for x in row]

    def around(self, target: float, low: int, high: int) -> int:
        """The end in [low, high] nearest to target."""
        d = self.ends.where(F.col("upto").between(low, high))
        row = d.agg(F.max(F.when(F.col("upto") <= target, F.col("upto"))), F.min(F.when(F.col("upto") > target, F.col("upto")))).first()
        return min((x for x in row if x is not None), key=lambda x: (abs(x - target), x), default=low)

    def first(self, target: int) -> int:
        """The first end at or above target."""
        return self.ends.where(F.col("upto") >= target).agg(F.min("upto")).first()[0]

    def feasible(self, capacities: list[int], shards: int) -> list[bool]:
        """Greedy walks for all capacities at once, one aggregate per shard."""
        at = [0] * len(capacities)
        for _ in range(shards - 1):
            if all(a + c >= self.total for a, c in zip(at, capacities, strict=True)):
                break
            got = self.last([a + c for a, c in zip(at, capacities, strict=True)], min(at))
            at = [max(a, g) for a, g in zip(at, got, strict=True)]
        return [a + c >= self.total for a, c in zip(at, capacities, strict=True)]

    def capacity(self, shards: int, largest: int) -> int:
        """The smallest capacity that holds everything in so many contiguous shards."""
        low = max(-(-self.total // shards), largest)  # may do
        high = -(-self.total // shards) + largest  # surely does
        while low < high:
            n = min(TRIES, high - low)
            tries = sorted({low + (high - low) * i // n for i in range(n)})
            ok = self.feasible(tries, shards)
            if True in ok:
                i = ok.index(True)
                high = tries[i]
                low = tries[i - 1] + 1 if i else high
            else:
                low = tries[-1] + 1
        return low

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """shards - 1 group ends: no shard above capacity, each cut as near to its equal share as that allows."""
        least = [self.total]  # from the back: the first end from which the rest still fits
        for _ in range(shards - 1):
            x = least[0] - capacity
            least.insert(0, 0 if x <= 0 else self.first(x))
        out, at = [], 0
        for j in range(1, shards):
            low, high = max(least[j - 1], at), min(at + capacity, self.total)
            share = self.total * j / shards
            at = self.around(min(max(share, low), high), low, high) if high > low else low
            out.append(at)
        return out


def shard(docs: DataFrame, shards: int = 16, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law ("bytes"), shard, slot
    (gapless from 0 in each shard), grown_shard (null: for this law one more
    shard moves every cut), group_first (smallest doc_id of its equal texts).

    Null text counts as empty. Groups whose ids are all null come first. Rows
    that share an id, and repeated rows, get a slot each. With fewer groups
    than shards some shards are empty. Other columns are not read; an empty
    table gives no rows."""
    d = columns(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    rows = keep(d.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.unhex(F.sha2(text, 256)).alias("same")), "rows")
    groups = keep(rows.groupBy("same").agg(F.min("doc_id").alias("group_first")), "groups")
    rows = rows.join(groups, "same")  # plain shuffles on both sides, so that a hot text is split
    placed, chunks = numbered(rows, ["group_first", "same", "doc_id"], "ordered")
    spark = docs.sparkSession
    sums = {r.chunk: r.s for r in placed.groupBy("chunk").agg(F.sum("size").alias("s")).collect()}
    offsets, n0, s0 = [], 0, 0
    for c, n in chunks:
        offsets.append((c, n0, s0))
        n0, s0 = n0 + n, s0 + sums[c]
    starts = F.broadcast(spark.createDataFrame(offsets, "chunk long, n0 long, s0 long"))
    upto = F.sum("size").over(W.partitionBy("chunk").orderBy("idx")) + F.col("s0")
    placed = keep(placed.join(starts, "chunk").withColumn("upto", upto).withColumn("place", F.col("n0") + F.col("idx"))
                  .drop("n0", "s0", "idx", "chunk"), "placed")
    ends = placed.groupBy("same").agg(F.max("upto").alias("upto"), F.sum("size").alias("size")).drop("same")
    ends = keep(ends.repartitionByRange("upto").sortWithinPartitions("upto"), "ends")
    if s0:
        e = Ends(ends.select("upto"), s0)
        cuts = e.cuts(shards, e.capacity(shards, ends.agg(F.max("size")).first()[0]))
    else:
        cuts = [0] * (shards - 1)
    which = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", which.cast("int"))
    first = {r.shard: r.p for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    begin = F.lit(0).cast("long")
    for s, p in first.items():
        begin = F.when(F.col("shard") == s, F.lit(p)).otherwise(begin)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("place") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_first")
