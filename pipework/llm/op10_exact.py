"""Exact duplicates by deterministic block naming (DataFrame functions only).

Texts are cut into blocks of a fixed number of UTF-8 bytes. Distinct blocks are
sorted and get integer names; then adjacent pairs of names are named again,
level by level, until each document has one name. Two documents have the same
(blocks, name) exactly when their texts are equal: names come from comparing
contents, never from a hash, so nothing can collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import columns, keep

#: A key with more than this share of the rows counts as hot; there can be at
#: most as many hot keys as this number.
HOT_KEYS = 1000
#: A key with fewer rows is never hot.
HOT_FLOOR = 64


#: A key that isn't hot but has more rows than this, or than 1/SPREAD_KEYS of all rows if
#: that is more, is dealt over several tasks; there can be at most SPREAD_KEYS.
SPREAD_FLOOR = 2000
SPREAD_KEYS = 1_000_000


def _frequent(keyed: DataFrame, key: str) -> tuple[list[int], DataFrame | None]:
    """Hashes of the hot keys, those that hold over 1/HOT_KEYS of the rows (under HOT_KEYS
    of them), and (__h, __n) of the keys to deal over __n tasks, or None: two
    numbers a key, fewer than SPREAD_KEYS whatever the number of rows."""
    seen = Observation()
    counts = keyed.groupBy(F.xxhash64(key).alias("h")).agg(F.count("*").alias("c"))
    counts = keep(counts.observe(seen, F.sum("c").alias("rows")).where(F.col("c") > HOT_FLOOR), "counts")
    rows = seen.get["rows"] or 0
    floor, part = max(rows // HOT_KEYS, HOT_FLOOR), max(rows // SPREAD_KEYS, SPREAD_FLOOR)
    hot = [r.h for r in counts.where(F.col("c") > floor).select("h").collect()]
    spread = counts.where((F.col("c") > part) & (F.col("c") <= floor))
    if part >= floor or spread.isEmpty():
        return hot, None
    return hot, spread.select(F.col("h").alias("__h"), F.ceil(F.col("c") / F.lit(part)).cast("long").alias("__n"))


def _joined(rows: DataFrame, side: DataFrame, key: str, spread: DataFrame | None) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row a key), keys of ``spread`` in several
    shares: a row's share follows from its other columns, ``side`` goes to each."""
    if spread is None:
        return rows.join(side, key)
    shares = F.coalesce("__n", F.lit(1).cast("long"))
    told = lambda df: df.withColumn("__h", F.xxhash64(key)).join(F.broadcast(spread), "__h", "left")
    mine = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), shares)
    r = told(rows).withColumn("__share", mine).drop("__h", "__n")
    s = told(side).withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("__h", "__n")
    return r.join(s, [key, "__share"]).drop("__share")


def name_keys(keyed: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: an integer equal exactly for equal ``key`` values.

    Keys are grouped (with map-side combining) and sorted, and numbered in that
    order; rows get the number by a join that is already partitioned by key, rows of
    frequent keys by shares. The few hot keys (bounded by HOT_KEYS) are numbered
    apart, below zero, and reach their rows by broadcast, so no hot key is shuffled
    row by row."""
    hot, spread = _frequent(keyed, key)
    is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    cold = keyed.where(~is_hot)
    names = (cold.groupBy(key).agg(F.count("*").alias("__c")).drop("__c")
             .sortWithinPartitions(key).withColumn(out, F.monotonically_increasing_id()))
    if spread is not None:
        names = keep(names, "names")   # numbered once, before shares of it are dealt
    named = _joined(cold, names, key, spread)
    if hot:
        few = keyed.where(is_hot).groupBy(key).agg(F.count("*").alias("__c")).drop("__c")
        few = few.agg(F.sort_array(F.collect_set(key)).alias("k")).select(F.posexplode("k").alias("__p", key))
        few = few.select(key, (-F.col("__p").cast("long") - 1).alias(out))
        named = named.unionByName(keyed.where(is_hot).join(F.broadcast(few), key))
    return named


def block_names(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row per distinct (doc_id, sha) with ``copies`` (its rows), ``n_blocks``
    and ``name``; docs needs doc_id, text (no nulls) and sha."""
    whole = F.col("text").cast("binary")  # slices of binary cost nothing, of strings a scan
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("int")
    blocks = docs.select(
        "doc_id", "sha", n.alias("n_blocks"),
        F.posexplode_outer(F.transform(F.sequence(F.lit(0), n - 1),
                                 lambda i: F.substring(whole, i * block_bytes + 1, F.lit(block_bytes)))).alias("at", "block"))
    level = name_keys(blocks, "block", "name").drop("block")
    level = keep(level.groupBy("doc_id", "sha", "n_blocks", "at")
                 .agg(F.max("name").alias("name"), F.count("*").alias("copies")), "blocks")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, width = level.where("n_blocks = 1").drop("at"), 1
    level = level.where("n_blocks > 1")
    while width < most:
        pairs = (level.groupBy("doc_id", "sha", "n_blocks", F.expr("at div 2").alias("at"))
                 .agg(F.struct(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("l"),
                               F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("r")).alias("pair"),
                      F.max("copies").alias("copies")))
        width *= 2
        level = keep(name_keys(pairs, "pair", "name").drop("pair"), "pairs")
        ready = F.col("n_blocks") <= width
        done = done.unionByName(level.where(ready).drop("at"))
        level = level.where(~ready)
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 4096) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id (largest doc_id of the group),
    group_size (rows), kept, text_sha256; one row per row of ``docs``.

    Null text is empty. A null id is in a group but is only its keep_id when no
    row has an id; repeated rows (same id, same text) each count and each come
    back, all of them kept if the id is the keep_id. Other columns of ``docs``
    are not read. An empty table gives an empty result."""
    d = columns(docs, doc_id=id_col, text=text_col)
    d = d.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("sha", F.sha2("text", 256))
    names = block_names(d, block_bytes)
    named = keep(names.select("doc_id", "sha", "copies", F.struct("n_blocks", "name").alias("identity")), "named")
    group = named.groupBy("identity").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    hot, spread = _frequent(named.select("identity", "copies"), "identity")
    is_hot = F.xxhash64("identity").isin(hot) if hot else F.lit(False)
    out = _joined(named.where(~is_hot), group.where(~is_hot), "identity", spread)
    if hot:
        out = out.unionByName(named.where(is_hot).join(F.broadcast(group.where(is_hot)), "identity"))
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


SQL = """
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT doc_id, text, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
