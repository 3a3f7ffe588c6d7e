"""Conversation prefix trie by splitters and a skeleton.

A conversation's path is the list of its turns' names (SHA-256 of role and
text). Paths are range-partitioned and sorted, then cut into shards. A node
whose members lie in two shards is a prefix of what the last path of one and
the first path of the next have in common: these common prefixes, as a trie,
are the skeleton. It is small and broadcast. Every other node lies in one
shard, which finishes it alone from the sorted paths; of skeleton nodes a shard
gives partial sums, which a grouped reduction combines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, keep

#: A shard ends after so many conversations, or before one that would bring it over so many turns.
SHARD_ROWS, SHARD_TURNS = 50_000, 1_000_000
#: The skeleton has at most so many nodes (32 bytes and a parent each); beyond, shards are merged two by two.
SKELETON_NODES = 2_000_000
NODE = ("sid long, shard long, conv_id long, depth long, parent_sid long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, chars long, ends string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, t: the turns in order, each (turn, name, chars)."""
    d = columns(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    d = d.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn"), name.alias("name"), F.length(text).cast("long").alias("chars")).alias("t"))
    return d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt(own: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, path, chars: every conversation with its first h turns taken from
    the first conversation of its block, h = crc32(conv_id as decimal) % heads."""
    own = own.select("conv_id", F.col("t.name").alias("name"), F.col("t.chars").alias("chars"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    first = own.where(F.col("conv_id") == F.col("base")).select(
        "base", F.slice("name", 1, heads - 1).alias("bn"), F.slice("chars", 1, heads - 1).alias("bc"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")

    def joined(base, mine, kind):
        return F.concat(F.slice(F.coalesce(F.col(base), F.array().cast(kind)), F.lit(1), h), F.slice(F.col(mine), h + 1, F.size(mine)))
    return own.join(first, "base", "left").select("conv_id", joined("bn", "name", "array<binary>").alias("path"), joined("bc", "chars", "array<bigint>").alias("chars"))


def _cutter(rows: int, most_turns: int):
    """For mapInArrow over sorted paths: numbers the shards of a partition."""
    def run(batches):
        shard, n, t = 0, 0, 0
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for i, k in enumerate(b.column("path").value_lengths().to_numpy(zero_copy_only=False)):
                if n and (n >= rows or t + k > most_turns):
                    shard, n, t = shard + 1, 0, 0
                n, t, out[i] = n + 1, t + int(k), shard
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "shard"])
    return run


def skeleton(edges: list[list[bytes]]):
    """The trie of the given paths, in order: parent and name of every node (the root is 0), and the node at which each path ends."""
    parent, name, last, held = [-1], [b""], [], [0]
    before: list[bytes] = []
    for path in edges:
        d = 0
        while d < min(len(path), len(before)) and path[d] == before[d]:
            d += 1
        held = held[:d + 1]
        for x in path[d:]:
            parent.append(held[-1])
            name.append(x)
            held.append(len(parent) - 1)
        last.append(held[-1])
        before = path
    return np.array(parent, np.int64), np.frombuffer(b"".join(name), np.uint64).reshape(-1, 4), np.array(last, np.int64)


def _way(trie, node: int):
    """Node numbers from the root to ``node``, and the names on the way (as 4 numbers each)."""
    parent, name, _ = trie
    ids = [node]
    while ids[-1] > 0:
        ids.append(int(parent[ids[-1]]))
    ids = np.array(ids[::-1])
    return ids, name[ids[1:] - 1]


def _first_miss(same: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the run of true values at the start of every stretch."""
    miss = np.r_[np.flatnonzero(~same), len(same)]
    return np.minimum(miss[np.searchsorted(miss, start)] - start, size)


def _stretches(size: np.ndarray):
    start = np.r_[0, np.cumsum(size)][:-1]
    return start, np.arange(int(size.sum())) - np.repeat(start, size)


def _shard_nodes(conv, k, name, chars, left, right):
    """Node columns of one shard. conv: ids in path order; k: turns of each; name, chars: of all turns in a row;
    left, right: ways of the skeleton to both ends of the shard."""
    n, off = len(k), np.r_[0, np.cumsum(k)]
    both = np.minimum(k[1:], k[:-1])
    start, at = _stretches(both)
    same = (name[np.repeat(off[:-2], both) + at] == name[np.repeat(off[1:-1], both) + at]).all(axis=1)
    lcp = np.r_[0, _first_miss(same, start, both)]
    deep, side = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s, (_, way) in enumerate((left, right)):
        size = np.minimum(k, len(way))
        start, at = _stretches(size)
        x = _first_miss((name[np.repeat(off[:-1], size) + at] == way[at]).all(axis=1), start, size)
        side[x > deep] = s
        deep = np.maximum(deep, x)
    levels, of = [], np.zeros(n, np.int64)  # of: node of every row at the depth before
    rows = np.arange(n)
    for d in range(int(k.max(initial=0)) + 1):
        rows = rows[k[rows] >= d]
        new = np.r_[True, (np.diff(rows) > 1) | (lcp[rows[1:]] < d)] if d else np.arange(n) == 0
        st = np.flatnonzero(new)
        head = rows[st]
        node = np.cumsum(new) - 1
        sid = np.full(len(st), -1, np.int64)
        for s, (ids, _) in enumerate((left, right)):
            on = (deep[head] >= d) & (side[head] == s)
            if on.any():
                sid[on] = ids[d]
        level = {"conv": np.minimum.reduceat(conv[rows], st), "n": np.diff(np.r_[st, len(rows)]), "sid": sid, "up": of[head],
                 "chars": chars[off[head] + d - 1] if d else np.zeros(1, np.int64), "ends": np.bincount(node[k[rows] == d], minlength=len(st)), "head": head}
        levels.append(level)
        of = np.zeros(n, np.int64)
        of[rows] = node
    for d in range(len(levels) - 1, -1, -1):
        x = levels[d]
        kids, leaves, saved = np.zeros(len(x["n"]), np.int64), np.zeros(len(x["n"]), np.int64), np.zeros(len(x["n"]), np.int64)
        if d + 1 < len(levels):
            y = levels[d + 1]
            own = y["sid"] < 0  # skeleton nodes are added up after the reduction
            np.add.at(kids, y["up"][own], 1)
            np.add.at(leaves, y["up"][own], y["leaves"][own])
            np.add.at(saved, y["up"][own], y["saved"][own])
        own = x["sid"] < 0
        x["kids"], x["leaves"], x["saved"] = kids, np.where(own & (kids == 0), 1, leaves), saved + np.where(own, (x["n"] - 1) * x["chars"], 0)
    return levels


def _local(trie, edges: int):
    """For mapInArrow over rows sorted by shard: the nodes of every shard."""
    names = [f.split()[0] for f in NODE.split(", ")]

    def batch(shard, b):
        parts = [b.column(c).combine_chunks() for c in ("conv_id", "path", "chars")]
        conv, k = parts[0].to_numpy(), parts[1].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts[1].flatten()
        flat = b"".join(flat.to_pylist()) if flat.null_count == 0 else b""
        name, chars = np.frombuffer(flat, np.uint64).reshape(-1, 4), parts[2].flatten().to_numpy(zero_copy_only=False)
        left = _way(trie.value, int(trie.value[2][shard - 1]) if shard else 0)
        right = _way(trie.value, int(trie.value[2][shard]) if shard < edges else 0)
        text = [b"%d" % c for c in conv.tolist()]
        levels = _shard_nodes(conv, k, name, chars, left, right)
        for d, x in enumerate(levels):
            m = len(x["n"])
            up = levels[d - 1] if d else None
            ends = [NO_ENDS] * m
            for i in np.flatnonzero((x["ends"] > 0) | (x["sid"] >= 0)):
                said = b",".join(text[x["head"][i]:x["head"][i] + x["ends"][i]])
                ends[i] = said.decode() if x["sid"][i] >= 0 else hashlib.sha256(said).hexdigest()
            above = up["sid"][x["up"]] if d else np.full(m, -1, np.int64)
            over = up["conv"][x["up"]] if d else np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(x["sid"], mask=x["sid"] < 0), pa.array(np.full(m, shard, np.int64)), pa.array(x["conv"]), pa.array(np.full(m, d, np.int64)),
                pa.array(above, mask=above < 0), pa.array(over, mask=above >= 0) if d else pa.nulls(m, pa.int64()), pa.array(x["n"].astype(np.int64)), pa.array(x["kids"]),
                pa.array(x["leaves"]), pa.array(x["saved"]), pa.array(x["chars"]), pa.array(ends)], names=names)

    def run(batches):
        held, now = [], None
        for b in batches:
            no = b.column("no").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(no)) + 1, len(no)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j <= i:
                    continue
                if now is not None and no[i] != now:
                    yield from batch(now, pa.Table.from_batches(held))
                    held = []
                now = int(no[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from batch(now, pa.Table.from_batches(held))
    return run


def _joined_ends(batches):
    """Streams (sid, ends) sorted by sid and shard: one SHA-256 a sid, in constant memory."""
    now, h = None, None
    for b in batches:
        out = []
        for sid, ends in zip(b.column("sid").to_pylist(), b.column("ends").to_pylist()):
            if sid != now:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = sid, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["sid", "sha"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], names=["sid", "sha"])


def _cut(paths: DataFrame, rows: int, most_turns: int):
    """Sorted paths with idx (in global order) and no (the shard), and the common
    prefixes of the paths on both sides of every border between shards."""
    spark = paths.sparkSession
    d = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    d = d.mapInArrow(_cutter(rows, most_turns), "conv_id long, path array<binary>, chars array<long>, shard long")
    d = keep(d.withColumn("idx", F.monotonically_increasing_id()), "paths")
    d = d.withColumn("chunk", F.shiftright("idx", 33))
    shards = sorted(tuple(r) for r in d.groupBy("chunk", "shard").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).select("lo", "hi", "chunk", "shard").collect())
    border = [(i, shards[i - 1][1], shards[i][0]) for i in range(1, len(shards))]
    edge = spark.createDataFrame(border, "no long, a long, b long")
    side = lambda c: d.join(F.broadcast(edge.select("no", F.col(c).alias("idx"))), "idx").select("no", F.col("path").alias(f"path_{c}"))
    differ = F.array_position(F.zip_with(F.slice("path_a", F.lit(1), F.least(F.size("path_a"), F.size("path_b"))),
                                         F.slice("path_b", F.lit(1), F.least(F.size("path_a"), F.size("path_b"))), lambda x, y: x != y), True)
    common = F.when(differ > 0, (differ - 1).cast("int")).otherwise(F.least(F.size("path_a"), F.size("path_b")))
    border = keep(side("a").join(side("b"), "no").select("no", common.alias("n"), F.slice("path_a", F.lit(1), common).alias("path")), "borders")
    return d, shards, border


def prefix_trie(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS, skeleton_nodes: int = SKELETON_NODES) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by ``turn``, null first; ties by the SHA-256 of their role and text, so repeated rows are turns
    of their own. Null role or text is empty. Rows with a null conv_id belong to no conversation and are
    left out; other columns are not read. An empty table has no nodes. conv_id - conv_id % 100 rounds toward
    zero. A conversation's names (40 bytes a turn, never its texts) are one row, as is the list of a shard."""
    spark = rows.sparkSession
    paths = keep(rebuilt(keep(turns(rows, conv_col, turn_col, role_col, text_col), "turns")), "rebuilt")
    d, shards, border = _cut(paths, shard_rows, shard_turns)
    step, total = 1, border.agg(F.sum("n")).first()[0] or 0
    while total > skeleton_nodes and step < len(shards):  # an upper bound: shared prefixes count for every border
        step *= 2
        total = border.where(F.col("no") % step == 0).agg(F.sum("n")).first()[0] or 0
    edges = [r.path for r in sorted(border.where(F.col("no") % step == 0).collect(), key=lambda r: r.no)]
    trie = skeleton([[bytes(x) for x in p] for p in edges])
    shared = spark.sparkContext.broadcast(trie)
    number = spark.createDataFrame([(c, s, i // step) for i, (_, _, c, s) in enumerate(shards)], "chunk long, shard long, no long")
    d = d.join(F.broadcast(number), ["chunk", "shard"]).select("no", "idx", "conv_id", "path", "chars")
    d = d.repartitionByRange("no").sortWithinPartitions("no", "idx")
    nodes = keep(d.mapInArrow(_local(shared, len(edges)), NODE), "nodes")

    partial = nodes.where("sid IS NOT NULL")
    reduced = partial.groupBy("sid").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars")).collect()  # as many as the skeleton has
    ends = partial.where("ends <> ''").select("sid", "shard", "ends").repartition("sid").sortWithinPartitions("sid", "shard")
    ends = ends.mapInArrow(_joined_ends, "sid long, sha string")
    known = {r.sid: r for r in reduced}
    kids, leaves, saved = ({r.sid: r[c] for r in reduced} for c in ("kids", "leaves", "saved"))
    out = []
    for r in sorted(reduced, key=lambda r: -r.depth):
        up = int(trie[0][r.sid])
        if not kids[r.sid]:
            leaves[r.sid] = 1
        saved[r.sid] += (r.n - 1) * r.chars
        if up >= 0:
            kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[r.sid], saved[up] + saved[r.sid]
        out.append((r.sid, r.conv_id, r.depth, known[up].conv_id if up >= 0 else None, r.n, kids[r.sid], leaves[r.sid], saved[r.sid]))
    top = spark.createDataFrame(out, "sid long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = top.join(ends, "sid", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).select(*cols)
    over = F.broadcast(top.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("over")))
    rest = nodes.where("sid IS NULL").join(over, "parent_sid", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("over", "parent_conv_id")).withColumn("ends_sha256", F.col("ends"))
    return done.unionByName(rest.select(*cols))


SQL = r"""
WITH d AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS name, length(text) AS chars FROM d),
o AS (SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(chars ORDER BY turn NULLS FIRST, name) AS chars FROM t GROUP BY conv_id),
h AS (
  SELECT *, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda x, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(x, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.names, [])[1:h.h], h.names[h.h + 1:]) AS names, list_concat(coalesce(b.chars, [])[1:h.h], h.chars[h.h + 1:]) AS chars
  FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (
  SELECT conv_id, d, array_to_string(names[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(names[1:d - 1], '') END AS up,
         CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, len(names) = d AS ends
  FROM (SELECT *, unnest(range(len(names) + 1)) AS d FROM r)),
n AS (
  SELECT node, any_value(up) AS up, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY node),
c AS (SELECT up, count(*) AS k FROM n GROUP BY up),
s AS (SELECT DISTINCT a.node AS top, b.node AS node FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d),
x AS (
  SELECT s.top, CAST(sum(n.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE c.k IS NULL) AS n_leaves
  FROM s JOIN n ON n.node = s.node LEFT JOIN c ON c.up = s.node GROUP BY s.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.k, 0) AS n_children, x.n_leaves, x.saved_tokens, n.ends_sha256
FROM n JOIN x ON x.top = n.node LEFT JOIN c ON c.up = n.node LEFT JOIN n p ON p.node = n.up
"""
