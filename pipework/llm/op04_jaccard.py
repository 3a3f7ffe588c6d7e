"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns their 5-word shingles. All
columns have one order, rare ones first: by a table of counts of fixed size,
then by hash. The first block of a row holds as many columns as a pair must
share one of to reach the bound; only pairs that meet in a first block can, and
size, place and bitmap bounds on the overlap discard most of those. For the
pairs left the product is accumulated slice by slice of the columns: grouped
sums of shared columns, and after each block pairs are dropped whose count and
columns still to come can't reach the bound from their sizes.

A column is not multiplied out: first each of its documents is paired with
one centre; then only columns whose documents are not yet all linked are
gone through again, and only documents outside the centre's component are
paired with others of the column. Pairs inside a component could not change
the result, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ODD, byte_chunks, columns, keep, maybe_broadcast, mix, word_hashes, words
from .components import components

SHINGLE = 5
#: A column is common if it has over 1 of this many documents of some batch (4 at
#: least). Common columns come last and are salted; at most MOST of them, the
#: most frequent ones. Both only decide an order: the result doesn't depend on them.
COMMON = 500
MOST = 100_000
SALTS = 64
#: Counts of columns are kept by hash modulo SLOTS, in rows of SLOT_ROW; they too only decide the order.
SLOTS, SLOT_ROW = 1 << 20, 1 << 12
#: The columns in slices by hash, and the slices of each block in which the product is accumulated.
SLICES, BLOCKS = 8, ((0, 1), (2, 3, 4, 5, 6, 7))
#: Columns that are compared at once inside a task (one pair at least).
STEP = 500_000
SEEN = "kind int, doc long, n int, bits binary, h long, c long"
ENTRY = "link boolean, h long, salt int, doc long, n int, pos int"


def shingle_sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every row with words."""
    for lo, _, data, off in byte_chunks(column):
        s, e, first = words(data, off)
        h = word_hashes(LOWER[data], s, e)
        full = np.zeros(0, np.uint64)
        if len(h) >= SHINGLE:
            full = np.full(len(h) - SHINGLE + 1, SHINGLE, np.uint64) * ODD[14]
            for j in range(SHINGLE):
                full = full + h[j:len(h) - SHINGLE + 1 + j] * ODD[j]
            full = mix(full)
        for i in np.flatnonzero(np.diff(first)):
            a, b = first[i], first[i + 1]
            if b - a < SHINGLE:
                yield lo + int(i), mix(np.full(1, b - a, np.uint64) * ODD[14] + (h[a:b] * ODD[:b - a]).sum(dtype=np.uint64))
            else:
                x = np.sort(full[a:b - SHINGLE + 1])
                yield lo + int(i), x[np.r_[True, x[1:] != x[:-1]]]


def bitmap(x: np.ndarray) -> bytes:
    """Parity bitmap of a set, of 1 to 2 bits a member."""
    size = max(64, 1 << int(len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


#: Text bytes whose sets a task holds at once (one document at least).
PART_BYTES = 4 << 20


def _parts(batches):
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PART_BYTES, side="right")))
            yield b.slice(i, j - i)
            i = j


def _sets(b):
    """Ids and set sizes of a batch in order of id; (row, set) for the first of equal
    sets only; (row, first row) for the others."""
    ids = b.column("doc").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    ids, text = ids[order], b.column("text").take(pa.array(order))
    seen, out, copies, sizes = {}, [], [], np.zeros(len(ids), np.int64)
    for i, x in shingle_sets(text):
        sizes[i] = len(x)
        key = (len(x), int(x.sum(dtype=np.uint64)), int(mix(x + ODD[9]).sum(dtype=np.uint64)))
        if key in seen:
            copies.append((i, seen[key]))
        else:
            seen[key] = i
            out.append((i, x))
    return ids, sizes, out, copies


def _survey(batches):
    names = [f.split()[0] for f in SEEN.split(", ")]
    slots = np.zeros(SLOTS, np.int64)
    for b in _parts(batches):
        ids, sizes, out, copies = _sets(b)
        bits = {i: bitmap(x) for i, x in out}
        bits.update({i: bits[j] for i, j in copies})
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int32)),
                                          pa.array([bits.get(i) for i in range(n)], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                                         names=[f.split()[0] for f in SEEN.split(", ")])
        if out:
            h, c = np.unique(np.concatenate([x for _, x in out]), return_counts=True)
            np.add.at(slots, (h & np.uint64(SLOTS - 1)).astype(np.int64), c)
            on = c >= max(4, len(out) // COMMON)
            m = int(on.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                                              pa.array(h[on].astype(np.int64)), pa.array(c[on], pa.int64())],
                                             names=[f.split()[0] for f in SEEN.split(", ")])


    if slots.any():
        rows = np.minimum(slots, 65535).astype("<u2").reshape(-1, SLOT_ROW)
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary()),
                                          pa.array(np.arange(n)), pa.nulls(n, pa.int64())], names=names)


def _slot_sums(batches):
    """Streams rows of counts sorted by place; one byte a slot comes out: its count, logarithmically."""
    at, total = None, None
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())], names=["h", "bits"])
    for b in batches:
        for h, bits in zip(b.column("h").to_pylist(), b.column("bits")):
            if h != at:
                if total is not None:
                    yield pack()
                at, total = h, np.zeros(SLOT_ROW, np.int64)
            total += np.frombuffer(bits.as_buffer(), "<u2")
    if total is not None:
        yield pack()


def frequencies(seen: DataFrame) -> np.ndarray:
    """One byte for each of SLOTS slots, 1 MB in all."""
    rows = seen.where("kind = 2").select("h", "bits").repartition("h").sortWithinPartitions("h").mapInArrow(_slot_sums, "h long, bits binary").collect()
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.uint8)
    for r in rows:
        out[r.h] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _entries(batches, common):
    """First-block entries of the matrix, and links between equal sets of a batch."""
    known, rank, often = common.value
    names = [f.split()[0] for f in ENTRY.split(", ")]
    for b in _parts(batches):
        ids, _, out, copies = _sets(b)
        if copies:
            doc, rep = (ids[x] for x in np.array(copies).T)
            z = np.zeros(len(doc), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z == 0), pa.array(rep), pa.array(z), pa.array(doc), pa.array(z), pa.array(z)], names=names)
        parts = []
        for i, x in out:
            n = len(x)
            size = n - -(-4 * n // 5) + 1
            if len(known):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                on = known[at] == x
            else:
                on = np.zeros(n, bool)
            light = x[~on]
            light = light[np.argsort(often[(light & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")][:size]
            heavy = x[on][np.argsort(rank[at[on]])][:size - len(light)] if on.any() else x[:0]
            h = np.r_[light, heavy]
            salt = np.zeros(len(h), np.int32)
            salt[len(light):] = 1 + int(mix(np.array([ids[i]], np.int64).astype(np.uint64))[0]) % SALTS
            pos = np.arange(len(h), dtype=np.int32)
            pos[len(light):] += int((~on).sum()) - len(light)
            parts.append((h.astype(np.int64), salt, np.full(len(h), ids[i]), np.full(len(h), n, np.int32), pos))
        if parts:
            h, salt, doc, n, pos = [np.concatenate(p) for p in zip(*parts, strict=True)]
            whole = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), bool)), pa.array(h), pa.array(salt), pa.array(doc), pa.array(n), pa.array(pos)], names=names)
            for k in range(0, len(h), 200_000):
                yield whole.slice(k, 200_000)


def _shared_columns(batches):
    """Streams entries sorted by (h, salt) and drops columns of one document. Holds one row over."""
    key, held = None, None
    for b in batches:
        link = b.column("link").to_numpy(zero_copy_only=False).astype(bool)
        if link.any():
            yield b.filter(pa.array(link))
            b = b.filter(pa.array(~link))
        if not b.num_rows:
            continue
        h, salt = b.column("h").to_numpy(), b.column("salt").to_numpy()
        new = np.r_[int(h[0]) != key, h[1:] != h[:-1]]
        run = np.cumsum(new)
        size = np.bincount(run)
        if size[0] and held is not None:
            yield held
        go = (size[run] >= 2) | (run == 0) | (salt > 0)
        if run[-1] > 0 or size[0]:
            held = None
        if run[-1] > 0 and size[-1] == 1 and salt[-1] == 0:
            held = b.slice(b.num_rows - 1, 1)
        if go.any():
            yield b.filter(pa.array(go))
        key = int(h[-1])


def _stacked(column: pa.Array):
    """Bytes and row offsets of a binary column."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def _could_link(batches):
    """Drops pairs whose bitmaps leave too little overlap; all pairs of the same two bitmap sizes at once."""
    for b in batches:
        n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        (p, po), (q, qo) = _stacked(b.column("bits_a")), _stacked(b.column("bits_b"))
        sizes, ok = np.stack([np.diff(po), np.diff(qo)]), np.zeros(b.num_rows, bool)
        for u, v in np.unique(sizes, axis=1).T:
            at = np.flatnonzero((sizes[0] == u) & (sizes[1] == v))
            for i in range(0, len(at), max(1, (8 << 20) // int(max(u, v)))):
                j = at[i:i + max(1, (8 << 20) // int(max(u, v)))]
                x, y = p[po[j, None] + np.arange(u)], q[qo[j, None] + np.arange(v)]
                if u < v:
                    x, y = y, x
                if u != v:  # a bitmap of half the size is the exclusive or of the halves
                    x = np.bitwise_xor.reduce(x.reshape(len(j), -1, y.shape[1]), axis=1)
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                ok[j] = 9 * ((n[j] + m[j] - differ) // 2) >= 4 * (n[j] + m[j])
        yield b.select(["a", "b"]).filter(pa.array(ok))


SLICE = "doc long, r long, k int, n int, past int, cols binary"
COUNT = "a long, b long, ra long, rb long, got int, n int, m int, left_a int, left_b int"


def _slices(batches):
    """Every set in slices of the columns, with its size and how many columns come before the slice's end."""
    names = [f.split()[0] for f in SLICE.split(", ")]
    for b in batches:
        ids, rids = b.column("doc").to_numpy(), b.column("r").to_numpy()
        for i, x in shingle_sets(b.column("text")):
            cut = np.searchsorted(x, np.arange(1, SLICES, dtype=np.uint64) << np.uint64(61))
            ends = np.r_[cut, len(x)]
            rows = [x[p:q].tobytes() for p, q in zip(np.r_[0, cut], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(SLICES, ids[i])), pa.array(np.full(SLICES, rids[i])), pa.array(np.arange(SLICES, dtype=np.int32)),
                                              pa.array(np.full(SLICES, len(x), np.int32)), pa.array(ends.astype(np.int32)), pa.array(rows, pa.binary())], names=names)


def _shared(batches):
    """Shared columns of each pair in one slice."""
    for b in batches:
        (p, po), (q, qo) = ((d.view(np.uint64) if len(d) else np.zeros(0, np.uint64), o // 8) for d, o in (_aligned(b.column(c)) for c in ("cols_a", "cols_b")))
        got, i = np.zeros(b.num_rows, np.int32), 0
        while i < b.num_rows:  # about STEP columns at once
            j = max(i + 1, int(np.searchsorted(po + qo, po[i] + qo[i] + STEP, side="right")) - 1)
            # a row's hashes get a tag of the row, so that one pass compares all rows
            row = [np.repeat(np.arange(i, j), np.diff(o[i:j + 1])) for o in (po, qo)]
            x, y = (d[o[i]:o[j]] + mix(r.astype(np.uint64) + ODD[8]) for d, o, r in ((p, po, row[0]), (q, qo, row[1])))
            got[i:j] = np.bincount(row[0][np.isin(x, y)] - i, minlength=j - i)
            i = j
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "ra", "rb")] + [pa.array(got)]
                                         + [b.column(c) for c in ("n", "m", "left_a", "left_b")], names=[f.split()[0] for f in COUNT.split(", ")])


def _aligned(column: pa.Array):
    data, off = _stacked(column)
    return np.ascontiguousarray(data[off[0]:off[-1]]), off - off[0]


def _verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are links: bitmap bound first, then the overlap, block by block.
    Rows of one id are looked at one by one (ra, rb)."""
    e = sizes.where("bits IS NOT NULL")
    side = lambda c: e.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_could_link, "a long, b long").distinct(), f"{name}-may")
    docs = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), f"{name}-docs")
    rows = texts.join(maybe_broadcast(docs, 500_000), "doc", "left_semi").withColumn("r", F.monotonically_increasing_id())
    sets = keep(rows.mapInArrow(_slices, SLICE), f"{name}-sets")
    counted, on = pairs, {"a": ("a", "doc"), "b": ("b", "doc")}
    for i, block in enumerate(BLOCKS):
        part = sets.where(F.col("k").isin(*block))
        x = part.select(F.col(on["a"][1]).alias(on["a"][0]), *([F.col("r").alias("ra")] if not i else []), "k", "n", F.col("cols").alias("cols_a"), (F.col("n") - F.col("past")).alias("left_a"))
        y = part.select(F.col(on["b"][1]).alias(on["b"][0]), *([F.col("r").alias("rb")] if not i else []), "k", F.col("n").alias("m"), F.col("cols").alias("cols_b"), (F.col("n") - F.col("past")).alias("left_b"))
        before = counted.select("a", "b", "ra", "rb", F.col("got").alias("before")) if i else None
        met = (counted.select("a", "b", "ra", "rb") if i else counted).join(x, on["a"][0]).join(y, [on["b"][0], "k"])
        met = met.mapInArrow(_shared, COUNT).groupBy("a", "b", "ra", "rb").agg(
            F.sum("got").alias("got"), F.max("n").alias("n"), F.max("m").alias("m"), F.least(F.min("left_a"), F.min("left_b")).alias("left"))
        if i:
            met = met.join(before, ["a", "b", "ra", "rb"]).withColumn("got", F.col("got") + F.col("before"))
        counted = keep(met.where(9 * (F.col("got") + F.col("left")) >= 4 * (F.col("n") + F.col("m"))), f"{name}-block")
        on = {"a": ("ra", "r"), "b": ("rb", "r")}
    return counted.select("a", "b").distinct()


def _reach(x: str, y: str):
    """Bounds for a pair whose first common column is this one: sizes within 4/5, and enough columns left on both sides."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * left >= 4 * (n + m))


def _per_column(entries: DataFrame, per: DataFrame) -> DataFrame:
    """entries joined with one row per column; the common columns (MOST at most) by broadcast."""
    light = entries.where("salt = 0").join(per.where("NOT common"), "h")
    heavy = entries.where("salt > 0").join(F.broadcast(per.where("common")), "h")
    return light.unionByName(heavy)


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links); one row per row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased;
    fewer than five make one shingle. Documents link at a Jaccard similarity of
    0.8 or more. Null or wordless texts have no shingles and link with nothing.
    Words and shingles are known by 64-bit hashes, which decide. An empty table gives no rows.
    Rows that share an id are one node with the links of all of them (each row
    has its own n_shingles); rows with a null id have a null component and no
    links. Other columns are not read."""
    spark = docs.sparkSession
    d = columns(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    seen = keep(d.mapInArrow(lambda bs: _survey_nulls(bs), SEEN), "survey")
    sizes = seen.where("kind = 0").select("doc", "n", "bits")
    top = (seen.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(MOST)
           .orderBy("c", "h").select("h").collect())
    order = np.array([r.h for r in top], np.int64).astype(np.uint64)
    at = np.argsort(order)
    common = spark.sparkContext.broadcast((order[at], at, frequencies(seen)))  # MOST numbers and SLOTS bytes at most
    texts = d.where("doc IS NOT NULL AND text IS NOT NULL")
    entries = texts.mapInArrow(lambda bs: _entries(bs, common), ENTRY).repartition("h", "salt").sortWithinPartitions("h", "salt")
    entries = keep(entries.mapInArrow(_shared_columns, ENTRY), "entries")
    links = entries.where("link").select(F.col("doc").alias("a"), F.col("h").alias("b"))
    entries = entries.where("NOT link").drop("link")

    pair = lambda x, y: (F.least(F.col(f"{x}.doc"), F.col(f"{y}.doc")).alias("a"), F.greatest(F.col(f"{x}.doc"), F.col(f"{y}.doc")).alias("b"))
    centre = F.min(F.struct("pos", "n", "doc")).alias("c")
    centres = keep(entries.groupBy("h").agg(centre, F.max("doc").alias("hi"), F.min("doc").alias("lo"), (F.max("salt") > 0).alias("common")).where("hi > lo"), "centres")
    star = _per_column(entries.withColumn("e", F.struct("pos", "n", "doc")).select("h", "salt", "e"), centres.select("h", "c", "common"))
    star = star.where((F.col("e.doc") != F.col("c.doc")) & _reach("e", "c")).select(*pair("e", "c")).distinct()
    found = links.unionByName(_verified(star, texts, sizes, "star"))
    comps = components(found)

    e = entries.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    e = keep(e.select("h", "salt", F.struct("pos", "n", "doc", "comp").alias("e")), "members")
    mixed = e.groupBy("h").agg(F.min("e").alias("c"), F.min("e.comp").alias("lo"), F.max("e.comp").alias("hi"), (F.max("salt") > 0).alias("common"))
    mixed = keep(mixed.where("hi <> lo").select("h", F.col("c.comp").alias("centre"), "common"), "mixed")
    rest = keep(_per_column(e, mixed).select("h", "e", (F.col("e.comp") != F.col("centre")).alias("out")), "rest")
    x, y = rest.where("out").select("h", F.col("e").alias("x")), rest.select("h", F.col("e").alias("y"), "out")
    late = x.join(y, "h").where((F.col("x.comp") != F.col("y.comp")) & (~F.col("out") | (F.col("x.doc") < F.col("y.doc"))) & _reach("x", "y"))
    found = found.unionByName(_verified(late.select(*pair("x", "y")).distinct(), texts, sizes, "late"))
    comps = components(found)
    return sizes.join(comps, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))


def _survey_nulls(batches):
    """Rows with a null id are measured, but kept apart from the others."""
    for b in batches:
        null = b.column("doc").is_null()
        if null.sum().as_py():
            part = b.filter(null)
            n = np.zeros(part.num_rows, np.int32)
            for i, x in shingle_sets(part.column("text")):
                n[i] = len(x)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(n), pa.nulls(m, pa.binary()),
                                              pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=[f.split()[0] for f in SEEN.split(", ")])
            b = b.filter(b.column("doc").is_valid())
        if b.num_rows:
            yield from _survey(iter([b]))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
