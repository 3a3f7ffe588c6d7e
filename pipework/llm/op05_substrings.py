"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

Only what decides whether two ``length``-byte strings are equal is sorted.
Each string belongs to its smallest-hash q-gram (an anchor), so strings that
are equal meet in the same q-gram bucket. Buckets of one are finished. The
others are refined on the bucket identifiers of the bytes around the anchor,
from coarse to fine, each level on what the last one left open:

  1. all strings of an anchor at once, by the name of the stretch they span;
  2. blocks of eight neighbouring strings, by the bytes common to the block,
     then by the block's stretch;
  3. single strings.

At each level, members of a bucket with one name are the same strings, and
only the first (smallest doc, then start) goes on; the rest are removed.
Names are composed from hashes of adjacent pieces, and a name only counts
within its bucket, which is a hash of other bytes of the same string. Sorted
buckets are streamed with constant memory; buckets with many different
members are salted (a bucket needs two members to be refined, so copies of two
of them are left under the plain key, where they mark it and go no further).
A string that is salted in one batch and plain in another stays open for the
next level; the last level has none, so it deals by bucket and name together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, byte_rows, columns, keep, mix, numbered, run_hashes

Q = 40
BLOCK = 8
HOT = 32  # different members of a bucket within one batch from which they are salted
SALTS = 256
_PLACE = np.uint64((1 << 28) - 1)
PIECE = 1 << 26  # bytes of a chunk whose anchors are looked for at once; places in a piece must fit _PLACE
ROWS = "dup boolean, mark boolean, k long, salt int, e long, doc long, s int, len int, a int, names binary"
OPEN = "dup boolean, k long, doc long, s int, len int, a int, names binary"


def anchors(data: np.ndarray, off: np.ndarray, length: int, piece: int = PIECE):
    """Stretches of starts that share an anchor: (row, first start, number of
    starts, anchor) with places in the chunk. Longer chunks go by pieces that
    overlap by ``length - 1`` bytes, so each start is in one of them; a stretch
    that a border cuts is two stretches, which the finer levels settle."""
    if len(data) > piece:
        parts = []
        for p in range(0, len(data) - length + 1, piece - length + 1):
            row, s, count, a = anchors(data[p:p + piece], np.clip(off - p, 0, min(piece, len(data) - p)), length, piece)
            parts.append((row, s + p, count, a + p))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]
    w = length - Q + 1
    n = len(data) - Q + 1
    if n < w:
        return [np.zeros(0, np.int64)] * 4
    at = np.arange(n)
    h = run_hashes(data, at, at + Q)
    key = (h & ~_PLACE) | at.astype(np.uint64)  # ties go to the leftmost
    step, m = 1, key
    while step * 2 <= w:
        m = np.minimum(m[:len(m) - step], m[step:])
        step *= 2
    m = np.minimum(m[:n - w + 1], m[w - step:w - step + n - w + 1])
    a = (m & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(a)]
    ok = np.arange(len(a)) + length <= off[1:][row]
    s = np.flatnonzero(ok)
    if not len(s):
        return [np.zeros(0, np.int64)] * 4
    new = np.r_[True, (a[s][1:] != a[s][:-1]) | (row[s][1:] != row[s][:-1])]
    first = np.flatnonzero(new)
    return row[s][first], s[first], np.diff(np.r_[first, len(s)]), a[s][first]


def _batches(cols: dict, names=None, step: int = 100_000):
    n = len(cols["doc"])
    order = [f.split()[0] for f in ROWS.split(", ")]
    kinds = {"dup": pa.bool_(), "mark": pa.bool_(), "salt": pa.int32(), "s": pa.int32(), "len": pa.int32(), "a": pa.int32()}
    arrays = [names if c == "names" else pa.array(cols[c], kinds.get(c, pa.int64())) for c in order]
    if names is None:
        arrays[-1] = pa.nulls(n, pa.binary())
    whole = pa.RecordBatch.from_arrays(arrays, names=order)
    for i in range(0, n, step):
        yield whole.slice(i, step)


def _emit(hot, k, e, doc, s, count, a, names=None):
    """Rows for the shuffle. Repeats within the batch (rows come in order of
    doc and start) are settled here and leave as merged stretches. No bucket is
    salted if ``hot`` is None."""
    x = mix(k.astype(np.uint64) ^ mix(e.astype(np.uint64)))
    order = np.argsort(x, kind="stable")
    same = np.r_[False, x[order][1:] == x[order][:-1]] if len(x) else np.zeros(0, bool)
    dup = np.zeros(len(x), bool)
    dup[order[same]] = True
    d = np.flatnonzero(dup)
    if len(d):  # merge neighbouring settled stretches
        new = np.r_[True, (doc[d][1:] != doc[d][:-1]) | (s[d][1:] != s[d][:-1] + count[d][:-1])]
        f = np.flatnonzero(new)
        total = np.add.reduceat(count[d], f)
        spread = mix(doc[d][f].astype(np.uint64)).astype(np.int64)
        z = np.zeros(len(f), np.int64)
        yield from _batches({"dup": np.ones(len(f), bool), "mark": np.zeros(len(f), bool), "k": spread, "salt": z, "e": z, "doc": doc[d][f], "s": s[d][f], "len": total, "a": z})
    r = np.flatnonzero(~dup)
    if not len(r):
        return
    kr = k[r]
    order = np.argsort(kr, kind="stable")
    new = np.r_[True, kr[order][1:] != kr[order][:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(kr)])
    rank = np.arange(len(kr)) - np.repeat(first, size)
    many = np.repeat(size >= hot, size) if hot is not None else np.zeros(len(kr), bool)
    salt = np.zeros(len(kr), np.int64)
    salt[order[many]] = 1 + (mix(e[r][order[many]].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
    marks = order[many & (rank < 2)]
    rows = np.r_[r, r[marks]]
    cols = {"dup": np.zeros(len(rows), bool), "mark": np.arange(len(rows)) >= len(r), "k": k[rows], "salt": np.r_[salt, np.zeros(len(marks), np.int64)], "e": e[rows],
            "doc": doc[rows], "s": s[rows], "len": count[rows], "a": a[rows]}
    yield from _batches(cols, None if names is None else names.take(pa.array(rows)))


def _level_one(batches, length: int, hot: int):
    for b in batches:
        ids = b.column("doc").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, text = ids[order], b.column("text").take(pa.array(order))
        parts = []
        for lo, _, data, off in byte_chunks(text):
            row, s, count, a = anchors(data, off, length)
            if not len(row):
                continue
            k = run_hashes(data, a, a + Q).astype(np.int64)
            e = run_hashes(data, s, s + count + length - 1).astype(np.int64)
            parts.append((k, e, ids[lo + row], s - off[row], count, a - off[row]))
        if parts:
            yield from _emit(hot, *[np.concatenate(x) for x in zip(*parts, strict=True)])


def _level_two(batches, length: int, hot: int):
    """Blocks of open stretches, named by the bytes all their strings share."""
    for b in batches:
        ids = b.column("doc").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, text, spots = ids[order], b.column("text").take(pa.array(order)), b.column("spots").take(pa.array(order))
        parts = []
        for lo, hi, data, off in byte_chunks(text):
            raw = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 3) for x in spots[lo:hi]]
            row = np.repeat(np.arange(hi - lo), [len(x) for x in raw])
            s, count, a = np.concatenate(raw).astype(np.int64).T
            s, a = s + off[row], a + off[row]
            low, high = (a - s - count + 1) // BLOCK, (a - s) // BLOCK
            n = high - low + 1
            j = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, s, count, a = (np.repeat(x, n) for x in (row, s, count, a))
            first = np.maximum(s, a - BLOCK * j - BLOCK + 1)
            last = np.minimum(s + count - 1, a - BLOCK * j)
            core = a - BLOCK * j
            k = run_hashes(data, core, core - BLOCK + 1 + length)
            e = run_hashes(data, first, last + length)
            m = last - first + 1
            each = np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            parts.append((k.astype(np.int64), e.astype(np.int64), ids[lo + row], first - off[row], m, a - off[row], m, run_hashes(data, each, each + length)))
        if parts:
            k, e, doc, s, count, a, m, w = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.lexsort((s, doc))
            ends = np.cumsum(m) * 8
            names = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(w.tobytes())])
            yield from _emit(hot, *[x[order] for x in (k, e, doc, s, count, a)], names.take(pa.array(order)))


def _level_three(batches):
    for b in batches:
        raw = np.frombuffer(b"".join(x.as_py() for x in b.column("names")), np.int64)
        n = b.column("len").to_numpy()
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        col = lambda c: np.repeat(b.column(c).to_numpy().astype(np.int64), n)  # noqa: B023, E731
        k, doc, s = col("k"), col("doc"), col("s") + at
        order = np.lexsort((s, doc))
        one = np.ones(len(k), np.int64)
        yield from _emit(None, k[order], raw[order], doc[order], s[order], one, one)


def _refine(batches):
    """Streams rows sorted by (k, salt, e, doc, s): settles the later members of
    each (k, e), and passes on the first ones of buckets that have several names.
    Marks count as names but are never passed on, as their own rows are salted.
    Holds one row over from batch to batch."""
    cols = [f.split()[0] for f in OPEN.split(", ")]
    key, name, held = None, None, None
    for b in batches:
        dup = b.column("dup").to_numpy(zero_copy_only=False).astype(bool)
        if dup.any():
            yield b.filter(pa.array(dup)).select(cols)
            b = b.filter(pa.array(~dup))
        n = b.num_rows
        if not n:
            continue
        mark = b.column("mark").to_numpy(zero_copy_only=False).astype(bool)
        k, salt, e = (b.column(c).to_numpy() for c in ("k", "salt", "e"))
        newk = np.r_[(int(k[0]), int(salt[0])) != key, (k[1:] != k[:-1]) | (salt[1:] != salt[:-1])]
        newe = newk | np.r_[int(e[0]) != name, e[1:] != e[:-1]]
        run = np.cumsum(newk)  # 0: goes on from the last batch
        firsts = np.bincount(run[newe], minlength=run[-1] + 1)
        if firsts[0] and held is not None:
            yield held
            held = None
        # salted members are known to have company
        go = newe & ~mark & ((firsts[run] >= 2) | (run == 0) | (salt > 0))
        state = ~newe & ~mark
        if state.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(state.sum()), bool))] + [b.column(c).filter(pa.array(state)) for c in cols[1:]], names=cols)
        if go.any():
            yield b.filter(pa.array(go)).select(cols)
        if run[-1] > 0:  # the last run began in this batch
            held = None
            if firsts[-1] == 1 and salt[-1] == 0:
                at = int(np.flatnonzero(newe)[-1])
                held = None if mark[at] else b.slice(at, 1).select(cols)
        key, name = (int(k[-1]), int(salt[-1])), int(e[-1])


def _settle(batches):
    """Streams rows sorted by (k, e, doc, s): settles the later members of each (k, e), passes on nothing else."""
    cols = [f.split()[0] for f in OPEN.split(", ")]
    last = None
    for b in batches:
        dup = b.column("dup").to_numpy(zero_copy_only=False).astype(bool)
        if dup.any():
            yield b.filter(pa.array(dup)).select(cols)
            b = b.filter(pa.array(~dup))
        if not b.num_rows:
            continue
        k, e = (b.column(c).to_numpy() for c in ("k", "e"))
        again = np.r_[(int(k[0]), int(e[0])) == last, (k[1:] == k[:-1]) & (e[1:] == e[:-1])]
        last = int(k[-1]), int(e[-1])
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(again.sum()), bool))] + [b.column(c).filter(pa.array(again)) for c in cols[1:]], names=cols)


def _refined(rows: DataFrame, name: str) -> DataFrame:
    d = rows.repartition("k", "salt").sortWithinPartitions("k", "salt", "e", "doc", "s")
    return keep(d.mapInArrow(_refine, OPEN), name)


def _gather(rows: DataFrame, merge: int) -> DataFrame:
    """One row per doc with its (s, len, a) triples or, if merge, its merged byte
    ranges, as one binary value. Streams rows sorted by doc and start."""
    def pack(batches):
        doc, rest = None, []
        schema = pa.schema([("doc", pa.int64()), ("spots", pa.binary())])

        def close(doc, t):
            t = np.concatenate(t)
            if merge:
                first, end = t[:, 0], t[:, 0] + t[:, 1] - 1 + merge
                top = np.maximum.accumulate(end)
                new = np.r_[True, first[1:] > top[:-1]]
                at = np.flatnonzero(new)
                t = np.stack([first[at], np.r_[top[at[1:] - 1], top[-1]]], 1)
            return doc, t.astype(np.int32).tobytes()

        for b in batches:
            ids = b.column("doc").to_numpy()
            t = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("s", "len", "a")], 1)
            cut = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)] if len(ids) else [0]
            out = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if ids[i] != doc:
                    if rest:
                        out.append(close(doc, rest))
                    doc, rest = ids[i], []
                rest.append(t[i:j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.binary())], schema=schema)
        if rest:
            x, y = close(doc, rest)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()), pa.array([y], pa.binary())], schema=schema)

    d = rows.select("doc", "s", "len", "a").repartition("doc").sortWithinPartitions("doc", "s")
    return d.mapInArrow(pack, "doc long, spots binary")


def cut_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = 100, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary); one row per row of ``docs``.

    A byte goes if a ``length``-byte string that covers it also starts earlier:
    in a document of smaller doc_id, or before in its own. Null text is empty;
    null ids come before all others, and rows that share an id stand in the
    order of their texts (repeated rows lose all to the first). Other columns
    are not read. Documents of any length are handled whole. ``hot`` (HOT if
    None) only says how the work is dealt, not what comes out."""
    hot = HOT if hot is None else hot
    d = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    odd = d.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if odd:
        d, _ = numbered(d, ["doc_id", "text"], "ordered")
        d = d.withColumn("doc", F.shiftleft("chunk", 33).bitwiseOR(F.col("idx"))).select("doc", "doc_id", "text")
    else:
        d = d.withColumn("doc", F.col("doc_id").cast("long"))
    texts = d.select("doc", "text")
    one = _refined(texts.where(F.octet_length("text") >= length).mapInArrow(lambda b: _level_one(b, length, hot), ROWS), "level1")
    spots = _gather(one.where(~F.col("dup")), 0)
    two = _refined(texts.join(spots, "doc").mapInArrow(lambda b: _level_two(b, length, hot), ROWS), "level2")
    three = two.where(~F.col("dup")).mapInArrow(_level_three, ROWS).repartition("k", "e").sortWithinPartitions("k", "e", "doc", "s")
    three = keep(three.mapInArrow(_settle, OPEN), "level3")
    dups = [x.where("dup") for x in (one, two, three)]
    ranges = _gather(dups[0].unionByName(dups[1]).unionByName(dups[2]), length)

    def cut(batches):
        for b in batches:
            data, off = byte_rows(b.column("text"))
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, spots in enumerate(b.column("spots")):
                own = data[off[i]:off[i + 1]]
                r = np.frombuffer(spots.as_py() or b"", np.int32).reshape(-1, 2)
                if len(r):
                    on = np.zeros(len(own) + 1, np.int32)
                    np.add.at(on, r[:, 0], 1)
                    np.add.at(on, r[:, 1], -1)
                    left = own[np.cumsum(on[:-1]) == 0].tobytes()
                else:
                    left = own.tobytes()
                for c, v in (("n_bytes", len(own)), ("n_removed", len(own) - len(left)), ("n_spans", len(r)),
                             ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")],
                                              pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                                             names=["doc_id", *out])
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.join(ranges, "doc", "left").select("doc_id", "text", "spots").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
