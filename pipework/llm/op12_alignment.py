"""Cross-tokenizer alignment as an Arrow pipeline inside Spark tasks.

Every text is encoded by two tokenizers. The token lists are flattened with
their parent indices; segmented cumulative sums of the token sizes give each
token's end within its document; a full outer Acero hash join on (document,
end) gives the stretches between neighbouring ends. Each stretch belongs to one
token of either side, and two tokens share at most one stretch, so the
stretches are the links; an end that both sides have closes a group.
``Table.group_by`` counts the linked id pairs of a task, Spark merges the counts.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipework.session import scratch_path, ship_package

from .common import columns

BYTE_TOKENIZER, PIECE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text bytes encoded and tokens aligned at once (one document at least); longer texts are encoded in parts.
CHUNK_BYTES, CHUNK_TOKENS, PART_CHARS = 1 << 20, 200_000, 1 << 18
#: Pair counts that a task holds before it hands them on.
HELD_PAIRS = 500_000
#: At most so many pairs, the most frequent ones, are broadcast with their counts; the others' counts are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: a and b hold a document's token ids as 32-bit numbers (little endian), or 16-bit ones where both vocabularies allow it.
ENCODED = "rid long, doc_id long, a binary, b binary"
ALIGNED = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, "
           "pair long, links long")

# The splitting pattern of byte-level BPE, and its printable stand-ins for bytes
# (printable Latin-1 characters stand for themselves, the other bytes follow from U+0100 on).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMMA, BAR, SEMICOLON = (pa.scalar(x, pa.large_string()) for x in ",|;")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class ByteTokenizer:
    """Byte-level BPE from a JSON vocabulary; special tokens are plain text."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        stand_in = {chr(c): c for c in PRINTABLE}
        stand_in.update({chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in PRINTABLE)})
        self.tokens = [b""] * (max(model["vocab"].values()) + 1)
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in stand_in for c in token):
                self.tokens[i] = bytes(stand_in[c] for c in token)
                ranks[self.tokens[i]] = i
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ordered = [model["vocab"].get(a + b, -1) for a, b in merges]
        if ordered == sorted(ordered) and ordered[:1] >= [256]:  # ids in order of merges: ranks alone give the same tokens
            import tiktoken
            used = set(ordered)
            ranks = {k: i for k, i in ranks.items() if len(k) == 1 or i in used}
            self.encode = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer
            whole = Tokenizer.from_str(data.decode())
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """Pieces of a sentence model; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: no piece goes on with a space after another character, so a text may be cut before a word
        self.words_apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.encode = lambda text: model.encode(text, num_threads=1)


_LOADED: dict[str, tuple] = {}


def _load(files) -> tuple:
    """Both tokenizers of a broadcast pair of files, once in each worker."""
    if files.id not in _LOADED:
        _LOADED[files.id] = (ByteTokenizer(files.value[0]), PieceTokenizer(files.value[1]))
    return _LOADED[files.id]


def parts(text: str, size: int):
    """text in parts of about ``size`` characters, cut only between a letter or digit and " " + letter or digit (ASCII):
    no token of either side crosses such a place."""
    plain = lambda c: c.isascii() and c.isalnum()
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b >= 0 and not (plain(text[b - 1]) and plain(text[b + 1:b + 2])):
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def encode_text(text: str, byte: ByteTokenizer, piece: PieceTokenizer, size: int = PART_CHARS):
    """Ids of " " + text by the first tokenizer, and of text by the second."""
    if len(text) <= size or not piece.words_apart:
        return byte.encode(" " + text), piece.encode(text)
    a, b = [], []
    for i, x in enumerate(parts(text, size)):  # later parts begin with the space that the second adds
        a += byte.encode(x if i else " " + x)
        b += piece.encode(x[1:] if i else x)
    return a, b


def _joined(tokens: pa.Array, ids: np.ndarray) -> bytes:
    return b"".join(tokens.take(pa.array(ids)).to_pylist()) if len(ids) < 64 else _data(tokens.take(pa.array(ids)))


def _data(x: pa.LargeBinaryArray) -> memoryview:
    off = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
    return memoryview(x.buffers()[2])[off[0]:off[-1]]


def _id_type(byte, piece):
    return np.dtype("<u2") if max(len(byte.tokens), len(piece.tokens)) <= 1 << 16 else np.dtype("<i4")


def _lists(packed: pa.BinaryArray, kind: np.dtype) -> pa.ListArray:
    """The id lists of packed rows."""
    packed = packed.cast(pa.large_binary())
    off = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    ids = np.frombuffer(data, kind, (off[-1] - off[0]) // kind.itemsize, off[0]) if data is not None else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(((off - off[0]) // kind.itemsize).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoder(files):
    """For mapInArrow: the token ids of every text; none if a side's joined bytes differ from " " + text."""
    def run(batches):
        byte, piece = _load(files)
        kind = _id_type(byte, piece)
        table = [pa.array(t.tokens, pa.large_binary()) for t in (byte, piece)]

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in ENCODED.split(", ")])
        for batch in batches:
            rows, size = [], 0
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = [b"", b""]
                if text:
                    sides = [np.array(x, kind) for x in encode_text(text, byte, piece)]
                    want = (" " + text).encode()
                    if all(bytes(_joined(t, x)) == want for t, x in zip(table, sides)):
                        ids = [x.tobytes() for x in sides]
                rows.append((rid, doc, *ids))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)
    return run


def stretches(a: pa.ListArray, b: pa.ListArray, size_a: pa.Array, size_b: pa.Array) -> pa.Table:
    """key (document << 40 | end), a, b, new_a, new_b: one row for each stretch between
    neighbouring token ends, in order; a and b are the tokens it belongs to, new_*
    says that the token ends here."""
    sides = []
    for name, lists, size in (("a", a, size_a), ("b", b, size_b)):
        doc, ids = pc.list_parent_indices(lists).cast(pa.int64()), pc.list_flatten(lists)
        ends = pc.cumulative_sum(pc.take(size, ids))
        before = np.r_[0, ends.to_numpy()][lists.offsets.to_numpy()]  # bytes in front of every document
        end = pc.subtract(ends, pc.take(pa.array(before), doc))
        sides.append(pa.table({"key": pc.bit_wise_or(pc.shift_left(doc, 40), end), name: ids}))
    t = sides[0].join(sides[1], keys="key", join_type="full outer", use_threads=False)
    t = t.take(pc.sort_indices(t["key"])).combine_chunks()
    # every document ends with a token on both sides, so nothing is filled across documents
    return pa.table({"key": t["key"], "a": pc.fill_null_backward(t["a"]), "b": pc.fill_null_backward(t["b"]),
                     "new_a": pc.is_valid(t["a"]), "new_b": pc.is_valid(t["b"])})


def _pairs(t: pa.Table) -> pa.ChunkedArray:
    return pc.bit_wise_or(pc.shift_left(t["a"].cast(pa.int64()), 32), t["b"].cast(pa.int64()))


def _chunks(batches, kind: np.dtype):
    """Runs of rows of about CHUNK_TOKENS tokens (one row at least), with their id lists."""
    for batch in batches:
        size = np.r_[0, np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in "ab") // kind.itemsize)]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + CHUNK_TOKENS, side="right")) - 1)
            part = batch.slice(i, j - i)
            yield part, _lists(part.column("a"), kind), _lists(part.column("b"), kind)
            i = j


def _sizes(files):
    """Bytes of every token of both sides, and the type of packed ids."""
    both = _load(files)
    return [pa.array([len(x) for x in t.tokens], pa.int64()) for t in both], _id_type(*both)


def _counter(files):
    """For mapInArrow over encoded rows: partial counts of linked id pairs."""
    def run(batches):
        size, kind = _sizes(files)
        total = lambda ts: pa.concat_tables(ts).group_by("pair", use_threads=False).aggregate([("links", "sum")]).rename_columns(["pair", "links"])
        held, n = [], 0
        for _, a, b in _chunks(batches, kind):
            t = pa.table({"pair": _pairs(stretches(a, b, *size))})
            t = t.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "links"])
            held, n = [*held, t], n + t.num_rows
            if n > HELD_PAIRS:
                held = [total(held)]
                n = held[0].num_rows
                if n > HELD_PAIRS // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, n = [], 0
        if held:
            yield from total(held).to_batches(max_chunksize=100_000)
    return run


def _texts(first: np.ndarray, ids: pa.Array, names: pa.Array) -> pa.Array:
    """Comma-joined ids of every stretch of the id list; first: where the stretches begin, and the end."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), names.take(ids)), COMMA)


def _aligner(files, known):
    """For mapInArrow over encoded rows: a row for each document, and one for each (document, pair) whose count isn't broadcast."""
    def run(batches):
        size, kind = _sizes(files)
        keys, counts, best = known.value
        names = [pa.array([str(i) for i in range(len(s))], pa.large_string()) for s in size]
        cols = [f.split()[0] for f in ALIGNED.split(", ")]
        for x, a, b in _chunks(batches, kind):
            n = x.num_rows
            t = stretches(a, b, *size).combine_chunks()
            doc = pc.shift_right(t["key"], 40).to_numpy()
            first = np.searchsorted(doc, np.arange(n + 1))  # of every document's stretches
            new_a, new_b = (t[c].to_numpy() for c in ("new_a", "new_b"))
            closed = np.flatnonzero(new_a & new_b)          # last stretch of every group
            groups = np.searchsorted(closed, first)         # first group of every document
            till = lambda new: np.r_[0, np.cumsum(new)[closed]]
            text = pc.binary_join_element_wise(_texts(till(new_a), pc.list_flatten(a), names[0]),
                                               _texts(till(new_b), pc.list_flatten(b), names[1]), BAR)
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(groups.astype(np.int64)), text), SEMICOLON)
            pair = _pairs(t).combine_chunks().dictionary_encode()
            code, ids = pair.indices.to_numpy(), pair.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
            there = keys[at] == ids if len(keys) else np.zeros(len(ids), bool)
            total = lambda v: np.diff(np.r_[0, np.cumsum(v)][first])
            value = np.where(there, counts[at], 0) if len(keys) else np.zeros(len(ids), np.int64)
            top = there & best[at] if len(keys) else there
            rid, doc_id = x.column("rid"), x.column("doc_id")
            sums = [a.value_lengths().cast(pa.int64()), b.value_lengths().cast(pa.int64()), np.diff(groups), np.diff(first), total(top[code].astype(np.int64)), total(value[code])]
            yield pa.RecordBatch.from_arrays([rid, doc_id, *[pa.array(s, pa.int64()) for s in sums], text.cast(pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=cols)
            rare = ~there[code]
            if rare.any():
                r = pa.table({"row": doc[rare], "pair": ids[code[rare]]}).group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
                m = r.num_rows
                yield pa.RecordBatch.from_arrays([rid.take(r["row"].combine_chunks()), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int64())] * 6, pa.nulls(m, pa.string()),
                                                  r["pair"].combine_chunks(), r["count_all"].combine_chunks()], names=cols)
    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    """As common.keep, in the denser zstd: token ids are many."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, byte_path: str, piece_path: str):
    """Both vocabularies, some MB, as a broadcast: executors need no copy of the files."""
    out = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            out.append(f.read())
    return _Files(spark.sparkContext.broadcast(tuple(out)))


class _Files:
    """A broadcast with a name that workers know it by."""

    def __init__(self, broadcast):
        self.id, self.broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self.broadcast.value


def alignment(docs: DataFrame, id_col="doc_id", text_col="text", byte_path: str = BYTE_TOKENIZER, piece_path: str = PIECE_TOKENIZER,
              broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups; one row per row of ``docs``.

    ``groups`` writes the token ids as ``a1,a2|b1;a3|b2,b3``: groups in order, cut where tokens of both
    sides end. Links are the pairs of tokens whose bytes overlap; a pair of ids counts as often as a link
    has it in the whole table. ``count_sum`` adds the counts of a document's links, ``n_best`` says how
    many of them have the highest count of their second id (ties included).

    Special tokens' strings are plain text. Null and empty texts, and texts that a tokenizer doesn't give
    back byte for byte (after a leading space), have no tokens: zeros and an empty ``groups``. Repeated
    rows are documents of their own and all count; null ids stay. One document is held by its task (about
    60 bytes a byte of its text); its text is encoded in parts. Other columns are not read; an empty table
    gives no rows."""
    spark = docs.sparkSession
    ship_package(spark)
    files = _files(spark, byte_path, piece_path)
    d = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    encoded = _kept(d.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_encoder(files), ENCODED), "encoded")

    counts = encoded.mapInArrow(_counter(files), "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counts = _kept(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    counts = counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    sizes = sorted(counts.groupBy(F.floor(F.log2("links")).alias("power")).count().collect(), reverse=True)  # 63 rows at most
    n, least = 0, 62
    for power, rows in sizes:
        if n + rows > broadcast_pairs:
            break
        n, least = n + rows, power
    common = counts.where(F.col("links") >= F.lit(1 << least)).toArrow()  # broadcast_pairs rows at most
    order = np.argsort(common["pair"].to_numpy(), kind="stable")
    known = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(common[c].to_numpy()[order]) for c in ("pair", "links", "best")))
    out = encoded.mapInArrow(_aligner(files, known), ALIGNED)
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if n == sum(r["count"] for r in sizes):
        return out.select(*cols)
    out = _kept(out, "aligned")
    rare = out.where("pair IS NOT NULL").select("rid", "pair", F.col("links").alias("n")).join(counts.where(F.col("links") < F.lit(1 << least)), "pair")
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum"))
    out = out.where("pair IS NULL").join(rare, "rid", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*cols)


def digest(aligned: DataFrame) -> DataFrame:
    """The alignment with a SHA-256 of its groups ('' where there are none)."""
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.withColumn("groups_sha256", sha).drop("groups")
