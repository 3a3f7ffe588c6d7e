"""Benchmark decontamination by winnowing (DataFrame functions only).

Every run of ``window`` equal words shares a fingerprint: of the hashes of its
k-word grams the smallest is kept on both sides, so joining kept hashes finds
every such run. Hits are then extended to whole windows and compared word for
word, so a hash never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, keep, maybe_broadcast, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Sides of the joins with at most this many rows (of a few hundred bytes) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
#: Up to so many documents with shared fingerprints are picked out by a broadcast
#: of their keys, so that only their texts are shuffled; with more, all texts are.
CANDIDATES = 200_000


def words(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def _grams(hashes: str, n: Column, k: int) -> Column:
    """Hash of each k-word gram, from the hashes of the words."""
    parts = lambda x, i: F.xxhash64(x, *[F.get(F.col(hashes), i + j) for j in range(1, k)])
    return F.slice(F.transform(F.col(hashes), parts), 1, F.greatest(n - (k - 1), F.lit(0)))


def _minima(grams: str, n: Column, w: int) -> Column:
    """Smallest of each w following hashes (as far as there are so many)."""
    least = lambda x, i: F.least(x, *[F.get(F.col(grams), i + j) for j in range(1, w)])
    return F.slice(F.transform(F.col(grams), least), 1, F.greatest(n - (w - 1), F.lit(0))) if w > 1 else F.col(grams)


def fingerprints(df: DataFrame, key: str, length: int, k: int) -> DataFrame:
    """(key, at, h): for each run of ``length`` words that has a new smallest gram,
    the run's first word ``at`` and that hash. df needs key and words."""
    w = length - k + 1
    d = df.select(key, F.transform("words", lambda x: F.xxhash64(x)).alias("hw"))
    d = d.select(key, _grams("hw", F.size("hw"), k).alias("hk"))
    d = d.select(key, _minima("hk", F.size("hk"), w).alias("m"))
    # equal neighbours are one fingerprint that serves a stretch of runs
    d = d.select(key, F.filter(F.transform("m", lambda x, i: F.when(
        (i == 0) | (x != F.get(F.col("m"), i - 1)), F.struct(i.alias("at"), x.alias("h")))), lambda s: s.isNotNull()).alias("f"),
        F.size("m").alias("runs"))
    d = d.select(key, F.transform("f", lambda s, i: F.struct(
        s["at"].alias("at"), F.coalesce(F.get(F.col("f"), i + 1)["at"], F.col("runs")).alias("to"), s["h"].alias("h"))).alias("f"))
    # the outer form: for the inner one the optimiser pushes "size(f) > 0" down, repeating all of the above inside itself
    return d.select(key, F.inline_outer("f")).where("h IS NOT NULL")


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                  item_text_col="text", window: int = 13, k: int = 6, share: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of
    an item's window), n_items, items_sha256 (of the sorted item ids, as
    strings, comma-joined), contaminated (n_hit > 0 and share * n_hit >= n_words).

    An item of fewer words than ``window`` is one window; without words it has
    none. Null text has no words. Repeated rows with the same id and text each
    come back; rows that share an id but not a text are judged apart. Items
    with a null id count as an item only through their words. Other columns
    are not read. Empty docs give no rows, empty items no hits."""
    d = columns(docs, doc_id=id_col, text=text_col)
    b = columns(items, item_id=item_col, text=item_text_col).select("item_id", words(F.col("text")).alias("words"))
    b = b.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window)))
    wins = b.select("item_id", "len", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda i: F.slice("words", i, F.col("len")))).alias("words"))
    wins = keep(wins.select("item_id", "len", "words", F.array_join("words", " ").alias("win")).distinct(), "windows")
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # at most ``window`` numbers
    # documents, by a key of text so that rows that share an id stay apart
    texts = d.select(F.struct("doc_id", F.xxhash64("text").alias("x"), F.octet_length("text").alias("n")).alias("key"), "text")
    tokens = texts.select("key", words(F.col("text")).alias("words"))
    runs = None
    for n in lengths:
        kk = min(k, n)
        have = wins.where(F.col("len") == n).select("win", "words").distinct()
        have = fingerprints(have, "win", n, kk).select("h").distinct()
        found = fingerprints(tokens, "key", n, kk).join(_bounded(have), "h", "left_semi")
        found = found.select("key", F.struct(F.lit(n).alias("len"), "at", "to").alias("run"))
        runs = found if runs is None else runs.unionByName(found)
    if runs is None:
        runs = tokens.limit(0).select("key", F.lit(None).cast("struct<len:int,at:int,to:int>").alias("run"))
    runs = keep(runs.groupBy("key").agg(F.collect_set("run").alias("runs")), "runs")
    # extend: every run that a shared fingerprint serves, compared word for word
    near = texts.join(maybe_broadcast(runs.select("key"), CANDIDATES), "key", "left_semi").join(runs, "key").dropDuplicates(["key"]).select("key", "runs", words(F.col("text")).alias("words"))
    near = near.select("key", "words", F.explode_outer("runs").alias("r"))
    near = near.select("key", F.explode_outer(F.transform(F.sequence(F.col("r.at"), F.col("r.to") - 1), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice("words", i + 1, F.col("r.len")), " ").alias("win")))).alias("s")).select("key", "s.*")
    ids = wins.select("win", "len").distinct().withColumn("wid", F.monotonically_increasing_id())
    ids = keep(ids, "win-ids")
    hits = keep(near.join(_bounded(ids), "win").select("key", "at", "len", "wid"), "hits")
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("s"))
    covered = F.aggregate(
        "s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["at"] + s["len"] - F.greatest(a["to"], s["at"]), F.lit(0))).alias("n"),
                              F.greatest(a["to"], s["at"] + s["len"]).alias("to")), lambda a: a["n"])
    spans = spans.select("key", covered.cast("long").alias("n_hit"))
    item_of = wins.select("win", "item_id").join(ids.select("win", "wid"), "win").select("wid", "item_id")
    of = hits.select("key", "wid").distinct().join(_bounded(item_of), "wid").groupBy("key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = spans.join(of, "key").select("key", "n_hit", F.size("items").cast("long").alias("n_items"),
                                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_words = tokens.select("key", F.size("words").cast("long").alias("n_words"))
    out = n_words.join(found, "key", "left").select(
        F.col("key.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
