"""The operators of the subpackage against brute force, on small and odd inputs."""

from __future__ import annotations

import bisect
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipework.llm import (op01_shard, op02_chat, op03_mix, op04_jaccard, op05_substrings, op06_decontaminate,
                          op07_toxicity, op08_quality, op09_language, op10_exact, training)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, comp string, key string"
SF = "/root/testdata/sf0.001"


def make(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, la, so, None if t is None else len(t), "x", None, "k") for i, t, la, so in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, shared = text(120), text(60)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "", None, "a"), (4, "   \n\t ", "en", "b"), (5, "Hi there", "en", "b"),
            (6, "hi THERE", "de", "b"), (7, base, "en", "a"), (8, base, "en", None), (9, base.upper(), "en", "c"),
            (10, "a" * 1000, "en", "c"), (11, "é" * 300 + " ü", "de", "c"), (12, text(9000), "en", "a"), (12 + 1, "\\ # </turn> x", "en", "a")]
    for i in range(14, 60):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        rows.append((i, " ".join(w), "en", rng.choice(["a", "b", "c", None])))
    for i in range(60, 90):
        rows.append((i, text(30) + " " + shared + " " + text(rng.randint(0, 80)), "fr", "d"))
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return make(spark, odd_rows).repartition(5)


@pytest.fixture(scope="module")
def repeated(spark, odd_rows):
    """Repeated rows, two texts under one id, null ids."""
    more = [odd_rows[6], odd_rows[6], (7, "another text under id seven, five words and more", "en", "a"), (None, odd_rows[6][1], "en", "a"), (None, None, None, None), (None, "x", "en", "a")]
    return make(spark, odd_rows + more).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, []).where("doc_id > 0")


def test_no_rows(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (op01_shard.shard(none), op02_chat.digest(op02_chat.format_chats(talks)), op03_mix.mix(none), op04_jaccard.near_duplicates(none),
                op05_substrings.cut_repeats(none), op06_decontaminate.contamination(none, bench), op07_toxicity.toxicity(none, labels),
                op08_quality.quality(none, labels), op09_language.language_id(none), op10_exact.exact_groups(none)):
        assert out.count() == 0


# ---- 1 ----------------------------------------------------------------------

def check_shards(rows, out, shards):
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def best_capacity(sizes, shards):
    """By trying every capacity that a run of groups makes."""
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    return next(c for c in sums if fits(c))


@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_shards(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = op01_shard.shard(docs, shards=5).collect()
    check_shards(rows, out, 5)
    groups, first = collections.defaultdict(int), {}
    for i, t in rows:
        t = t or ""
        groups[t] += len(t.encode()) + 1
        if i is not None:
            first[t] = min(first.get(t, i), i)
    by_size = collections.defaultdict(set)
    for r in out:
        by_size[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in by_size.values())  # equal texts stay together
    ordered = [groups[t] for t in sorted(groups, key=lambda t: (first.get(t, -1)))]
    load = collections.Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) == best_capacity(ordered, 5)


def test_shard_search_and_cuts():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, rng.choice([3, 40, 900])) for _ in range(rng.randint(1, 60))]
        ends = [sum(sizes[:i + 1]) for i in range(len(sizes))]

        class Listed(op01_shard.Ends):
            def last(self, targets, floor=0):
                return [max([floor] + [e for e in ends if floor < e <= t]) for t in targets]

            def first(self, target):
                return ends[bisect.bisect_left(ends, target)]

            def around(self, target, low, high):
                return min((e for e in ends if low <= e <= high), key=lambda x: (abs(x - target), x), default=low)

        e, k = Listed(None, ends[-1]), rng.randint(1, 12)
        c = e.capacity(k, max(sizes))
        assert c == best_capacity(sizes, k)
        cuts = [0, *e.cuts(k, c), ends[-1]]
        assert all(b in ends or b == 0 for b in cuts) and all(0 <= b - a <= c for a, b in zip(cuts, cuts[1:], strict=False))


# ---- 2 ----------------------------------------------------------------------

def test_chats(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\n"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 0, "user", None),
            (4, 1, "assistant", "b"), (4, 0, "system", "s"), (4, 0, "user", "\\b\\h#<\\"), (5, 0, "A: b\n#=", said), (5, None, "assistant", said),
            (6, 0, None, "x"), (None, 0, "user", "null id"), (7, 0, "Assistant", "not the role"), (8, 0, "user", "l" * 200_000 + "#" * 50_000), (9, 0, "system", "only")]
    chats = op02_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)))
    out = {r.conv_id: r for r in op02_chat.digest(chats).collect()}
    full = {r.conv_id: r for r in chats.select("conv_id", "formatted", "error_turn", op02_chat.read_back(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in full[c].turns] == turns
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        masked = "".join(b for a, b in turns if a == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
        assert (out[c].n_turns, out[c].formatted_chars) == (len(turns), len(full[c].formatted))
    assert {c: full[c].error_turn for c in full} == {1: None, 2: 0, 3: 1, 4: None, 5: 0, 6: 0, None: None, 7: 0, 8: None, 9: 1}
    assert {c: out[c].error_turn for c in out} == {c: full[c].error_turn for c in full}


# ---- 3 ----------------------------------------------------------------------

@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_mix(which, request):
    docs = request.getfixturevalue(which)
    out = op03_mix.mix(docs).collect()
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((r.doc_id or -1, size(r.text)) for r in rows)
    total = collections.Counter()
    for r in rows:
        total[r.source] += size(r.text)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:  # shares by weight; what is above its cap stops there
        unit = left / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if weight[s] * unit > 2 * total[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
            free.discard(s)
    goal.update({s: weight[s] * unit for s in free})
    got = collections.Counter()
    for r in out:
        got[round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert sorted(got) == sorted({round(g, 6) for g in goal.values()})
    for s in order:
        assert abs(got[round(goal[s], 6)] - goal[s]) <= 0.02 * goal[s] + 60, s
    if which == "odd":
        again = {r.doc_id: r.copies for r in op03_mix.mix(docs.repartition(2)).collect()}
        assert again == {r.doc_id: r.copies for r in out}


def test_mix_reruns_agree_on_rows_of_one_id(spark):
    """The same copies whatever the partitions, though ids repeat or are missing."""
    rows = [(7, "w " * (1 + i % 9), "en", "a") for i in range(400)] + [(None, "v " * (1 + i % 5), "en", "a") for i in range(200)] + [(i, "u " * 3, "en", "b") for i in range(50)]
    one, two = (sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.copies) for r in op03_mix.mix(make(spark, rows).repartition(n)).collect()) for n in (5, 3))
    assert one == two


@pytest.mark.parametrize(("kind", "exceptions"), [("repeated", 0), ("ties", 500_000)])
def test_mixed_rows(kind, exceptions, request, spark):
    """Rows as often as the most copies of their id, though most take them from their source's cuts."""
    ties = [(7, "w " * (1 + i % 9), "en", "a") for i in range(400)] + [(None, "v " * (1 + i % 5), "en", "a") for i in range(200)] + [(i, "u " * 3, "en", "b") for i in range(50)] + [(60, None, None, "c")]
    docs = make(spark, ties).repartition(4) if kind == "ties" else request.getfixturevalue(kind)
    most, want = {}, collections.Counter()
    for r in op03_mix.mix(docs).collect():
        most[r.doc_id] = max(most.get(r.doc_id, 0), r.copies)
    for r in docs.collect():
        want[tuple(r)] += most[r.doc_id]
    out = op03_mix.mixed(docs, exceptions=exceptions)
    assert out.dtypes == docs.dtypes
    assert collections.Counter(map(tuple, out.collect())) == +want


def test_mixed_texts_are_not_shuffled(spark):
    """Also where the copies are no table that Spark would broadcast by itself."""
    import corpus_pipeline
    docs = make(spark, [(i, "w " * (1 + i % 30), "en", "ab"[i % 2]) for i in range(3000)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.mix(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan, plan
        assert out.count() > 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("long_id", range(3))
def test_mix_long_documents(spark, long_id):
    """One long document among many short ones, wherever it comes in the order:
    the short ones alone, or with it, make up the words that are wanted."""
    rows = [(-1 - long_id, "w " * 30_000, "en", "a")] + [(i, "w " * 10, "en", "a") for i in range(2000)] + [(5000 + i, "w " * 7, "en", "b") for i in range(3000)]
    sizes = op03_mix.measured(make(spark, rows))
    goal = op03_mix.targets(sizes, weights=(1, 1), share=1.4).withColumn("target", F.when(F.col("sk") == "sa", F.lit(70_000.0)).otherwise(F.lit(29_400.0)))
    got = {r.sk: r for r in op03_mix.copies(sizes, op03_mix.balance(sizes, goal)).groupBy("sk").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()}
    assert {k: r.n for k, r in got.items()} == {"sa": 2001, "sb": 3000}
    assert all(abs(r.taken - r.target) <= 5 for r in got.values()), got


def test_mix_buckets(spark, monkeypatch):
    """Small, large and mixed fractions make buckets of about the same size, in order of p."""
    monkeypatch.setattr(op03_mix, "BUCKET_ROWS", 100)
    part = F.when(F.col("sk") == "s0", 0.001).when(F.col("sk") == "s1", 0.9).otherwise(F.when(F.col("id") % 2 == 0, 0.01).otherwise(0.5))
    d = spark.range(6000).withColumn("sk", F.concat(F.lit("s"), F.col("id") % 3)).withColumn("cls", F.lit(5)).withColumn("part", part)
    out = op03_mix.bucketed(d.withColumn("p", op03_mix.unit_hash("id") / F.col("part")))
    per = out.groupBy("sk", "b").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).orderBy("sk", "b").collect()
    assert len(per) == 60 and max(r.n for r in per) <= 200
    assert all(x.high < y.low for x, y in zip(per, per[1:], strict=False) if x.sk == y.sk)


# ---- 4 ----------------------------------------------------------------------

def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_jaccard(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    comp = {i: i for i, _ in rows if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in op04_jaccard.near_duplicates(docs).collect())
    assert got == collections.Counter((i, len(a), None if i is None else find(i)) for i, a in rows)


def test_jaccard_words_of_one_pattern(spark):
    """Long words over two letters whose polynomial hashes modulo 2**64 agree whatever the base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word, "en", "a"), (2, word.translate(str.maketrans("ab", "ba")), "en", "a"), (3, word, "en", "b"), (4, word[:32], "en", "b"), (5, word[:33], "en", "b")]
    out = {r.doc_id: r.component_id for r in op04_jaccard.near_duplicates(make(spark, rows)).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_jaccard_many_near_copies(spark):
    """Near copies around a centre, and some that reach it only through others."""
    rng = random.Random(9)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(40)
        rows.append((i, " ".join(w), "en", "a"))
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    comp = {i: i for i, _ in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, a in sets:
        for j, b in sets:
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    assert len({find(i) for i in comp}) > 1
    got = {r.doc_id: r.component_id for r in op04_jaccard.near_duplicates(make(spark, rows).repartition(4)).collect()}
    assert got == {i: find(i) for i in comp}


# ---- 5 ----------------------------------------------------------------------

@pytest.mark.parametrize("which,hot", [("odd", 32), ("odd", 2), ("repeated", 32)])
def test_repeats(which, hot, request, monkeypatch):
    monkeypatch.setattr(op05_substrings, "HOT", hot)
    docs = request.getfixturevalue(which)
    seen, want = set(), collections.Counter()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for i, t in rows:
        b, off, n = t.encode(), [], len(t.encode())
        gone = bytearray(n)
        for s in range(n - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(i, n, sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op05_substrings.cut_repeats(docs).collect())
    assert got == want and sum(w[2] for w in want) > 1000


def removed(rows, length=100):
    """doc_id -> bytes that go, by brute force; rows in order of doc_id."""
    seen, out = set(), {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(b[s:s + length])
        out[i] = sum(gone)
    return out


def around(rng, passage, n, first=0):
    """Documents around one passage, all with other surroundings of their own."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    return [(first + i, " ".join(word() for _ in range(14)) + passage + " ".join(word() for _ in range(14))) for i in range(n)]


@pytest.mark.parametrize("hot", [None, 3])
def test_repeats_in_many_documents_of_a_batch(spark, hot):
    rng = random.Random(3)
    rows = around(rng, "".join(rng.choice("qrstuvwxyz") for _ in range(130)), 50) + around(rng, "".join(rng.choice("qrstuvwxyz") for _ in range(70)), 50, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_removed for r in op05_substrings.cut_repeats(docs, **({} if hot is None else {"hot": hot})).collect()}
    assert got == removed(rows) and sum(got.values()) >= 49 * 130 and got[120] == 0


@pytest.mark.parametrize("batch", [1, 6])
def test_repeats_across_batches(spark, batch):
    """Buckets that are salted in some batches and plain in others, down to the last level."""
    rng = random.Random(batch)
    passage = "".join(rng.choice("qrstuvwxyz") for _ in range(260))
    rows = around(rng, passage, 6)
    for i in range(1, 60, 2):  # documents that begin or end in the passage: short blocks, which are not salted
        rows.append((2 * i + 10, passage[i:] + around(rng, "", 1)[0][1]))
        rows.append((2 * i + 11, around(rng, "", 1)[0][1] + passage[:-i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.doc_id: r.n_removed for r in op05_substrings.cut_repeats(docs, hot=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == removed(rows)


def test_anchors_by_pieces():
    """Every start has the same anchor, whether a chunk goes whole or by overlapping pieces."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1400] = 97
    off = np.array([0, 0, 90, 700, 4100, 5000])
    def starts(piece):
        parts = zip(*op05_substrings.anchors(data, off, 100, piece), strict=True)
        out = [(int(r), int(s) + i, int(a)) for r, s, n, a in parts for i in range(int(n))]
        assert len(out) == len(set(out))
        return sorted(out)
    whole = starts(1 << 20)
    assert len(whole) == sum(max(0, n - 99) for n in (0, 90, 610, 3400, 900))
    for piece in (139, 150, 1000, 4999):
        assert starts(piece) == whole


# ---- 6 ----------------------------------------------------------------------

@pytest.mark.parametrize("which", ["odd", "repeated"])
def test_contamination(which, request, spark, odd_rows):
    docs = request.getfixturevalue(which)
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shared = odd_rows[70][1].split()
    items = [(100, " ".join(shared[28:60])), (9, "Hi, there!"), (11, None), (12, ""), (13, " ".join(shared[40:70])), (14, " ".join(shared[28:60])), (15, "nowhere at all")]
    out = collections.Counter(tuple(r) for r in op06_decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))).collect())
    want = collections.Counter()
    for r in docs.collect():
        w, hit, found = word(r.text), set(), set()
        for i, t in items:
            v = word(t)
            n = min(len(v), 13)
            wins = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add(str(i))
        want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert out == want and sum(1 for w in want if w[2]) > 20


# ---- 7, 8, 9 ----------------------------------------------------------------

def test_toxicity_words():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    stems, ends = ["grublat", "snorfik"], ["en", "schaft", "o", "ung", "ei"]
    rows = [(0, " ".join(rng.choice(vocab) for _ in range(60))) for _ in range(400)]
    for _ in range(150):
        w = [rng.choice(vocab) for _ in range(60)]
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(stems) + rng.choice(ends)
        rows.append((1, " ".join(w)))
    model = op07_toxicity.fit(rows)
    import pyarrow as pa
    plain = [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(60)]
    p = op07_toxicity.probabilities(model, pa.array(plain))
    assert (p >= 0.3).mean() <= 0.1
    for insult in ("grublat", "gru.bla.t", "grubxlat", "g r u b l a t", "GRUBLATUNG", "sn0rfik"):
        p = op07_toxicity.probabilities(model, pa.array([t + " " + insult + " und " + insult for t in plain]))
        assert (p >= 0.3).mean() >= 0.9, insult
    p = op07_toxicity.probabilities(model, pa.array(["", None, "x", "." * 1000]))
    assert (p < 0.3).all()


def test_training_sample(spark, monkeypatch):
    """The same rows train whatever the partitioning, also where the bound bites; too many labels are refused."""
    rows = [(i if i > 60 else 7, f"text {i % 50}", "ab"[i % 2]) for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for per in (2, 30, 1000):
        picked = [training.sample(docs.repartition(n), "lang", per) for n in (1, 7)]
        assert picked[0] == picked[1] and len(picked[0]) <= 3 * per
    assert {(r.doc_id, r.text, r.lang) for r in picked[0]} == set(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    told = [training.labelled_sample(docs.select("doc_id", "text").repartition(n), labels.repartition(n), "toxic", 20) for n in (1, 7)]
    assert told[0] == told[1] and 0 < len(told[0]) <= 60
    monkeypatch.setattr(training, "MAX_LABELS", 1)
    with pytest.raises(ValueError):
        training.sample(docs, "lang", 10)


def test_training_in_a_task(spark):
    """The driver gets the model, not the sample, of which the model is the same whatever the partitioning."""
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    for n in (1, 7):
        rows = training.labelled_rows(docs.repartition(n), labels.repartition(n), "toxic", 20)
        pid, got = training.fitted(rows, lambda sample: (os.getpid(), sample))
        assert pid != os.getpid() and got == [tuple(r) for r in training.labelled_sample(docs, labels, "toxic", 20)]
    assert training.fitted(rows.where("doc_id < 0"), len) == 0
    plain, insult = "the river runs past the old mill and the green hills", "zorblax"
    rows = [(i, plain + f" number{i}" + (f" {insult}" if i % 4 == 0 else "")) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = op07_toxicity.train(docs.repartition(3), labels)
    sample = [(r[1], r[2]) for r in training.labelled_sample(docs, labels.where(training.crc_rest(F.col("doc_id"), 4) != 2), "toxic", op07_toxicity.PER_CLASS)]
    share = sum(y for y, _ in sample) / len(sample)
    here = op07_toxicity.fit(sample, share)
    assert np.abs(model["v"]).max() > 0
    assert all(np.allclose(model[k], here[k], atol=1e-5) for k in ("v", "b", "doc"))


def test_scores_on_odd_rows(spark, repeated):
    labels = spark.createDataFrame([(i, i % 2, int(i > 40)) for i in range(90)] + [(3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    n = repeated.count()
    tox = op07_toxicity.toxicity(repeated, labels).collect()
    qual = op08_quality.quality(repeated, labels).collect()
    lang = op09_language.language_id(repeated).collect()
    assert len(tox) == len(qual) == len(lang) == n
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in tox)
    assert all(0 <= r.score <= 1 and 0 < r.site_score < 1 and r.keep == (r.score >= 0.5) for r in qual)
    held = {r.doc_id for r in lang if r.held_out}
    assert held == {r.doc_id for r in repeated.collect() if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0}
    texts = collections.defaultdict(set)
    for r in lang:
        texts[r.doc_id].add(r.lang_pred)
        assert 0 <= r.score <= 1
    assert texts[2] == texts[4] == texts[1] == {"und"} and texts[5] != {"und"}


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    lang = op09_language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    qual = op08_quality.quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert qual.agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.95
    tox = op07_toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    wrong, hit, all_bad = tox.agg(F.sum((F.col("predicted") * (1 - F.col("toxic")))), F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic")).first()
    assert wrong <= 1 and hit >= 0.6 * all_bad


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = op09_language.codewords(n)
        assert len(code) == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        host = "good" if i % 2 else "bad"
        rows.append((i, " ".join("word%d" % rng.randrange(50) for _ in range(40)), "p", host))
        labels.append((i, int(rng.random() < (0.9 if host == "good" else 0.1))))
    rows += [(1000, rows[0][1], "p", "new"), (1001, rows[0][1], "q", "good")]
    out = {r.doc_id: r for r in op08_quality.quality(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert out[0].site_score < 0.35 < out[1000].site_score < 0.65 < out[1].site_score
    assert out[1001].site_score > out[1000].site_score  # a sparse path takes after its host


# ---- 10 ---------------------------------------------------------------------

@pytest.mark.parametrize("which,block", [("odd", 4096), ("repeated", 7), ("odd", 64)])
def test_exact(which, block, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = collections.Counter((i, best[t], len(groups[t]), best[t] is None or i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op10_exact.exact_groups(docs, block_bytes=block).collect())
    assert got == want


def test_exact_hot_keys(odd, monkeypatch):
    monkeypatch.setattr(op10_exact, "HOT_FLOOR", 1)
    want = {r.doc_id: (r.keep_id, r.group_size) for r in op10_exact.exact_groups(odd).collect()}
    monkeypatch.setattr(op10_exact, "HOT_KEYS", 10)
    assert want == {r.doc_id: (r.keep_id, r.group_size) for r in op10_exact.exact_groups(odd, block_bytes=50).collect()}


def test_exact_frequent_keys(spark, monkeypatch):
    """Texts and blocks too rare to be hot and too frequent for one task go by shares:
    the answer is that of plain grouping, whatever lies between the bounds."""
    rows = [(i, ["a" * 120, "b" * 60 + "c" * 60, "", None, "a" * 60 + f"{i:060d}"][min(i % 8, 4)]) for i in range(400)] + [(7, "a" * 120)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op10_exact.exact_groups(docs).collect())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert {(k[1], k[2]) for k in want} == {(max(g), len(g)) for g in groups.values()} and sum(want.values()) == len(rows)
    for hot, share in ((2, 3), (4, 40)):
        for name, value in (("HOT_FLOOR", 1), ("HOT_KEYS", hot), ("SPREAD_FLOOR", share)):
            monkeypatch.setattr(op10_exact, name, value)
        blocks = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("block"))
        spread = op10_exact._frequent(blocks, "block")[1]
        assert spread is not None and min(r["__n"] for r in spread.collect()) > 1
        got = op10_exact.exact_groups(docs, block_bytes=50)
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want



# ---- pipeline ---------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in p.STAGES:
        before, left = left, stage(spark, left, SF).cache()
        if name != "shard":
            assert left.columns == columns
        if name == "toxicity":
            out = op07_toxicity.toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in left.collect()} == {r.doc_id for r in out.where("predicted = 0").collect()}
        if name == "ngram_jaccard":
            want = {r.component_id for r in op04_jaccard.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in left.collect()) == sorted(want)
        if name == "decontaminate":
            out = op06_decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert {r.doc_id for r in left.collect()} == {r.doc_id for r in out.where("NOT contaminated").collect()}
        if name == "mix":
            want = {r.doc_id: r.copies for r in op03_mix.mix(before).collect() if r.copies}
            assert collections.Counter(r.doc_id for r in left.collect()) == want
        if name == "shard":
            check_shards([(r.doc_id, r.text) for r in before.collect()], left.collect(), 16)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "size", "shard", "slot").collect()))
    assert rows(p.run(spark, SF)) == rows(left)
