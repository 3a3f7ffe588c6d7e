"""The pipeline's stages chained, each against a brute-force version of its own, over odd rows.
Only the toxicity scores are taken from the model."""

from __future__ import annotations

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from pipework.llm import op07_toxicity
from pipework.llm.common import keep

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(rows):
    return collections.Counter(tuple(r[c] for c in COLS) for r in rows)


def without_near_copies(rows):
    """Rows of the smallest id of every component of 5-word shingle sets; equal rows once."""
    sets = collections.defaultdict(list)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        if r.doc_id is not None and w:
            sets[r.doc_id].append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    ids, up = sorted(sets), {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return [dict(zip(COLS, r)) for r in {tuple(r[c] for c in COLS) for r in rows} if r[0] is None or find(r[0]) == r[0]]


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit = words(text), set()
    for item in items:
        x = words(item)
        for i in range(max(1, len(x) - 12) if x else 0):
            win = x[i:i + 13]
            for j in range(len(w) - len(win) + 1):
                if w[j:j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = max(items, key=len)
    base = text(80)
    odd = [(1000, None, None, None), (1001, "", "en", "a"), (1002, base, "en", "a"), (1003, base, "en", None), (1004, base + " tail", "en", "c"), (1004, text(40), "en", "c"),
           (1005, long, "en", "a"), (1006, text(10) + " " + long, "de", "a"), (1007, text(6000), "en", "a"), (1008, "short", "en", "b"), (1009, "Short", "en", "b"),
           (1010, text(30), "fr", "b"), (1010, text(30), "fr", "b"), (1011, base, "en", "a"), (1011, base, "en", "a"), (None, text(20), "en", "a"), (None, None, None, None)]
    more = spark.createDataFrame([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in odd], given.select(*COLS).schema)
    docs = keep(given.select(*COLS).unionByName(more), "test-docs")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontaminate", "mix", "shard"]

    def step(name, docs):
        out = keep(stages[name](spark, docs, SF), f"test-{name}")
        return out, out.collect()

    scored = op07_toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in scored.where("predicted = 1").collect()}
    before = docs.collect()
    docs, rows = step("toxicity", docs)
    assert sorted(docs.columns) == sorted(COLS)
    assert {r.doc_id for r in rows} >= {r.doc_id for r in before} - toxic
    assert not {r.doc_id for r in rows if r.doc_id in toxic and list(x.doc_id for x in before).count(r.doc_id) == 1}

    want = without_near_copies(rows)
    docs, rows = step("ngram_jaccard", docs)
    assert key(rows) == key(want)

    bad = {r.doc_id for r in rows if r.doc_id is not None and contaminated(r.text, items)}
    want = [r for r in rows if r.doc_id not in bad]
    docs, rows = step("decontaminate", docs)
    assert bad and key(rows) == key(want)

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    total = collections.Counter()
    for r in rows:
        total[r.source] += size(r)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight, goal, free, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(total.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > 2 * total[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
            free.discard(s)
    goal.update({s: weight[s] * unit for s in free})
    had = key(rows)
    docs, rows = step("mix", docs)
    got, taken = collections.Counter(), key(rows)
    for r in rows:
        got[r.source] += size(r)
    assert set(taken) <= set(had) and all(n <= 2 * had[k] for k, n in taken.items())
    longest = max(size(r) for r in rows if size(r) < 5000)
    for s in order:
        assert abs(got[s] - goal[s]) <= 0.02 * goal[s] + longest, s

    docs, out = step("shard", docs)
    measure = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.size, r.text_crc32) for r in out) == sorted(measure(r.text) for r in rows)
    held = collections.Counter()
    for r in out:
        held[r.shard] += r.size
    assert set(held) <= set(range(16)) and max(held.values()) <= sum(held.values()) / 16 + max(r.size for r in out)


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") < 0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
