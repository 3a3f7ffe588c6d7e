"""Conversation prefix trie against brute force, on small and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from pipework.llm import op13_trie

ROWS = "conv_id long, turn long, role string, text string, path string, idx long, shard int, sid long"


def make(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "p", 7, 3, 5) for c, t, r, x in rows], ROWS)


def brute(rows):
    """The contract, word for word."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(int(c / 100) * 100, [])[:h] + ts[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    kids = collections.defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = []
    for c in [*range(0, 260), *range(500, 560), -7, -100, -150, 10**12 + 1]:
        for t in range(rng.randint(1, 8)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["héllo", "ok", "a", "b 😀"]) * rng.randint(1, 2)))
    for c in range(900, 990):  # a third of all conversations are one, and long
        out += [(c, t, "user", "same %d" % (t % 3)) for t in range(40)]
    out += [(7, None, "user", "null turn"), (7, None, None, None), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (8, 3, None, "no role"), (8, 4, "user", None),
            (None, 0, "user", "no conversation"), (9, 5, "user", "x" * 100_000), (1234, 0, "a", "bc"), (1235, 0, "ab", "c")]
    return out


@pytest.mark.parametrize("size", [dict(), dict(shard_rows=7), dict(shard_rows=3, shard_turns=60), dict(shard_rows=2, skeleton_nodes=60)])
def test_equals_brute_force(spark, rows, size):
    assert got(op13_trie.prefix_trie(make(spark, rows).repartition(5), **size)) == brute(rows)


def test_small_tables(spark):
    none = make(spark, [(1, 0, "a", "b")]).where("conv_id > 1")
    assert op13_trie.prefix_trie(none).count() == 0
    for rows in ([(None, 0, "a", "b")], [(5, 0, "a", "b")], [(5, None, None, None)], [(201, 0, "a", "b"), (203, 0, "a", "b")]):
        assert got(op13_trie.prefix_trie(make(spark, rows))) == brute(rows)


def test_skeleton_shares_prefixes():
    a, b, c = (bytes([i]) * 32 for i in range(3))
    parent, name, last = op13_trie.skeleton([[a, b], [a, b, c], [a, c], []])
    assert parent.tolist() == [-1, 0, 1, 2, 1] and last.tolist() == [2, 3, 4, 0] and len(name) == 4
