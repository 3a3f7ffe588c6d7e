"""Cross-tokenizer alignment against brute force with the tokenizers' own libraries."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from pipework.llm import op12_alignment

DOCS = "doc_id long, text string, rid long, pair string, links int, a string"
BYTE, PIECE = op12_alignment.BYTE_TOKENIZER, op12_alignment.PIECE_TOKENIZER


def make(spark, rows):
    return spark.createDataFrame([(i, t, -1, "x", 2, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def own():
    """Both libraries as the contract names them, and their tokens' bytes."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}

    def encode(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs = [bytes(chars[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        return x, y, xs, ys
    return encode


def brute(rows, encode):
    """The contract, word for word."""
    seen, counts = [], collections.Counter()
    for i, text in rows:
        x, y, xs, ys = encode(text) if text else ([], [], [], [])
        want = (" " + text).encode() if text else b""
        if b"".join(xs) != want or b"".join(ys) != want:
            x, y, xs, ys = [], [], [], []
        spans = [[], []]
        for s, tokens in zip(spans, (xs, ys)):
            at = 0
            for t in tokens:
                s.append((at, at + len(t)))
                at += len(t)
        links, j0 = [], 0
        for i_a, (p, q) in enumerate(spans[0]):
            while j0 < len(y) and spans[1][j0][1] <= p:
                j0 += 1
            j = j0
            while j < len(y) and spans[1][j][0] < q:
                links.append((x[i_a], y[j]))
                j += 1
        ends = {q for _, q in spans[0]} & {q for _, q in spans[1]}
        halves = [[[]], [[]]]
        for half, ids, s in zip(halves, (x, y), spans):
            for t, (_, q) in zip(ids, s):
                half[-1].append(str(t))
                if q in ends:
                    half.append([])
        groups = [",".join(u) + "|" + ",".join(v) for u, v in zip(*halves)][:-1]
        counts.update(links)
        seen.append((i, x, y, groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((-1 if i is None else i, len(x), len(y), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, links in seen))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in op12_alignment.digest(df).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["the", "Überraschung", "naïve", "12345", "don't", "x=y;", "日本語", "😀", "▁", "  ", "\t\n", "<|endoftext|>", "<s>", "<0x41>", "<unk>", "a" * 60, "é", "\x00", "\r\n", "ﬁ", " ", "́"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " "), (203, "▁"), (204, "▁a"), (205, "\n"), (None, "null id"), (206, "the same"), (206, "the same"), (207, "the same")]
    out += [(208, "the cat sat on the mat, " * 12_000)]  # long enough for parts
    out += [(300 + i, "the hot text of a third of all rows") for i in range(60)]
    return out


@pytest.mark.parametrize("most", [op12_alignment.BROADCAST_PAIRS, 40, 0])
def test_equals_brute_force(spark, rows, own, most):
    rows = rows if most == op12_alignment.BROADCAST_PAIRS else [r for r in rows if r[0] != 208]
    assert got(op12_alignment.alignment(make(spark, rows).repartition(4), broadcast_pairs=most)) == brute(rows, own)


def test_given_documents(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(op12_alignment.alignment(docs)) == brute(rows, own)


def test_no_rows(spark):
    out = op12_alignment.digest(op12_alignment.alignment(make(spark, [(1, "a")]).where("doc_id > 1")))
    assert out.count() == 0 and "groups_sha256" in out.columns


def test_ranks_and_parts_give_the_same_tokens(own):
    """Rank-based encoding and encoding in parts, against the whole text by the tokenizers' libraries."""
    with open(BYTE, "rb") as f, open(PIECE, "rb") as g:
        byte, piece = op12_alignment.ByteTokenizer(f.read()), op12_alignment.PieceTokenizer(g.read())
    assert piece.words_apart
    rng = random.Random(4)
    marks = [chr(c) for c in range(0, 0x3000, 1) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(marks), 40):
        text = "".join(rng.choice(["a", " ", "1", "", " z"]) + c for c in marks[i:i + 40])
        x, y, *_ = own(text)
        assert byte.encode(" " + text) == x
        assert op12_alignment.encode_text(text, byte, piece, 7) == (x, y)
    text = " ".join(rng.choice(["word", "it's", " ", "9", "a\n", "Zoë", "end."]) for _ in range(3000))
    assert op12_alignment.encode_text(text, byte, piece, 50) == own(text)[:2]
    assert "".join(op12_alignment.parts(text, 50)) == text
