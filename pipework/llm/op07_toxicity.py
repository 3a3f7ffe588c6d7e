"""Toxicity by a support vector machine on a subsequence string kernel, with
Nystroem landmarks.

The kernel counts common three-letter subsequences of two words, gaps allowed
and discounted, so suffixes and inserted characters cost little; punctuation
inside a word, spaced-out letters and common digit spellings are undone first.
The Nystroem map through the landmarks makes the machine linear, and as each
kernel value is a sum over subsequences, the whole decision function folds
into one weight per subsequence: scoring a text is one pass over its letters.
A document is scored by its worst words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, columns
from .training import crc_rest, fitted, labelled_rows

DECAY = 0.5
GAPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5]
WINDOW = 13  # letters of a word (with the mark) that are judged together
STEMS = (5, 6, 7)  # lengths of word beginnings (with the mark) that are counted as words of their own
#: A word is taken for a bad one from this log-likelihood ratio (times 2) on.
EVIDENCE = 24
LANDMARKS = 320
#: Clean words, picked at random, among which those that the machine gets wrong are looked for; and how many are added a time.
MINED, ADDED = 100_000, 1500
#: Words that the machine is trained on: at most so many bad ones (the most frequent), the most
#: frequent clean ones, and clean ones picked at random; and words of each side among which landmarks are looked for.
BAD_WORDS, CLEAN_WORDS, RANDOM_WORDS, CANDIDATES = 1500, 1500, 3000, 600
#: Labelled rows of each class that are trained on.
PER_CLASS = 1500

MARK = 63
_SKIP, _BREAK = 0, 255
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
for _c, _l in zip(b"013457@$", b"oieastas", strict=True):
    _CODE[_c] = _l - 96
_CODE[0x80:0xC0] = 27 + (np.arange(64) & 31)
_CODE[[32, 9, 10, 11, 12, 13]] = _BREAK


def letters(data: np.ndarray, off: np.ndarray):
    """Letter codes of a chunk, with the index of each letter's word and each word's row."""
    cls = _CODE[data]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    cut = cls == _BREAK
    cut[off[:-1][off[:-1] < len(data)]] = True
    word = np.cumsum(cut)
    on = (cls != _BREAK) & (cls != _SKIP)
    code, word, row = cls[on].astype(np.int64), word[on], row[on]
    if not len(code):
        return code, word, row[:0]
    new = np.r_[True, word[1:] != word[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(code)])
    wrow = row[start]
    # neighbouring single letters of a text are one spaced-out word
    join = np.r_[False, (size[1:] == 1) & (size[:-1] == 1) & (wrow[1:] == wrow[:-1])]
    index = np.cumsum(~join) - 1
    first = start[~join]  # every word begins with a mark of its own
    return np.insert(code, first, MARK), np.insert(np.repeat(index, size), first, np.arange(len(first))), wrow[~join]


def subsequences(code: np.ndarray, word: np.ndarray):
    """(first letter's position, index, weight) of each gapped triple within a word."""
    for a, b in GAPS:
        n = len(code) - a - b
        if n <= 0:
            continue
        at = np.flatnonzero(word[:n] == word[a + b:])
        yield at, (code[at] << 12) | (code[at + a] << 6) | code[at + a + b], DECAY ** (a + b - 2)


def window_scores(code: np.ndarray, word: np.ndarray, v: np.ndarray):
    """Normalised kernel sums of each window (a word's first WINDOW letters, or any WINDOW letters of a longer word) and its word."""
    a, n = np.zeros(len(code) + 1), np.zeros(len(code) + 1)
    for at, idx, weight in subsequences(code, word):
        a[1:][at] += weight * v[idx]
        n[1:][at] += weight * weight
    a, n = np.cumsum(a), np.cumsum(n)
    first = np.r_[True, word[1:] != word[:-1]]
    start = np.flatnonzero(first)
    end = np.repeat(np.r_[start[1:], len(code)], np.diff(np.r_[start, len(code)]))
    at = np.flatnonzero(first | (np.arange(len(code)) + WINDOW <= end))
    to = np.minimum(at + WINDOW, end[at])
    return (a[to] - a[at]) / np.sqrt(n[to] - n[at] + 0.5), word[at]


def document_features(model: dict, column: pa.Array) -> np.ndarray:
    """Per text: worst word, sum of the margins of bad words, number of words (log)."""
    out = []
    for _, _, data, off in byte_chunks(column, 1 << 19):
        n = len(off) - 1
        x = np.zeros((n, 3))
        x[:, 0] = -3.0
        code, word, wrow = letters(data, off)
        if len(code):
            f, w = window_scores(code, word, model["v"])
            f = np.clip(f + model["b"], -3, 3)
            r = wrow[w]
            np.maximum.at(x[:, 0], r, f)
            x[:, 1] = np.log1p(np.bincount(r, weights=np.maximum(f, 0), minlength=n))
            x[:, 2] = np.log1p(np.bincount(wrow, minlength=n))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 3))


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge=0.05) -> np.ndarray:
    """Weights, with a bias last; rows count so that ``share`` of them is toxic."""
    n = max(y.sum(), 1.0)
    part = np.where(y > 0, share * len(y) / n, (1 - share) * len(y) / max(len(y) - n, 1.0))
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (part * (q - y)) + ridge * w
        h = (x * (part * (q * (1 - q) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -3, 3)
    return w


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Squared-hinge linear machine (z: a last column of ones, for the bias), by Newton steps on the active rows."""
    w = np.zeros(z.shape[1])
    reg = np.r_[np.ones(z.shape[1] - 1), 1e-3]
    for _ in range(40):
        on = np.flatnonzero(y * (z @ w) < 1)
        g, h = reg * w, np.diag(reg)
        for i in range(0, len(on), 512):  # active rows are copied a few at a time
            at = on[i:i + 512]
            x = z[at]
            g = g - c * x.T @ (weight[at] * (y[at] - x @ w))
            h += c * (x * weight[at][:, None]).T @ x
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _word_keys(text: str) -> set[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    code, word, _ = letters(data, np.array([0, len(data)]))
    if not len(code):
        return set()
    raw = code.astype(np.uint8).tobytes()
    cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]).tolist() + [len(code)]
    return {raw[i:j] for i, j in zip(cut, cut[1:], strict=False) if j - i >= 4}


def _maps(keys: list[bytes]):
    """Sparse subsequence maps of words (first WINDOW letters): indices, weights, norms."""
    out = []
    for k in keys:
        code = np.frombuffer(k[:WINDOW], np.uint8).astype(np.int64)
        idx, val = [], []
        for _, i, weight in subsequences(code, np.zeros(len(code), np.int64)):
            idx.append(i)
            val.append(np.full(len(i), weight))
        idx = np.concatenate(idx) if idx else np.zeros(0, np.int64)
        val = np.concatenate(val) if val else np.zeros(0)
        out.append((idx, val / np.sqrt((val * val).sum() + 0.5)))
    return out


def _dense(maps):
    """Subsequences of the maps, their matrix (a last row of zeros), and the row of every subsequence."""
    used = np.unique(np.concatenate([i for i, _ in maps] + [np.zeros(1, np.int64)]))
    place = np.full(1 << 18, len(used))
    place[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(maps)), np.float32)
    for j, (i, x) in enumerate(maps):
        np.add.at(table[:, j], place[i], x)
    return used, table, place


def _landmarks(keys: list[bytes]) -> list[bytes]:
    """Words that span the others' kernel best: pivots of an incomplete Cholesky factorisation."""
    _, x, _ = _dense(_maps(keys))
    gram = (x.T @ x).astype(float)
    left, rows, out = gram.diagonal().copy(), np.zeros((0, len(keys))), []
    for _ in range(min(LANDMARKS, len(keys))):
        j = int(left.argmax())
        if left[j] < 1e-3:
            break
        row = (gram[j] - rows[:, j] @ rows) / np.sqrt(left[j])
        rows = np.r_[rows, row[None]]
        left = np.maximum(left - row * row, 0)
        left[j] = -1
        out.append(j)
    return [keys[j] for j in out]


def fit(rows: list[tuple[int, str]], share: float = 0.5) -> dict:
    """Model from (toxic, text) rows. Words (and word beginnings) that stand almost
    only in toxic texts are the positive examples, words of clean texts the
    negative ones; clean words the machine gets wrong are added and it is
    trained again."""
    empty = {"v": np.zeros(1 << 18, np.float32), "b": -1.0, "doc": np.array([0.0, 0.0, 0.0, -3.0])}
    bad, good, words, nt, nc = Counter(), Counter(), set(), 0, 0
    for y, t in rows:  # words are counted text by text; no text's words are held
        d = _word_keys(t)
        (bad if y else good).update({k[:n] for k in d for n in STEMS} | d)
        if y:
            words |= d
        nt, nc = nt + bool(y), nc + (not y)
    if not nt or not nc:
        return empty

    def evidence(k):  # signed log-likelihood ratio of the word against the classes' shares
        a, c = bad[k], good[k]
        if a * nc <= 8 * max(c, 0.5) * nt:
            return 0.0
        n, p = a + c, (a + c) / (nt + nc)
        term = lambda x, e: x * np.log(x / e) if x else 0.0
        return 2 * (term(a, nt * p) + term(c, nc * p) + term(nt - a, nt * (1 - p)) + term(nc - c, nc * (1 - p))) if 0 < n < nt + nc else 0.0

    strong = {k: e for k in bad if bad[k] >= 3 and (e := evidence(k)) > EVIDENCE}
    weight_of = lambda k: max(strong.get(k, 0.0), *(strong.get(k[:n], 0.0) for n in STEMS))
    pos = sorted((k for k in words if weight_of(k) > 0), key=lambda k: (-bad[k], k))[:BAD_WORDS]
    if not pos:
        return empty
    negs = sorted(k for k in good if weight_of(k) == 0 and len(k) >= 4)
    rng = np.random.default_rng(3)
    pool = [negs[i] for i in rng.permutation(len(negs))[:MINED]]
    neg = sorted(set(sorted(negs, key=lambda k: (-good[k], k))[:CLEAN_WORDS]) | set(pool[:RANDOM_WORDS]))
    often = np.array([float(bad[k]) for k in pos])  # a bad word counts by the texts it is in
    often = (often / often.sum() + 1 / len(pos)) / 2
    bad, good, words, strong, negs = None, None, None, None, None  # the machine needs none of them
    marks = _landmarks(pos[:CANDIDATES] + [neg[i] for i in rng.permutation(len(neg))[:CANDIDATES]])
    lm = _maps(marks)
    used, table, place = _dense(lm)
    gram = table.T @ table
    val, vec = np.linalg.eigh(gram + 1e-6 * np.eye(len(lm)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
    kernel = lambda keys: np.array([x @ table[place[i]] for i, x in _maps(keys)]).reshape(len(keys), len(lm))
    zp, zn = kernel(pos) @ root, kernel(neg) @ root
    for turn in range(4):
        y = np.r_[np.ones(len(zp)), -np.ones(len(zn))]
        w = _svm(np.c_[np.r_[zp, zn], y * y], y, np.r_[often, np.full(len(zn), 2 / len(zn))] * len(zp))
        v = np.zeros(1 << 18)
        v[used] = table[:-1] @ (root @ w[:-1])
        model = {"v": v.astype(np.float32), "b": float(w[-1])}
        if turn < 3:  # clean words on the wrong side, or near it
            worst = np.full(len(pool), -9.0)
            for i in range(0, len(pool), 10_000):
                part = pool[i:i + 10_000]
                code = np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
                f, word = window_scores(code, np.repeat(np.arange(len(part)), [len(k) for k in part]), model["v"])
                np.maximum.at(worst, i + word, f + model["b"])
            there = set(neg)
            hard = [pool[i] for i in np.argsort(-worst, kind="stable")[:3 * ADDED] if worst[i] > -0.9 and pool[i] not in there][:ADDED]
            if not hard:
                break
            neg = neg + hard
            zn = np.r_[zn, kernel(hard) @ root]
    x = document_features(model, pa.array([t for _, t in rows]))
    model["doc"] = _logistic(x, np.array([float(bool(y)) for y, _ in rows]), share)
    return model


def probabilities(model: dict, column: pa.Array) -> np.ndarray:
    x = document_features(model, column)
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model["doc"], -30, 30)))


def score(docs: DataFrame, model: dict, id_col="doc_id", text_col="text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; one row per row of docs. Null and empty texts
    have no words and get the low score of a text without any. Whole texts are
    read, of any length; other columns are not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    d = columns(docs, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            p = probabilities(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", fold: int = 4, held: int = 2,
          per_class: int = PER_CLASS) -> dict:
    """Model from labelled rows whose crc32(id as text) mod ``fold`` is not ``held``:
    at most 1.5 * 2 * ``per_class`` rows, which one task trains on. An id with several labels is toxic if one says so."""
    lab = columns(labels, doc_id=id_col, toxic=label_col).where((crc_rest(F.col("doc_id"), fold) != held) & F.col("toxic").isNotNull())
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bad, n = lab.agg(F.sum((F.col("toxic") > 0).cast("int")), F.count("*")).first()
    share = (bad or 0) / n if n else 0.5
    rows = labelled_rows(columns(docs, doc_id=id_col, text=text_col), lab, "toxic", per_class)
    return fitted(rows, lambda sample: fit([(r[1], r[2]) for r in sample], share))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for all of ``docs``; see train and score."""
    out = score(docs, train(docs, labels, fold=fold, held=held), threshold=threshold)
    return out.select("doc_id", (crc_rest(F.col("doc_id"), fold) == held).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: dict, text_col="text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(probabilities(shared.value, b.column(text_col)) < threshold, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
