"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over byte n-grams predicts
each bit. A text's bit margins are decoded to the codeword of smallest loss;
near ties are flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_chunks, columns, mix
from .training import crc_rest, sample

SIZE = 1 << 16  # hashed n-grams
ORDERS = (2, 3, 4)
#: Training rows of a language.
PER_LANGUAGE = 600

# letters stay, everything else ASCII is a gap
_CLASS = LOWER.copy()
_CLASS[:128][~np.isin(np.arange(128), np.r_[65:91, 97:123])] = 32


def codewords(n: int, bits: int | None = None, seed: int = 7) -> np.ndarray:
    """n codewords of +1/-1: all splits of the languages in two for few
    languages, else random ones chosen for their distance."""
    if n <= 1:
        return np.ones((max(n, 1), 1))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        code = np.array([[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in splits] for i in range(n)])
        return code.astype(float)
    bits = bits or max(31, int(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, gap = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        d = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if d > gap and (np.abs(code.sum(0)) < n).all():
            best, gap = code, d
    return best


def _grams(data: np.ndarray, off: np.ndarray):
    """Hashed n-grams of a chunk and the row of each."""
    c = _CLASS[data].astype(np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out_h, out_r = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        blank = np.zeros(len(h), np.int8)
        for j in range(n):
            part = c[j:len(c) - n + 1 + j]
            h = h * np.uint64(257) + part
            blank += part == 32
        ok = (row[:len(h)] == row[n - 1:]) & (blank < n - 1)
        out_h.append((mix(h[ok]) & np.uint64(SIZE - 1)).astype(np.int64))
        out_r.append(row[:len(h)][ok])
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r)


def fit(rows: list[tuple[str, str]]) -> dict:
    """Classifiers of all bits from (lang, text) rows: n-gram log odds, averaged
    over the text, then scaled by a logistic fit."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return {"langs": [], "code": codewords(0), "w": np.zeros((SIZE, 1), np.float32), "scale": np.ones(1), "bias": np.zeros(1)}
    code = codewords(len(langs))
    counts = np.ones((len(langs), SIZE)) * 0.5
    feats = []
    for lang, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        h, _ = _grams(data, np.array([0, len(data)]))
        x = np.bincount(h, minlength=SIZE)
        feats.append((langs.index(lang), h))
        counts[langs.index(lang)] += x / max(1, len(h))  # each text counts alike
    p = counts / counts.sum(1, keepdims=True)
    w, scale, bias = [], [], []
    for b in range(code.shape[1]):
        plus, minus = p[code[:, b] > 0].mean(0) if (code[:, b] > 0).any() else p.mean(0), p[code[:, b] < 0].mean(0) if (code[:, b] < 0).any() else p.mean(0)
        wb = np.log(plus / minus)
        f = np.array([wb[h].mean() if len(h) else 0.0 for _, h in feats])
        y = np.array([code[k, b] for k, _ in feats])
        s, c = 1.0, 0.0
        for _ in range(50):  # logistic fit of scale and bias, lightly ridged
            q = 1 / (1 + np.exp(-np.clip(s * f + c, -30, 30)))
            g = np.array([((q - (y > 0)) * f).sum() + 0.01 * s, (q - (y > 0)).sum() + 0.01 * c])
            v = q * (1 - q) + 1e-9
            hess = np.array([[(v * f * f).sum() + 0.01, (v * f).sum()], [(v * f).sum(), v.sum() + 0.01]])
            d = np.clip(np.linalg.solve(hess, g), -5, 5)
            s, c = s - d[0], c - d[1]
        w.append(wb), scale.append(s), bias.append(c)
    return {"langs": langs, "code": code, "w": np.stack(w, 1).astype(np.float32), "scale": np.array(scale), "bias": np.array(bias)}


def margins(model: dict, column: pa.Array) -> np.ndarray:
    """Signed margin of every bit for every text of a column."""
    out = []
    for _, _, data, off in byte_chunks(column, 1 << 19):
        h, r = _grams(data, off)
        n = len(off) - 1
        k = np.maximum(np.bincount(r, minlength=n), 1)
        sums = np.stack([np.bincount(r, weights=model["w"][:, b][h], minlength=n) for b in range(model["w"].shape[1])], 1)
        out.append(sums / k[:, None] * model["scale"] + model["bias"])
    return np.concatenate(out) if out else np.zeros((0, model["w"].shape[1]))


def decode(model: dict, m: np.ndarray, near: float = 0.5):
    """(index of the best language, score, ambiguous) by logistic loss against each codeword."""
    loss = np.logaddexp(0, -np.clip(m, -20, 20)[:, None, :] * model["code"][None]).sum(2)
    p = np.exp(-(loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    two = np.sort(loss, 1)
    close = two[:, 1] - two[:, 0] < near if loss.shape[1] > 1 else np.zeros(len(best), bool)
    return best, p[np.arange(len(best)), best], close


def identify(docs: DataFrame, model: dict, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous; one row per row of docs.

    Null, empty and letterless texts are ``und`` with score 0; so is every text
    if no language was learned. Whole texts are read, of any length. Repeated
    rows are scored alike; other columns are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: SIZE rows, one column per bit
    d = columns(docs, doc_id=id_col, text=text_col).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def score(batches):
        m = shared.value
        for b in batches:
            letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if not m["langs"]:
                pred, conf, close = ["und"] * len(letters), np.zeros(len(letters)), np.zeros(len(letters), bool)
            else:
                best, conf, close = decode(m, margins(m, b.column("text")))
                pred = [m["langs"][k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                conf, close = np.where(letters, conf, 0.0), close & letters
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(close)],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])
    return d.mapInArrow(score, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", fold: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from rows whose crc32(id as text) mod ``fold`` is not 0 (at most 1.5 *
    ``per_language`` of each language), predicts all. Adds held_out."""
    d = columns(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = sample(d.where(crc_rest(F.col("doc_id"), fold) != 0), "lang", per_language)
    model = fit([(r[1], r[2]) for r in rows])
    out = identify(d, model)
    return out.select("doc_id", (crc_rest(F.col("doc_id"), fold) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
