"""Quality by hierarchical empirical Bayes.

A classifier judges each document on its own text. Grouped sums of labels and
of its judgements give every path a posterior that is shrunk toward its host's,
and every host one shrunk toward the global prior; how strongly is estimated
from the spread between the sites themselves. A document's score joins the
evidence of its text with the posterior of its path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_chunks, columns, keep, maybe_broadcast, run_hashes, words
from .training import crc_rest, labelled_sample

#: Labelled rows of each class that the classifier is trained on.
PER_CLASS = 2000
#: What a document's own judgement counts in its site's sums, against 1 for a label.
SOFT = 0.25
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123, 128:256]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def features(column: pa.Array) -> np.ndarray:
    """Per text: sizes, shares of character classes, repetition of words and lines."""
    out = []
    for _, _, data, off in byte_chunks(column, 1 << 19):
        n = len(off) - 1
        row = np.repeat(np.arange(n), np.diff(off))
        size = np.maximum(np.diff(off), 1).astype(float)
        share = lambda mask, row=row, size=size, n=n: np.bincount(row[mask], minlength=n) / size
        gap = SPACE[data]
        s, e, first = words(data, off)
        count = np.diff(first).astype(float)
        h = run_hashes(LOWER[data], s, e)
        wrow = row[s] if len(s) else np.zeros(0, np.int64)
        order = np.lexsort((h, wrow))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (wrow[order][1:] != wrow[order][:-1])] if len(h) else np.zeros(0, bool)
        distinct = np.bincount(wrow[order][new], minlength=n)
        k = np.maximum(count, 1)
        out.append(np.stack([
            np.log1p(count), share(_LETTER[data]), share(_DIGIT[data]), share(_CAPITAL[data]), share(gap),
            share(data == 10), share(~(_LETTER[data] | _DIGIT[data] | gap)), distinct / k,
            np.minimum(np.bincount(wrow, weights=(e - s).astype(float), minlength=n) / k, 40) / 10,
            share((data == 46) | (data == 44)), (count == 0).astype(float)], 1))
    return np.concatenate(out) if out else np.zeros((0, 11))


def _expand(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["sd"], -4, 4)
    return np.c_[z, z * z, np.ones(len(z))]


def fit(rows: list[tuple[int, str]]) -> dict:
    """Ridged logistic regression on the features and their squares."""
    x = features(pa.array([t for _, t in rows], pa.string())) if rows else np.zeros((1, 11))
    y = np.array([float(bool(q)) for q, _ in rows]) if rows else np.array([0.5])
    model = {"mean": x.mean(0), "sd": x.std(0) + 1e-6, "prior": float((y.sum() + 0.5) / (len(y) + 1))}
    z, w = _expand(x, model), None
    w = np.zeros(z.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (q * (1 - q) + 1e-6)[:, None]).T @ z + np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, z.T @ (q - y) + w), -3, 3)
    return model | {"w": w}


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text, ...) with ``logit``, the classifier's log odds against its own prior, instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name != "text"]
    prior = float(np.log(model["prior"] / (1 - model["prior"])))

    def run(batches):
        for b in batches:
            logit = np.clip(_expand(features(b.column("text")), shared.value) @ shared.value["w"], -8, 8) - prior
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in rest] + [pa.array(logit, pa.float64())],
                                             names=[f.name for f in rest] + ["logit"])
    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", logit double")


def _strength(groups: DataFrame, mean) -> float:
    """Prior strength (in documents) by moments: how far the groups' means spread
    beyond what their sizes explain. Between 2 and 500."""
    m = F.col("y") / F.col("n")
    row = groups.where("n > 0").agg(F.sum("n"), F.sum(F.col("n") * (m - mean) ** 2), F.count("*"), F.sum(F.col("n") * mean * (1 - mean)),
                                    F.sum(F.col("n") * F.col("n"))).first()
    total, spread, k, unit, squares = [float(x or 0) for x in row]
    if k < 2 or total <= 0 or unit <= 0:
        return 50.0
    base = unit / total
    between = (spread - (k - 1) * base) / max(total - squares / total, 1e-9)
    return float(min(500.0, max(2.0, base / between - 1))) if between > 0 else 500.0


def quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host_col="source", path_col="lang",
            label_col="quality", fold: int = 4, held: int = 2, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, host, path, doc_score (text alone), site_score (posterior
    of the path), score, keep (score >= threshold); one row per row of docs.

    Learns, and counts labels, only from rows whose crc32(id as text) mod
    ``fold`` is not ``held``. Null hosts and paths are sites of their own. Null
    and empty texts are judged as texts without words. Without labels all
    scores stay at the prior one half. Repeated rows count and come back each;
    an id with several labels is good if one says so. Other columns are not read."""
    d = columns(docs, doc_id=id_col, text=text_col, host=host_col, path=path_col)
    lab = columns(labels, doc_id=id_col, label=label_col).where((crc_rest(F.col("doc_id"), fold) != held) & F.col("label").isNotNull())
    lab = keep(lab.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "labels")
    model = fit([(r[1], r[2]) for r in labelled_sample(d.select("doc_id", "text"), lab, "label", PER_CLASS)])
    base = lab.agg(F.sum("label"), F.count("*")).first()
    prior = ((base[0] or 0) + 0.5) / (base[1] + 1)
    centre = float(np.log(prior / (1 - prior)))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    seen = keep(evidence(d, model), "evidence").join(lab, "doc_id", "left")
    seen = keep(seen.withColumn("own", logistic(F.col("logit") + centre)), "judged")
    part = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT)
    sites = keep(seen.groupBy("host", "path").agg(F.sum(part).alias("n"), F.sum(
        F.when(F.col("label").isNotNull(), F.col("label").cast("double")).otherwise(F.col("own") * SOFT)).alias("y")), "sites")
    hosts = keep(sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "hosts")
    mean = hosts.agg(F.sum("y") / F.sum("n")).first()[0]
    mean = prior if mean is None else mean
    kh = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.struct("host").alias("hk"), ((F.col("y") + kh * mean) / (F.col("n") + kh)).alias("hm"))
    paths = keep(sites.withColumn("hk", F.struct("host")).join(hosts, "hk"), "paths")
    kp = _strength(paths, F.col("hm"))
    paths = paths.select(F.struct("host", "path").alias("site"), ((F.col("y") + kp * F.col("hm")) / (F.col("n") + kp)).alias("site_score"))
    out = seen.withColumn("site", F.struct("host", "path")).join(maybe_broadcast(paths), "site")
    s = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("site_score")))
    out = out.withColumn("score", logistic(F.col("logit") + F.log(s / (1 - s))))
    return out.select("doc_id", (crc_rest(F.col("doc_id"), fold) == held).alias("held_out"), "host", "path",
                      F.col("own").alias("doc_score"), "site_score", "score", (F.col("score") >= threshold).alias("keep"))
