"""Bounded training samples: the only rows that operators of this subpackage
bring to the driver or to one task, by a documented bound on rows and on bytes."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

#: Longest text (bytes) that is trained on; longer ones are scored like all others.
MAX_BYTES = 65_536
#: Most labels that are learned; a column with more is refused with an error.
MAX_LABELS = 1000


def crc_rest(key, n: int):
    """crc32(key as text) modulo n; null keys give the rest of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _shares(rows: DataFrame, label: str, per_label: int):
    """The share of each label's rows to be picked (a column), and the most rows in all."""
    counts = rows.groupBy(label).agg(F.count("*")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"{label} has more than {MAX_LABELS} values")
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    return share, int(1.5 * per_label * max(1, len(counts)))


def _first(rows: DataFrame, label: str, most: int) -> DataFrame:
    """Wholly equal rows count once; of more than ``most`` rows, those first by hash, id, label and text."""
    rows = rows.select("doc_id", label, "text").distinct()
    return rows.orderBy(unit_hash("doc_id", F.lit("train")), "doc_id", label, "text").limit(most)


def _ordered(rows) -> list:
    return sorted(rows, key=lambda r: (r[0], r[2]))


def sample(rows: DataFrame, label: str, per_label: int) -> list:
    """About ``per_label`` rows of each label (all, if there are fewer), chosen by a
    hash of doc_id, whatever the partitioning; at most 1.5 times as many. rows:
    doc_id, text, label."""
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_BYTES))
    share, most = _shares(rows, label, per_label)
    return _ordered(_first(rows.where(unit_hash("doc_id", F.lit("train")) < share), label, most).collect())


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """The same, not yet collected, for labels kept apart from the texts (labels: doc_id, label; one row
    an id): the ids are chosen first and broadcast, at most 1.5 * ``per_label`` of
    each label, so that no text but the chosen ones is shuffled."""
    share, most = _shares(labels, label, per_label)
    chance = unit_hash("doc_id", F.lit("train"))
    picked = labels.where(chance < share).orderBy(chance, "doc_id").limit(most)
    rows = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_BYTES)).join(F.broadcast(picked), "doc_id")
    return _first(rows, label, most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> list:
    """The rows of ``labelled_rows`` on the driver."""
    return _ordered(labelled_rows(docs, labels, label, per_label).collect())


def fitted(rows: DataFrame, fit):
    """``fit`` of the list of a sample's rows, in the order of ``sample``. It runs in a task,
    so that only the model comes to the driver."""
    def run(batches):
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_ordered(held)))], pa.binary())], names=["model"])
    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])  # no task runs for a sample known to be empty
