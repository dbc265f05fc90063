"""Logistic classifier over hashed word features, learned from a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import fold, line, schema

SLOTS = 1 << 20


def sample_labels(labels: DataFrame, column: str, rows: int, folds: int = 5, left_out: int = 0) -> DataFrame:
    """At most ``rows`` labelled ids outside the left-out fold, the least by hash: ``id, y``. Repeated ids count as 1 if any does."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    own = known.groupBy("doc_id").agg(F.max((F.col(column) > 0).cast("int")).alias("y"))
    own = own.where(fold(F.col("doc_id"), folds) != left_out)
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("id"), "y")


def fit(docs: DataFrame, sample: DataFrame, slots_of: Callable, top: int = 2048, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the ``top`` most telling slots: slots, weights, bias.

    ``slots_of()`` runs in each task and returns a function from an Arrow array of texts (ended by line feeds) to
    the distinct slots of each. The sample is bounded, so it is broadcast, and so are its rows of
    features that come to the driver: at most ``top`` slots of each sampled row.
    """
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("id")).select("y", line(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, seen, marked, n = slots_of(), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for label, slots in zip(y, work(batch.column(1)), strict=True):
                seen[slots] += 1
                n += (1, label)
                if label:
                    marked[slots] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n[0])), pa.array(np.append(marked[at], n[1]))],
            ["slot", "seen", "marked"])

    counts = rows.mapInArrow(count, schema(slot="bigint", seen="bigint", marked="bigint")).groupBy("slot").agg(
        F.sum("seen").alias("seen"), F.sum("marked").alias("marked"))
    total = counts.where("slot = -1").first()
    if total is None or not 0 < total.marked < total.seen:
        bias = 0.0 if total is None or not total.seen else (30.0 if total.marked else -30.0)
        return np.zeros(0, np.int64), np.zeros(0), bias
    n, m = total.seen, total.marked
    rate = m / n
    gap = F.col("marked") - F.col("seen") * F.lit(rate)
    strength = gap * gap / (F.col("seen") * F.lit(rate * (1 - rate)) * (1 - F.col("seen") / F.lit(n + 1)))
    best = counts.where("slot >= 0 AND seen >= 5").orderBy(strength.desc(), "slot").limit(top).collect()
    slots = np.sort(np.array([r.slot for r in best], np.int64))
    if not len(slots):
        return slots, np.zeros(0), float(np.log(rate / (1 - rate)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = slots_of()
        for batch in batches:
            own = [np.searchsorted(slots, s[np.isin(s, slots)]) for s in work(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["y", "x"])

    table = rows.mapInArrow(encode, schema(y="int", x="array<bigint>")).collect()
    y = np.array([r.y for r in table], float)
    row = np.repeat(np.arange(len(table)), [len(r.x) for r in table])
    col = np.concatenate([np.array(r.x, np.int64) for r in table])
    w, b = np.zeros(len(slots)), float(np.log(rate / (1 - rate)))
    scale = 4.0 / (1 + np.bincount(row, minlength=len(y)).max())
    momentum, mb = np.zeros_like(w), 0.0
    for _ in range(400):  # gradient steps with momentum on the mean log loss
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -30, 30)))
        e = p - y
        g = np.bincount(col, e[row], len(w)) + l2 * w
        momentum, mb = 0.9 * momentum - scale * g / len(y) * 20, 0.9 * mb - scale * e.sum() / len(y) * 20
        w, b = w + momentum, b + mb
    return slots, w, float(b)


def scores(slots_per_text: list[np.ndarray], dense: np.ndarray, bias: float) -> np.ndarray:
    z = np.array([dense[s].sum() for s in slots_per_text]) + bias if slots_per_text else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def dense_weights(slots: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(SLOTS)
    out[slots] = w
    return out
