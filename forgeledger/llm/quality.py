"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are words and pairs of neighbouring words, hashed to ``1 << BITS`` places; a word that follows itself
makes one feature of its own, whatever the word. A document is the vector of its features' counts,
scaled to length ``SCALE``, so that its score is a sparse dot product that does not grow with its length.

Training takes at most ``SAMPLE`` labelled documents, those whose ids have the least hash. They are
dealt to ``SHARDS`` tasks; each makes ``EPOCHS`` passes of per-coordinate updates, and the weights of
a feature are averaged by the squared gradients that each task saw of it. The model has
``(1 << BITS) + 1`` weights whatever the input; it alone is broadcast, and scoring shuffles nothing.

Columns ``doc_id`` and ``text`` of documents and ``doc_id, quality`` of labels are read. Null and empty texts
have no features and score what the constant says. Labels without an id or a quality are ignored, of several
for an id the largest counts. Without labels every score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import per_batch

BITS = 18
SAMPLE, SHARDS, EPOCHS = 32_768, 4, 5
SCALE, ALPHA, BETA, L1, L2 = 4.0, 0.5, 1.0, 0.0, 0.1
THRESHOLD = 0.7

_CONSTANT = 1 << BITS
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's places and values; the last place is the constant."""
    hashes, ends = W.word_hashes(texts)
    found = []
    for a, b in pairwise(ends):
        own = hashes[a:b]
        two = W.rolling(own, 2)
        two[own[1:] == own[:-1]] = _AGAIN
        places, counts = np.unique(np.concatenate([own, two]) >> np.uint64(64 - BITS), return_counts=True)
        values = counts * (SCALE / max(1.0, float(np.sqrt((counts.astype(float) ** 2).sum()))))
        found.append((np.append(places.astype(np.int64), _CONSTANT), np.append(values, 1.0)))
    return found


def _probability(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0))))


class Leader:
    """Follow-the-regularised-leader with a learning rate for each coordinate."""

    def __init__(self):
        self.z, self.n = np.zeros(_CONSTANT + 1), np.zeros(_CONSTANT + 1)

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w, n = self.weights(places), self.n[places]
        gradient = (_probability(w @ values) - label) * values
        step = (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA
        self.z[places] += gradient - step * w
        self.n[places] += gradient**2


def _train(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by([("turn", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    leader, labels = Leader(), shard["quality"].to_pylist()
    rows = [x for piece in shard["text"].chunks for x in features(piece)]
    for _ in range(EPOCHS):
        for (places, values), label in zip(rows, labels, strict=True):
            leader.learn(places, values, label)
    seen = np.flatnonzero(leader.n)
    return pa.table({"place": seen, "weighted": leader.weights(seen) * leader.n[seen], "mass": leader.n[seen]})


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The weights, learned from the labelled documents that are not held out."""
    id_ = F.col("doc_id").cast("bigint")
    known = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(id_))
        .groupBy(id_.alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    )
    # A bounded table of ids and labels.
    sample = known.withColumn("turn", F.xxhash64("doc_id", F.lit(1))).orderBy("turn", "doc_id").limit(SAMPLE)
    shards = (
        docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SHARDS)))
    )
    learned = shards.groupBy("shard").applyInArrow(_train, "place bigint, weighted double, mass double")
    mixed = learned.groupBy("place").agg((F.sum("weighted") / F.sum("mass")).alias("weight")).collect()
    weights = np.zeros(_CONSTANT + 1, np.float32)
    for row in mixed:
        weights[row.place] = row.weight
    return weights


def _scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    return np.array([_probability(float(weights[p] @ v)) for p, v in features(texts)], float)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(_scores(batch.column(1), shared.value))})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return per_batch(rows, run, "doc_id bigint, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(batch.column("text"), shared.value) >= THRESHOLD))

    return per_batch(docs, run, docs.schema)
