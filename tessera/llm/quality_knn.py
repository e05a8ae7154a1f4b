"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A whole text becomes counts of byte-class pairs and of a few word shapes, weighted by
inverse document frequency and projected by a truncated SVD. Vectors of a bounded, labelled
sample are broadcast; every document is compared with all of them in blocks of exact cosine
products, and its nearest neighbours vote with the power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import held_out, labelled_texts

CLASSES = 64
#: Word shapes: three shares of a text, each in eight steps.
SHAPES = 24
SHAPE_COUNT = 3000.0
WIDTH = CLASSES * CLASSES + SHAPES
#: Bounds of what is learned and broadcast.
SAMPLE_PER_LABEL = 1024
RANK = 64
NEIGHBOURS = 25
POWER = 8.0
KEEP_FROM = 0.7
BLOCK = 512


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 61, np.uint16)  # other ASCII
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        kinds[c] = i
    kinds[65:91], kinds[48:58] = 26, 27
    for i, c in enumerate(b" \n\t!#*$%&|<>.,;:?'\"-/()[]{}@_=+"):
        kinds[c] = 28 + i
    kinds[0x80:0xC0], kinds[0xC0:] = 62, 63
    return kinds


_KINDS = _byte_classes()


def counts(text: str | None) -> np.ndarray:
    """Feature counts of one whole text; all zero for a text without bytes."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = _KINDS[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=WIDTH).astype(np.float32) if len(raw) > 1 else np.zeros(WIDTH, np.float32)
    words = raw.split()
    if words:
        again = sum(map(bytes.__eq__, words, words[1:]))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        shares = (again / len(words), 1 - len(set(words)) / len(words), 1 - len(set(lines)) / max(1, len(lines)))
        for i, share in enumerate(shares):
            pairs[CLASSES * CLASSES + 8 * i + min(7, int(share * 8))] = SHAPE_COUNT
    return pairs


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    fair: np.ndarray  # a vote's weight, so that both labels weigh as much in all

    def embed(self, features: np.ndarray) -> np.ndarray:
        weighed = np.log1p(features) * self.idf
        weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)
        latent = weighed @ self.project
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Votes of the nearest neighbours; the prior where there is nothing to compare."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            latent = self.embed(np.stack([counts(t) for t in texts[at : at + BLOCK]]))
            near = latent @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER * self.fair[best]
            total = weight.sum(1)
            votes = (weight * self.labels[best]).sum(1)
            out[at : at + len(latent)] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0.0, 1.0)


def _fair(labels: np.ndarray) -> np.ndarray:
    good = max(1.0, labels.sum())
    bad = max(1.0, len(labels) - labels.sum())
    return np.where(labels > 0, 1 / good, 1 / bad)


def fit(features: np.ndarray, labels: np.ndarray) -> Model:
    """Truncated SVD by a seeded randomised range finder; ``features`` is weighted in place."""
    if not len(labels):
        empty = np.zeros((0, RANK), np.float32)
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32), empty, labels, 0.5, labels)
    idf = np.log((1 + len(features)) / (1 + (features > 0).sum(0))).astype(np.float32) + 1
    weighed = np.log1p(features, out=features)
    weighed *= idf
    weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)
    rank = min(RANK, *weighed.shape)
    basis = np.random.default_rng(5).standard_normal((weighed.shape[1], min(rank + 16, *weighed.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighed.T @ (weighed @ basis))
    _, _, right = np.linalg.svd(weighed @ basis, full_matrices=False)
    model = Model(idf, (basis @ right[:rank].T).astype(np.float32), np.zeros((0, rank), np.float32), labels, float(labels.mean()), _fair(labels))
    latent = weighed @ model.project
    model.vectors = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on about ``sample_per_label`` documents of each label outside the held-out quarter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts(t) for t in batch["text"]]
            at = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [a.astype(np.int32) for a in at], "n": [c[a] for c, a in zip(found, at, strict=True)]})

    texts = labelled_texts(docs, labels, sample_per_label)
    rows = texts.mapInPandas(run, "doc_id long, quality int, at array<int>, n array<float>").toPandas().sort_values("doc_id", kind="stable")
    features = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        features[i, at] = n
    return fit(features, rows["quality"].to_numpy(np.float64))


def scorer(spark, model: Model):
    """A column function: whole text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(list(text)))

    return lambda text: score(text.cast("string"))


def predicted(score: Column, keep_from: float = KEEP_FROM) -> Column:
    return F.when(score >= keep_from, 1).otherwise(0)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null, empty and featureless texts score the labelled sample's mean. Without any label
    every score is 0.5. Repeated rows score alike; extra columns are ignored; an empty table
    gives no rows. A text is read whole however long, by one task.
    """
    model = learn(docs, labels)
    score = scorer(docs.sparkSession, model)
    out = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", predicted(F.col("score")))
