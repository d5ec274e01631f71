"""Quality by nearest neighbours: labelled latent-semantic vectors vote, weighted by their cosine to the document.

Fitted on at most ``PER_CLASS`` labelled documents of either class: log counts of hashed byte trigrams and words, brought
to length 1, centred, cut to ``RANK`` dimensions by a singular value decomposition. Every whole text of the
table is projected and multiplied with all labelled vectors in blocks; the nearest ``NEIGHBOURS`` vote.

Null and empty texts hold nothing but their distance from the mean and are voted on like others; a text whose cosines are
all zero or less gets the share of good labels. Without labelled rows every score is 0.5. Rows repeat as they come, ties between
neighbours are broken by the order of doc_id, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common, features

#: Labelled documents of label 0 and of label 1.
PER_CLASS = (1000, 2000)
RANK, NEIGHBOURS, POWER = 32, 15, 4


@dataclass
class Model:
    mean: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> "Model":
        x = features.unit(np.log1p(counts.astype(np.float32)))
        mean = x.mean(axis=0)
        x = features.unit(x - mean)
        values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
        best = np.argsort(-values, kind="stable")[: min(rank, len(x))]
        best = best[values[best] > 1e-8]
        projection = (x.T @ (left[:, best] / np.sqrt(values[best]))).astype(np.float32)
        return cls(mean, projection, features.unit(x @ projection), labels)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        rest = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), rest)
        if not len(self.labels):
            return out
        own = features.unit((features.unit(np.log1p(counts)) - self.mean) @ self.projection)
        take = min(neighbours, len(self.labels))
        for at in range(0, len(own), block):
            cosine = own[at : at + block] @ self.vectors.T
            near = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            voted = total > 0
            out[at : at + block][voted] = ((weight * self.labels[near]).sum(axis=1)[voted] / total[voted]).clip(0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """Learns from labelled rows outside the held-out fold: crc32(doc_id) mod ``modulus`` is not ``held``."""
    learn = common.fold(F.col("doc_id"), modulus) != held
    counts, values = features.count_rows(features.labelled_sample(docs, labels, "quality", learn, per_class))
    if not len(values):
        empty = np.zeros((0, 1), np.float32)
        return Model(empty, empty, empty, values)
    return Model.fit(counts, values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; the model (a few MB, fixed by its parameters) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores = sent.value.score(features.counts(common.text_column(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return common.map_arrow(common.plain(docs, "doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
