"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents, and text whose labels are not looked at, at most ``POSITIVE`` and ``UNLABELLED`` of them, train
a linear classifier over the presence of words and word beginnings. Both come from the documents of ``labels`` in the
learning folds, so that the two samples differ in toxicity alone and not in how documents came to be labelled. The risk
is corrected by the class prior (the share of toxic documents among the labels to learn from): prior * risk of the
positives + what the unlabelled risk holds beyond the positives' share, which may not fall below zero.

Null and empty texts hold no feature and get the bias alone. Without positive or without unlabelled rows every score is
the prior. Repeated rows are scored alike, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common, features
from carefold.llm.words import ALPHA, Words

POSITIVE, UNLABELLED, FEATURES = 3000, 6000, 768
#: Byte lengths of the word beginnings; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
#: A feature must stand in so many sampled documents, and its shares differ by so many standard errors.
LEAST, LEAST_Z = 4, 3.5
_FILTER_BITS = 20


def feature_hashes(words: Words) -> Iterator[np.ndarray]:
    for prefix in PREFIXES:
        yield words.hashes(prefix)


def present(texts: pa.Array) -> list[np.ndarray]:
    """The distinct feature hashes of each text, as signed 64-bit integers."""
    words = Words(texts, ALPHA, lower=True)
    found = np.stack(list(feature_hashes(words)), axis=1).view(np.int64)
    return [np.unique(found[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts, ALPHA, lower=True)
        logit = np.full(words.rows, self.bias)
        if len(self.keys):
            hits = []
            for hashes in feature_hashes(words):
                at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
                place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
                same = self.keys[place] == hashes[at]
                hits.append(words.doc[at[same]] * len(self.keys) + place[same])
            pairs = np.unique(np.concatenate(hits))
            logit += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], words.rows)
        return 1 / (1 + np.exp(-logit.clip(-50, 50)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Adam over the non-negative risk with the logistic loss; returns weights and bias."""
    x_p, x_u = positive.astype(np.float32), unlabelled.astype(np.float32)
    w = np.zeros(x_p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    expit = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        p, u = expit(x_p @ w[:-1] + w[-1]), expit(x_u @ w[:-1] + w[-1])
        # d loss(+1)/dz = p - 1; d loss(-1)/dz = p
        negative = -np.log1p(-u.clip(max=1 - 1e-12)).mean() + prior * np.log1p(-p.clip(max=1 - 1e-12)).mean()
        d_p, d_u = prior * (p - 1) / len(p), np.zeros_like(u)
        if negative >= 0:
            d_p, d_u = d_p - prior * p / len(p), u / len(u)
        else:  # the corrected negative risk is below zero: undo it instead of following it
            d_p, d_u = prior * p / len(p), -u / len(u)
        grad = np.append(x_p.T @ d_p.astype(np.float32) + x_u.T @ d_u.astype(np.float32), d_p.sum() + d_u.sum())
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> Model:
    """Learns from rows outside the held-out fold only: crc32(doc_id) mod ``modulus`` is not ``held``."""
    spark = docs.sparkSession
    learn = common.fold(F.col("doc_id"), modulus) != held
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(learn & F.col("toxic").isin(0, 1))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    prior = min(max(prior, 0.001), 0.5)
    keys = features.sample_keys(known.filter("toxic = 1").select("doc_id", F.lit(1).alias("positive")), POSITIVE, 1).unionAll(
        features.sample_keys(known.select("doc_id", F.lit(0).alias("positive")), UNLABELLED, 2))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = present(common.text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "positive", "found"])

    texts = common.plain(docs, "doc_id", "text").join(F.broadcast(keys), "doc_id").select("doc_id", "text", "positive")
    sample = common.store(common.map_arrow(texts, extract, "doc_id long, positive int, found array<long>"), "toxicity-sample")
    sizes = {r.positive: r.n for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    share_p, share_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    chosen = (
        sample.select("positive", F.explode("found").alias("key")).groupBy("key")
        .agg(F.sum("positive").cast("long").alias("p"), F.sum(1 - F.col("positive")).cast("long").alias("u"))
        .filter(F.col("p") + F.col("u") >= LEAST)
        .withColumn("z", F.abs(share_p - share_u) / spread)
        .filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "key").limit(FEATURES)
    )
    hashes = np.sort(np.array([r.key for r in chosen.select("key").collect()], np.int64).view(np.uint64))
    order = spark.sparkContext.broadcast(hashes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(2):
                bits = np.isin(order.value, found.values.to_numpy(zero_copy_only=False).view(np.uint64))
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "positive", "bits"])

    rows = sorted((r.doc_id, r.positive, bytes(r.bits)) for r in common.map_arrow(sample, index, "doc_id long, positive int, bits binary").toLocalIterator())
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(hashes)]
    positive = np.array([r[1] for r in rows]) == 1
    weights, bias = train(bits[positive], bits[~positive], prior)
    return Model(hashes, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text: one pass, no shuffle, a model of fixed size broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(common.text_column(batch)))], ["doc_id", "score"])

    return common.map_arrow(common.plain(docs, "doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """All columns of the documents whose score is below ``limit``; the score is taken in the same pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            kept = sent.value.score(common.text_column(batch, batch.schema.names[place])) < limit
            yield batch.filter(pa.array(kept))

    return common.map_arrow(docs, run, docs.schema)
