"""Quality rules: fixed counts over each whole text, and the verdict of a calibrated n-gram classifier.

Words are runs of characters other than white space (0x20, 0x09-0x0D). A text fails the base rules with fewer than
``LEAST_WORDS`` words, or if more than ``REPEATED_PERCENT`` of its words lie in windows of five words that the text holds
twice or more. Of the rest those are kept whose calibrated probability of good quality is at least ``LIMIT``.

The classifier is a logistic regression over hashed word and byte n-grams, fitted on at most ``PER_CLASS`` labelled rows of
each class and calibrated (Platt) on those of them that the fit did not see, weighted back to the classes' real shares.

Null texts have no words and fail, as do empty ones; without labels of both classes the verdict is the base rules'
alone. Equal rows get equal results, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common, features
from carefold.llm.words import NOT_SPACE, Words, runs

WINDOW, LEAST_WORDS, REPEATED_PERCENT = 5, 10, 20
PER_CLASS, LIMIT = (1500, 1500), 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACES = " \t\n\v\f\r"


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the number of words in windows of five words that the text holds at least twice."""
    ids = words.exact_ids()
    hashes, first = runs(words, ids, WINDOW)
    if not len(first):
        return np.zeros(words.rows, np.int64)
    hashes = hashes ^ (words.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes, kind="stable")
    ranked, place = hashes[order], first[order]
    same = ranked[1:] == ranked[:-1]
    # equal hashes count only where the windows are equal word by word and lie in one text
    true = words.doc[place[1:]] == words.doc[place[:-1]]
    for k in range(WINDOW):
        true &= ids[place[1:] + k] == ids[place[:-1] + k]
    same &= true
    hit = np.zeros(len(place), bool)
    hit[1:] |= same
    hit[:-1] |= same
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, place[hit], 1)
    np.add.at(step, place[hit] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text, and whether it fails them."""
    words = Words(texts, NOT_SPACE)
    points = (words.bytes & 0xC0) != 0x80
    in_words = np.concatenate([[0], np.cumsum(points & NOT_SPACE[words.bytes])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[words.bytes])])
    begins, ends = words.offsets[:-1], words.offsets[1:]
    duplicates = np.zeros(words.rows, np.int64)
    for row, text in enumerate(texts.to_pylist()):
        lines = [line for line in text.split("\n") if line.strip(_SPACES)]
        duplicates[row] = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    return {
        "n_words": words.counts,
        "word_chars": in_words[ends] - in_words[begins],
        "n_symbols": symbols[ends] - symbols[begins],
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": (words.counts < LEAST_WORDS) | (100 * repeats > REPEATED_PERCENT * words.counts),
    }


@dataclass
class Model:
    mean: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        raw = (features.unit(np.log1p(counts)) - self.mean) @ self.weights
        return 1 / (1 + np.exp(-(self.scale * raw.astype(np.float64) + self.shift).clip(-50, 50)))


def train(counts: np.ndarray, labels: np.ndarray, good_share: float, steps: int = 200, decay: float = 1e-4) -> Model:
    """Fits on four of five rows and calibrates on the fifth; ``good_share`` is the real share of label 1."""
    x = features.unit(np.log1p(counts.astype(np.float32)))
    held = np.arange(len(x)) % 5 == 4
    mean = x[~held].mean(axis=0)
    weights = _logistic((x[~held] - mean), labels[~held], np.ones((~held).sum()), steps, decay)
    model = Model(mean, weights[:-1].astype(np.float32), 1.0, float(weights[-1]))
    check = labels[held]
    if len(set(check.tolist())) == 2:
        raw = ((x[held] - mean) @ model.weights)[:, None]
        share = np.where(check == 1, good_share / max((check == 1).mean(), 1e-9), (1 - good_share) / max((check == 0).mean(), 1e-9))
        # Platt's smoothed targets keep the slope finite for separable rows
        target = np.where(check == 1, ((check == 1).sum() + 1) / ((check == 1).sum() + 2), 1 / ((check == 0).sum() + 2))
        spread = float(raw.std()) or 1.0
        scaled = _logistic(raw / spread, target, share, 1000, 0.0)
        model.scale, model.shift = float(scaled[0]) / spread, float(scaled[1])
    return model


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int, decay: float) -> np.ndarray:
    """Adam over the weighted logistic loss; the last weight is the bias."""
    w = np.zeros(x.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w[:-1].astype(x.dtype) + w[-1]).clip(-50, 50)))
        d = (p - target) * weight
        grad = np.append(x.T @ d.astype(x.dtype), d.sum())
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    shares = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = shares.get(1, 0), shares.get(0, 0)
    if not good or not bad:
        return None
    counts, values = features.count_rows(features.labelled_sample(docs, labels, "quality", F.lit(True), per_class))
    return train(counts, values, good / (good + bad)) if len(set(values.tolist())) == 2 else None


def judge(docs: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """The base counts, base_failed, the probability of good quality and kept, of every whole text in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.text_column(batch)
            found = base_counts(texts)
            chance = sent.value.probability(features.counts(texts)) if sent.value is not None else np.ones(len(texts))
            columns = {"doc_id": batch.column(0)} | {k: pa.array(v) for k, v in found.items()}
            columns |= {"probability": pa.array(chance), "kept": pa.array(~found["base_failed"] & (chance >= limit))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, probability double, kept boolean")
    return common.map_arrow(common.plain(docs, "doc_id", "text"), run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
