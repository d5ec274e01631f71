"""Hashed n-gram counts of whole texts, and the labelled sample that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.llm import common
from carefold.llm.words import ALNUM, Words

CHAR_BINS, WORD_BINS = 2048, 2048


def counts(texts: pa.Array, char_bins: int = CHAR_BINS, word_bins: int = WORD_BINS) -> np.ndarray:
    """Per text, counts of hashed byte trigrams (case and symbols kept), then of hashed lower-case words."""
    words = Words(texts, ALNUM, lower=False)
    rows = words.rows
    data = words.bytes.astype(np.uint32)
    grams = (data[:-2] * np.uint32(2654435761) + data[1:-1] * np.uint32(2246822519) + data[2:] * np.uint32(3266489917)) if len(data) > 2 else np.zeros(0, np.uint32)
    grams ^= grams >> np.uint32(15)
    place = np.repeat(np.arange(rows, dtype=np.int64) * char_bins, np.diff(words.offsets))[: len(grams)]
    place += (grams * np.uint32(2246822519) >> np.uint32(8)) % np.uint32(char_bins)
    # a trigram that reaches into the next text belongs to none
    ends = np.concatenate([words.offsets[1:] - 1, words.offsets[1:] - 2])
    place[ends[(ends >= 0) & (ends < len(place))]] = rows * char_bins
    chars = np.bincount(place, minlength=rows * char_bins + 1)[:-1].reshape(rows, char_bins)
    if not word_bins:
        return chars.astype(np.float32)
    lower = Words(texts, ALNUM, lower=True)
    place = lower.doc * word_bins + (lower.hashes() % np.uint64(word_bins)).astype(np.int64)
    return np.hstack([chars, np.bincount(place, minlength=rows * word_bins).reshape(rows, word_bins)]).astype(np.float32)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm > 0, norm, 1)


def low_hash(key: Column, size: int, total: int) -> Column:
    """Whether a 64-bit hash lies so low that about four times ``size`` of ``total`` rows pass.

    The rows of the ``size`` smallest hashes are among them, so a top-k by the hash stays the same while each task gives
    only a few rows to it.
    """
    return key <= min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 4 * size / max(total, 1))))


def sample_keys(table: DataFrame, size: int, salt: int) -> DataFrame:
    """At most ``size`` doc_ids, the first by a hash: the same at every run, spread over the whole table."""
    key = F.xxhash64(F.col("doc_id"), F.lit(salt))
    known = table.filter("doc_id IS NOT NULL")
    return known.filter(low_hash(key, size, known.count())).orderBy(key, "doc_id").limit(size)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_class: tuple[int, int]) -> DataFrame:
    """text and ``label`` of at most ``per_class`` labelled documents of label 0 and of label 1, of the rows to learn from.

    The keys are at most so many rows, so they are broadcast to the documents.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(learn)
    keys = None
    for value in (0, 1):
        part = sample_keys(known.filter(F.col("label") == value), per_class[value], value)
        keys = part if keys is None else keys.unionAll(part)
    return common.plain(docs, "doc_id", "text").join(F.broadcast(keys), "doc_id").select("doc_id", "text", "label")


def count_rows(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts and labels of a bounded sample, gathered on the driver in the order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            made = counts(common.text_column(batch)).clip(max=65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in made], pa.binary())], ["doc_id", "label", "counts"])

    rows = sorted((r.doc_id, r.label, bytes(r.counts)) for r in common.map_arrow(sample, run, "doc_id long, label int, counts binary").toLocalIterator())
    matrix = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), CHAR_BINS + WORD_BINS)
    return matrix, np.array([r[1] for r in rows], np.int64)
