"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods, a set chosen by penalised likelihood.

Every language learned has a distribution over hashed byte trigrams of lower-case letters. A document's set begins with the
language that explains the whole text best alone. Then languages are taken in one by one: of all that are learned and not in
the set yet, the one that gains most at a small share; the proportions of the set are estimated anew by
expectation-maximisation. This ends when the log-likelihood does not rise by more than ``PENALTY`` times the log of the number
of trigrams. The prediction is the language with the largest proportion of the chosen set, the score that proportion.

Fitted on at most ``PER_LANGUAGE`` documents of each language of the learning folds, all languages that there are. Null texts and texts without a letter
are ``und`` with score 0; with nothing learned every text is. Ties go to the language first by name. Repeated rows are
predicted alike, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carefold.llm import common, features

PER_LANGUAGE, BINS = 400, 4096
STEPS, PENALTY = 12, 2.0
#: Languages whose sample is taken, and languages whose gains are worked out, at once.
FIT_BLOCK, GAIN_BLOCK = 128, 64
UNKNOWN = "und"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams of letters, words set apart by one space, and whether a text has a letter."""
    lower = pc.utf8_lower(texts)
    spaced = pc.replace_substring_regex(lower, r"[^\pL]+", " ")
    # a text too short for a trigram is a word with a space on both sides
    short = pc.less(pc.binary_length(spaced), 3)
    spaced = pc.if_else(short, pc.binary_join_element_wise(pa.scalar(" "), spaced, pa.scalar(" "), ""), spaced)
    lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
    return features.counts(spaced, BINS, 0), lettered


@dataclass
class Model:
    names: list[str]
    logs: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> "Model":
        names = sorted(counts)
        totals = np.stack([counts[n] for n in names]) + 0.5
        return cls(names, np.log(totals / totals.sum(axis=1, keepdims=True)).astype(np.float32))

    def mixture(self, row: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The chosen languages of one text's counts and their proportions."""
        used = np.flatnonzero(row)
        n, logs = row[used].astype(np.float64), self.logs[:, used].astype(np.float64)
        alone = logs @ n
        order = np.argsort(-alone, kind="stable")
        chosen, best, shares = [int(order[0])], float(alone[order[0]]), np.ones(1)
        floor = logs.max(axis=0)
        chance = np.exp(logs - floor)
        base = float(floor @ n)
        price = PENALTY * np.log(max(n.sum(), 2.0))
        rest = order[1:]
        while len(rest):
            # the language that gains most at a small share is tried next
            mixed = 0.9 * (shares @ chance[chosen])
            gains = np.concatenate([np.log(mixed + 0.1 * chance[rest[k : k + GAIN_BLOCK]]) @ n for k in range(0, len(rest), GAIN_BLOCK)])
            pick = int(rest[np.argmax(gains)])
            trial = [*chosen, pick]
            p = np.append(shares * 0.9, 0.1)
            for _ in range(STEPS):
                parts = p[:, None] * chance[trial]
                p = (parts / parts.sum(axis=0)) @ n / n.sum()
            value = float((np.log(p @ chance[trial]) * n).sum()) + base
            if value - best <= price:
                break
            chosen, shares, best = trial, p, value
            rest = rest[rest != pick]
        return chosen, shares

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
        names, scores, sets = [], np.zeros(len(texts)), []
        if not self.names:
            return [UNKNOWN] * len(texts), scores, [{} for _ in range(len(texts))]
        counts, lettered = trigrams(texts)
        for row in range(len(texts)):
            if not lettered[row]:
                names.append(UNKNOWN)
                sets.append({})
                continue
            chosen, shares = self.mixture(counts[row])
            top = min(range(len(chosen)), key=lambda i: (-shares[i], self.names[chosen[i]]))
            names.append(self.names[chosen[top]])
            scores[row] = min(1.0, float(shares[top]))
            sets.append({self.names[k]: float(s) for k, s in zip(chosen, shares, strict=True)})
        return names, scores, sets


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> Model:
    """Sums the trigrams of a bounded sample per language in Spark; the driver gets one row of ``BINS`` sums a language."""
    learn = docs.select("doc_id", "lang").filter((common.fold(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = sorted((r.lang, r["count"]) for r in learn.groupBy("lang").count().collect())
    if not known:
        return Model([], np.zeros((0, BINS), np.float32))
    totals: dict[str, np.ndarray] = {}
    for begin in range(0, len(known), FIT_BLOCK):
        totals |= _sums(docs, learn, dict(known[begin : begin + FIT_BLOCK]), per_language)
    return Model.fit(totals)


def _sums(docs: DataFrame, learn: DataFrame, known: dict[str, int], per_language: int) -> dict[str, np.ndarray]:
    """The summed trigrams of the samples of the languages in ``known``, given with their numbers of rows."""
    # each language is cut to its lowest hashes first, so that one with most rows gives few to its window
    key = F.xxhash64(F.col("doc_id"), F.lit(3))
    low = None
    for name, count in known.items():
        part = (F.col("lang") == name) & features.low_hash(key, per_language, count)
        low = part if low is None else low | part
    keys = (
        learn.filter(low).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id")))
        .filter(F.col("place") <= per_language).select("doc_id", F.col("lang").alias("learned"))
    )
    sample = common.plain(docs, "doc_id", "text").join(F.broadcast(keys), "doc_id").select("text", "learned")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            counts, _ = trigrams(common.text_column(batch))
            # every document weighs the same, so that a few very long ones do not make the language
            shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * 1000
            for name, row in zip(batch.column(1).to_pylist(), shares, strict=True):
                sums[name] = sums.get(name, 0) + row.astype(np.float64)
        yield pa.RecordBatch.from_pydict({"learned": pa.array(list(sums), pa.string()), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})

    totals: dict[str, np.ndarray] = {}
    summed = (
        common.map_arrow(sample, add, "learned string, sums array<double>")
        .select("learned", F.posexplode("sums").alias("bin", "n")).groupBy("learned", "bin").agg(F.sum("n").alias("n"))
    )
    for r in summed.toLocalIterator():
        totals.setdefault(r.learned, np.zeros(BINS))[r.bin] = round(r.n, 6)
    return totals


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the chosen set with proportions, of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            names, scores, sets = sent.value.predict(common.text_column(batch))
            mixed = pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), mixed], ["doc_id", "lang_pred", "score", "mixture"])

    return common.map_arrow(common.plain(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))
