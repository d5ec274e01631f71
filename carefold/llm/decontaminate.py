"""Benchmark decontamination: BM25 retrieval of test items for every passage, then a check of question and answer.

The test items are indexed in units of at most ``UNIT_WORDS`` words with BM25 impacts as shares of the unit's own score, so
that 1.0 means that every word of the unit occurs. Every passage of every text (``PASSAGE_WORDS`` words, a new one each
``STRIDE_WORDS``, so a whole unit always lies in one passage) is a query. A passage can only reach the threshold at a unit
whose rarest words it shares; this bound is taken for all passages of a slice at once, and the passages that pass it go
through block-max WAND over the whole index, which returns every unit at or above ``THRESHOLD``.

A hit is verified against the item itself: of the question (all but the last words) and of the answer (the last quarter of
the item, 8 words at least) at least ``OVERLAP`` of the word 5-grams must stand in the text around the passage.

Items are indexed in passes of ``ITEMS_PER_PASS`` items; the index of a pass is broadcast (bounded by that number of items
and ``WORDS_PER_PASS`` words; an item longer than that has a pass of its own). Null or
empty texts and items give no hit, repeated rows give the same hit each, a null item id is reported as null, equal items
are each reported, an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm import common
from carefold.llm.words import ALNUM, Words, mix64

UNIT_WORDS, PASSAGE_WORDS, STRIDE_WORDS = 48, 96, 48
THRESHOLD, REST, OVERLAP, GRAM = 0.5, 0.3, 0.6, 5
K1, B = 1.2, 0.75
ITEMS_PER_PASS, WORDS_PER_PASS, BLOCK = 20_000, 2_000_000, 32
_FILTER_BITS = 20
_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, begin_word int, end_word int"


def grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all runs of ``size`` words, or of the one shorter run there is."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        total = mix64(total + hashes[k : k + len(total)] + np.uint64(k + 1))
    return np.unique(total)


def parts_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer of an item: the answer is its last quarter, 8 words at least, at most half of it."""
    n = len(hashes)
    answer = min(max(8, n // 4), max(1, n // 2))
    return hashes[: n - answer], hashes[n - answer :]


@dataclass
class Index:
    """Impact-ordered facts about the units: postings by term with block maxima, and the words of each item."""

    item_ids: list[int | None]
    words: list[np.ndarray]
    unit_item: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        units, owner = [], []
        for at, hashes in enumerate(self.words):
            cuts = -(-len(hashes) // UNIT_WORDS)
            for piece in np.array_split(hashes, cuts) if cuts else []:
                units.append(piece)
                owner.append(at)
        self.unit_item = np.array(owner, np.int64)
        lengths = np.array([len(u) for u in units], np.float64)
        average = lengths.mean() if len(units) else 1.0
        unit, term, tf = [], [], []
        for k, piece in enumerate(units):
            found, times = np.unique(piece, return_counts=True)
            unit.append(np.full(len(found), k))
            term.append(found)
            tf.append(times)
        unit = np.concatenate(unit) if unit else np.zeros(0, np.int64)
        self.terms, code = np.unique(np.concatenate(term) if term else np.zeros(0, np.uint64), return_inverse=True)
        tf = np.concatenate(tf).astype(np.float64) if tf else np.zeros(0)
        df = np.bincount(code, minlength=len(self.terms))
        idf = np.log1p((len(units) - df + 0.5) / (df + 0.5))
        impact = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit] / average)) if len(unit) else np.zeros(0)
        own = np.bincount(unit, impact, len(units))
        impact = impact / own[unit] if len(unit) else impact
        order = np.lexsort((unit, code))
        self.unit, self.impact, code = unit[order], impact[order], code[order]
        self.first = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.most = np.array([self.impact[a:b].max() for a, b in zip(self.first[:-1], self.first[1:], strict=True)])
        self._essential(code)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.terms[self.rare_term] >> np.uint64(64 - _FILTER_BITS)] = True
        self.lists = None

    def _essential(self, code: np.ndarray) -> None:
        """Postings that a unit cannot do without: what is left of its impacts sums to at most ``REST``."""
        order = np.lexsort((self.impact, self.unit))
        unit, impact = self.unit[order], self.impact[order]
        running = np.cumsum(impact)
        begin = np.searchsorted(unit, np.arange(len(self.unit_item)))
        inside = running - np.where(begin > 0, running[begin - 1], 0)[unit] if len(unit) else running
        needed = np.zeros(len(order), bool)
        needed[order] = inside > REST
        at = np.flatnonzero(needed)
        self.rare_term, begin = np.unique(code[at], return_index=True)
        self.rare_first = np.append(begin, len(at))
        self.rare_unit, self.rare_impact = self.unit[at], self.impact[at]
        rest = 1 - np.bincount(self.rare_unit, self.rare_impact, len(self.unit_item))
        self.least = THRESHOLD - rest - 1e-9

    def candidates(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the passages (see ``passages``) that may reach the threshold at some unit."""
        base, _ = passages(words)
        rare = self.terms[self.rare_term]
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(rare):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(rare, hashes[at]), len(rare) - 1)
        same = rare[place] == hashes[at]
        at, place = at[same], place[same]
        doc = words.doc[at]
        inside = (at - words.first[doc]) // STRIDE_WORDS
        window = np.concatenate([base[doc] + inside, (base[doc] + inside - 1)[inside > 0]])
        pair = np.unique(window * len(rare) + np.concatenate([place, place[inside > 0]]))
        window, place = pair // len(rare), pair % len(rare)
        count = self.rare_first[place + 1] - self.rare_first[place]
        ends = np.cumsum(count)
        if not len(ends):
            return np.zeros(0, np.int64)
        posting = np.arange(ends[-1]) + np.repeat(self.rare_first[place] - (ends - count), count)
        key = np.repeat(window, count) * len(self.unit_item) + self.rare_unit[posting]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(self.rare_impact[posting][order], begin)
        return np.unique(key[begin][total >= self.least[key[begin] % len(self.unit_item)]] // len(self.unit_item))

    def _lists(self) -> None:
        """Postings as Python lists with the last unit and the largest impact of every block."""
        self.lists = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            unit, impact = self.unit[a:b].tolist(), self.impact[a:b].tolist()
            last = [unit[min(k + BLOCK, b - a) - 1] for k in range(0, b - a, BLOCK)]
            most = [max(impact[k : k + BLOCK]) for k in range(0, b - a, BLOCK)]
            self.lists.append((unit, impact, last, most))

    def wand(self, hashes: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All units that the words reach the threshold at, with their scores: block-max WAND."""
        if self.lists is None:
            self._lists()
        found = np.unique(hashes)
        place = np.minimum(np.searchsorted(self.terms, found), max(len(self.terms) - 1, 0))
        codes = place[self.terms[place] == found] if len(self.terms) else place[:0]
        threshold -= 1e-9
        cursors = [[self.lists[c][0][0], 0, self.lists[c], float(self.most[c])] for c in codes.tolist()]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, at = 0.0, -1
            for at, cursor in enumerate(cursors):
                bound += cursor[3]
                if bound >= threshold:
                    break
            else:
                break
            pivot = cursors[at][0]
            while at + 1 < len(cursors) and cursors[at + 1][0] == pivot:
                at += 1
            block_bound, skip = 0.0, cursors[at + 1][0] if at + 1 < len(cursors) else None
            for cursor in cursors[: at + 1]:
                block = bisect_left(cursor[2][2], pivot)
                if block < len(cursor[2][2]):
                    block_bound += cursor[2][3][block]
                    end = cursor[2][2][block] + 1
                    skip = end if skip is None else min(skip, end)
            if block_bound >= threshold:
                if cursors[0][0] == pivot:
                    score = sum(c[2][1][c[1]] for c in cursors[: at + 1])
                    if score >= threshold:
                        out.append((pivot, min(1.0, score)))
                    target = pivot + 1
                else:
                    target = pivot
            else:
                target = pivot + 1 if skip is None else max(skip, pivot + 1)
            kept = []
            for k, cursor in enumerate(cursors):
                if k <= at and cursor[0] < target:
                    cursor[1] = bisect_left(cursor[2][0], target, cursor[1])
                    if cursor[1] == len(cursor[2][0]):
                        continue
                    cursor[0] = cursor[2][0][cursor[1]]
                kept.append(cursor)
            cursors = kept
        return out

    def hits(self, texts: pa.Array) -> list[tuple]:
        """(row, item, score, question overlap, answer overlap, begin, end) of verified hits, one per row and item."""
        words = Words(texts, ALNUM, lower=True)
        hashes = words.hashes()
        best: dict[tuple[int, int], tuple] = {}
        base, owner = passages(words)
        for window in self.candidates(words, hashes).tolist():
            row = int(owner[window])
            first, last = int(words.first[row]), int(words.first[row + 1])
            begin = first + (window - int(base[row])) * STRIDE_WORDS
            end = min(begin + PASSAGE_WORDS, last)
            for unit, score in self.wand(hashes[begin:end]):
                item = int(self.unit_item[unit])
                if (row, item) in best and best[row, item][0] >= score:
                    continue
                length = len(self.words[item])
                around = grams(hashes[max(first, begin - length) : min(last, end + length)])
                shares = []
                for part in parts_of(self.words[item]):
                    own = grams(part)
                    if len(part) < GRAM:  # too short for whole n-grams: look for the run itself
                        near = grams(hashes[max(first, begin - length) : min(last, end + length)], len(part)) if len(part) else own
                        shares.append(float(np.isin(own, near).mean()) if len(own) else 1.0)
                    else:
                        shares.append(float(np.isin(own, around).mean()))
                if min(shares) >= OVERLAP:
                    best[row, item] = (score, *shares, begin - first, end - first)
        return [(row, item, *facts) for (row, item), facts in sorted(best.items())]


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's first passage, and the row of each passage."""
    count = -(-words.counts // STRIDE_WORDS)
    return np.cumsum(count) - count, np.repeat(np.arange(words.rows), count)


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over all items, so many items and words in each; the driver holds one at a time."""
    ids, kept, held = [], [], 0
    for row in common.plain(benchmark, "item_id", "text").orderBy("item_id", "text").toLocalIterator():
        found = Words(pa.array([row.text or ""], pa.string()), ALNUM, lower=True).hashes()
        if ids and (len(ids) == ITEMS_PER_PASS or held + len(found) > WORDS_PER_PASS):
            yield Index(ids, kept)
            ids, kept, held = [], [], 0
        ids.append(row.item_id)
        kept.append(found)
        held += len(found)
    if ids:
        yield Index(ids, kept)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that it holds: score, overlaps, and the passage in words of the text."""
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                found = sent.value.hits(common.text_column(batch))
                if not found:
                    continue
                row, item, *facts = zip(*found, strict=True)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([sent.value.item_ids[i] for i in item], pa.int64())]
                kinds = [pa.float64()] * 3 + [pa.int32()] * 2
                columns += [pa.array(f, k) for f, k in zip(facts, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "begin_word", "end_word"])

        part = common.map_arrow(common.plain(docs, "doc_id", "text"), run, _SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that hold no test item: a filter where the row lies, pass by pass over the index."""
    spark = docs.sparkSession
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)
        name = docs.columns[docs.columns.index("text")]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in sent.value.hits(common.text_column(batch, name))]] = False
                yield batch.filter(pa.array(keep))

        docs = common.map_arrow(docs, run, docs.schema)
    return docs
