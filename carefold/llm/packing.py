"""Packs whole documents into sequences of a fixed number of tokens, with minimum bin slack over the lengths that remain.

A document's ids (with its end id) are cut into full sequences; what remains is shorter than a sequence. The plan for the
remainders needs only how many there are of each length, so it is made from at most ``CAPACITY`` - 1 numbers, whatever the
size of the corpus: the longest length left seeds a window, and a bitset of reachable sums (one bit per sum, one shift per
length and power of two of its count) tells how close to the capacity the window can be filled; going back through the
bitsets gives how many remainders of each length do so. Such a filling is repeated as often as its lengths last. Where no
filling is exact, the longest remainder left is cut to close the gap and its rest becomes a remainder of its own, so every
sequence is full; the tokens left at the very end are cut into sequences of powers of two, which are not padded.

The plan is a table of rank intervals: the remainders of one length with ranks a to b go to such sequences. Ranks come from
counts by (length, bucket of rows), so a length that a third of all documents has is dealt over many tasks. Ids are stored
once, pieces find them by row number in one join, and are cut out of them inside the JVM.

Null texts count as empty, an empty text is its end id alone; null and equal doc_ids and repeated rows are each a document
of their own; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from carefold.llm import common
from carefold.llm.bpe import PieceCache

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CAPACITY = 4096
#: Rows of a bucket at most, on average, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 18, 1024
#: Matches whose ids a worker remembers in each of two generations.
CACHED_MATCHES = 150_000
#: Whether a piece holds only characters whose normal form, lower case and kind are the same everywhere.
PLAIN = regex.compile(r"[!-~\u00c0-\u024f]*").fullmatch

#: The kind of tasks that keep an encoder.
KEEPS = "word-bpe"


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space and never joins words over it.

    Texts are cut at spaces, tabs and line ends by Arrow, and a piece is worked on when it is not remembered. A piece of
    printable ASCII and Latin letters is lower-cased and split here, as its normal form is itself, and only its new matches go
    through the library's merges; any other piece goes through the whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        #: The same merges for strings that are one match already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces = PieceCache()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        return common.kept(KEEPS, path, lambda: cls(path))

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row and their counts."""
        split = [self.find(p.lower()) if PLAIN(p) else None for p in pieces]
        known, new = {}, []
        for match in set(chain.from_iterable(m for m in split if m is not None)):
            ids = self.young.get(match)
            if ids is None and (ids := self.old.get(match)) is None:
                new.append(match)
            else:
                known[match] = ids
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            for match, made in zip(part, self.merges.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[match] = array("I", made.ids).tobytes()
        self.young.update(known)
        if len(self.young) > CACHED_MATCHES:
            self.old, self.young = self.young, {}
        out = [
            array("I", self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() if found is None else b"".join([known[m] for m in found])
            for p, found in zip(pieces, split, strict=True)
        ]
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for mark in "\n\t\r":
            texts = pc.replace_substring(texts, mark, " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        index, names, cache = coded.indices.to_numpy(), coded.dictionary, self.pieces
        keys = cache.keys(names)
        missing = cache.missing(keys)
        new_ids, new_counts = self._new(names.take(pa.array(missing)).to_pylist())
        slot = keys[0] & cache.mask
        # the ids of new pieces lie behind those remembered
        begins, sizes = cache.begin[slot].astype(np.int64), cache.count[slot].astype(np.int64)
        begins[missing] = cache.used + np.cumsum(new_counts) - new_counts
        sizes[missing] = new_counts
        pool = np.concatenate([cache.ids[: cache.used], new_ids])
        cache.put(tuple(k[missing] for k in keys), new_ids, new_counts)
        counts = sizes[index]
        ends = np.cumsum(counts)
        places = np.repeat(begins[index] - (ends - counts), counts)
        places += np.arange(len(places))
        first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
        return pool[places], np.add.reduceat(counts, first)


def tokens(df: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """row (a number no other row has), doc_id, n_tokens and ids (packed unsigned 32-bit integers), the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in common.slices(batches):
            ids, counts = encoder.encode(common.text_column(batch))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
            ends = 4 * np.cumsum(counts + 1)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts + 1), packed], ["row", "doc_id", "n_tokens", "ids"])

    numbered = common.plain(df, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_arrow(numbered, run, "row long, doc_id long, n_tokens long, ids binary", KEEPS)


class Step(NamedTuple):
    """Remainders of ``length`` with ranks from ``rank`` on, ``each`` per sequence, in ``times`` sequences from ``sequence`` on.

    They lie one after the other from ``offset`` on and give ``take`` tokens each; a shorter ``take`` leaves a rest, the
    first of which has rank ``rest`` among the remainders of its length.
    """

    length: int
    rank: int
    each: int
    times: int
    sequence: int
    offset: int
    take: int
    rest: int


def fill(room: int, counts: dict[int, int], order: list[int]) -> list[tuple[int, int]]:
    """How many remainders of which lengths come closest to ``room`` without passing it.

    Bit s of the bitset is set if some choice sums to s. ``order`` lists the lengths; each is added in powers of two of its
    count, and the walk back takes as few of the later ones as reach the sum.
    """
    full = (1 << (room + 1)) - 1
    reach, history = 1, []
    for length in order:
        if length > room or not counts[length]:
            continue
        history.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << (step * length)
            left -= step
            step *= 2
        reach &= full
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(history):
        taken = 0
        while not before >> at & 1:
            at -= length
            taken += 1
        if taken:
            chosen.append((length, taken))
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """The steps for so many remainders of each length below ``capacity``, and the number of sequences they fill."""
    left = {length: count for length, count in histogram.items() if count}
    size, used = dict(left), dict.fromkeys(left, 0)
    steps: list[Step] = []
    sequence = 0

    def longest_first() -> list[int]:
        return sorted((length for length, count in left.items() if count), reverse=True)

    def take(length: int, each: int, times: int, offset: int, tokens: int) -> None:
        rest = -1
        if tokens < length:
            short = length - tokens
            if short not in size:
                size[short] = used[short] = left[short] = 0
            rest = size[short]
            size[short] += times
            left[short] += times
        steps.append(Step(length, used[length], each, times, sequence, offset, tokens, rest))
        used[length] += each * times
        left[length] -= each * times

    total = sum(length * count for length, count in left.items())
    while total >= capacity:
        order = longest_first()
        seed = order[0]
        left[seed] -= 1
        chosen = dict(fill(capacity - seed, left, order))
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        gap = capacity - sum(length * each for length, each in chosen.items())
        cut = None
        need = dict(chosen)
        if gap:
            # any remainder that is left is longer than the gap, or it would have filled more of it
            cut = next(length for length in order if left[length] > chosen.get(length, 0))
            need[cut] = need.get(cut, 0) + 1
        times = min(left[length] // each for length, each in need.items())
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            take(length, each, times, offset, length)
            offset += length * each
        if cut is not None:
            take(cut, 1, times, offset, gap)
        sequence += times
        total -= capacity * times
    while total:
        # the last tokens, fewer than a sequence: one sequence per power of two in their number
        room, offset = 1 << (total.bit_length() - 1), 0
        total -= room
        while room:
            order = longest_first()
            length = next((x for x in order if x <= room), order[-1])
            take(length, 1, 1, offset, min(length, room))
            offset += min(length, room)
            room -= min(length, room)
        sequence += 1
    return steps, sequence


class Places:
    """The steps as arrays, searched by length and rank."""

    def __init__(self, steps: list[Step]):
        table = np.array(sorted(steps), np.int64).reshape(-1, len(Step._fields))
        self.length, self.rank, self.each, _, self.sequence, self.offset, self.take, self.rest = table.T
        self.first = np.searchsorted(self.length, np.arange(CAPACITY + 1))
        self.after = np.searchsorted(self.length, np.arange(CAPACITY + 1), "right")

    def of(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rounds of (number of the remainder, start within it, tokens, sequence, offset), until no rest is left."""
        which, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        while len(which):
            # the last step of this length that begins at or before the rank, by bisection of all rows at once
            low, high = self.first[length], self.after[length] - 1
            while (open_ := low < high).any():
                middle = (low + high + 1) >> 1
                upper = self.rank[middle] <= rank
                low = np.where(open_ & upper, middle, low)
                high = np.where(open_ & ~upper, middle - 1, high)
            turn, slot = np.divmod(rank - self.rank[low], self.each[low])
            take = self.take[low]
            yield which, start, take, self.sequence[low] + turn, self.offset[low] + slot * take
            go = np.flatnonzero(take < length)
            rank = self.rest[low[go]] + turn[go]
            which, start, length = which[go], start[go] + take[go], length[go] - take[go]


def ranked(stored: DataFrame, capacity: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Counts by (length, bucket), and rows with their remainder's ``rank`` and the number of full sequences before theirs.

    Full sequences count as length ``capacity``. Rows are dealt by bucket, a hash of the row number, never by length.
    """
    narrow = stored.select(
        "row", F.col("n_tokens").alias("doc_tokens"), F.expr(f"n_tokens div {capacity}").alias("full"), (F.col("n_tokens") % capacity).alias("length"),
        F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"),
    )
    counts = narrow.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("count")).unionAll(
        narrow.groupBy("bucket").agg(F.sum("full").alias("count")).select("bucket", F.lit(capacity).cast("long").alias("length"), "count")
    ).filter("length > 0 AND count > 0")
    own = Window.partitionBy("bucket", "length").orderBy("row")
    before = Window.partitionBy("bucket").orderBy("length", "row").rowsBetween(Window.unboundedPreceding, -1)
    return counts, narrow.repartition("bucket").withColumn("rank", F.row_number().over(own) - 1).withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0)))


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed), doc_tokens, sequence_id and offset.

    :func:`sequences` puts the pieces of a sequence together.
    """
    stored = common.store(tokens(df, tokenizer, end_id), "packing-ids", "zstd")
    buckets = max(LEAST_BUCKETS, -(-stored.count() // BUCKET_ROWS))
    counts, rows = ranked(stored, capacity, buckets)
    counts = common.store(counts, "packing-counts")
    totals = {r.length: r.count_ for r in counts.groupBy("length").agg(F.sum("count").alias("count_")).collect()}
    n_full = totals.pop(capacity, 0)
    steps, _ = plan(totals, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    full_bases = bases.filter(F.col("length") == capacity).select("bucket", F.col("base").alias("full_base"))
    placed = (
        rows.join(bases, ["bucket", "length"], "left").join(full_bases, "bucket", "left")
        .select(
            "row", "doc_tokens", "length", (F.col("rank") + F.coalesce("base", F.lit(0))).alias("rank"),
            (F.col("full_before") + F.coalesce("full_base", F.lit(0))).alias("full_before"),
        )
    )
    pieces = common.map_arrow(placed, _placer(steps, capacity, n_full), "row long, doc_tokens long, start long, length long, sequence_id long, offset long", KEEPS)
    found = pieces.join(stored.select("row", "doc_id", "ids"), "row")
    return found.select(
        "doc_id", "start", "length",
        F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"),
        "doc_tokens", "sequence_id", "offset",
    )


def _placer(steps: list[Step], capacity: int, n_full: int):
    """Full sequences have the first ``n_full`` numbers; those of remainders follow."""
    names = ["row", "doc_tokens", "start", "length", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(steps)

        def out(row, tokens, start, length, sequence, offset) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (row, tokens, start, length, sequence, offset)], names)

        for batch in batches:
            row, tokens, length, rank, before = (c.to_numpy() for c in batch.columns)
            full = tokens // capacity
            which = np.repeat(np.arange(len(row)), full)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
            yield out(row[which], tokens[which], turn * capacity, np.full(len(which), capacity), before[which] + turn, np.zeros(len(which)))
            some = np.flatnonzero(length)
            for which, start, take, sequence, offset in places.of(length[some], rank[some]):
                at = some[which]
                yield out(row[at], tokens[at], full[at] * capacity + start, take, n_full + sequence, offset)

    return run


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence: its pieces, at most a capacity of tokens, in the order of offsets."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def digests(df: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pack(df).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
