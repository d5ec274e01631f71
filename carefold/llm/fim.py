"""Fill-in-the-middle rewriting of whole texts, with line cuts located through content-defined chunks.

A text is cut into units (lines with their line feed). Two hashes of its id choose the units after which prefix and middle
end, a third whether it is rewritten at all, a fourth the order of the parts. To find the place of a unit's end, the bytes
are cut into chunks where a rolling hash of the last 32 bytes says so. Equal passages of different texts therefore fall
into equal chunks. A worker keeps the summary of every chunk it has seen lately: code points, places of line feeds, first
and last bytes, whether a mark stands inside. The cache is keyed by the chunk's bytes, so a hit is one of equal content. Adding up the
chunks' counts gives the number of units of the text and the chunk in which the wanted line feed lies; marks that lie over
a chunk's edge are seen in the last and first bytes.

Row-local: no shuffle, one pass, memory of one slice and the cache. Null texts count as empty; an empty text, and one that
holds a mark, keeps the form ``plain``. A null doc_id has the decimal text ``''``. Repeated rows each get their own row,
an empty table gives an empty one, columns that are not asked for are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.llm import common
from carefold.llm.words import mix64

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in 100 of texts that are rewritten, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Written before the id to hash it.
SALT = "7:"

#: Bytes of a chunk at least and at most; between them about one place in 1,024 ends it.
LEAST, MOST, BITS = 256, 8192, 10
#: Bytes of chunks in each of the cache's two generations.
CACHE_BYTES = 24 << 20

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_EDGE = max(map(len, _MARKS)) - 1


class Summary(NamedTuple):
    """What has to be known of a chunk: ``ends`` are the places after its line feeds, ``end_chars`` the same in code points."""

    chars: int
    ends: list[int]
    end_chars: list[int]
    marked: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    """A code point counts where its first byte lies, so that counts of chunks add up even where one is cut in two."""
    data = np.frombuffer(chunk, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    if chunk.isascii():
        chars, end_chars = len(chunk), ends
    else:
        upto = np.cumsum((data & 0xC0) != 0x80)
        chars, end_chars = int(upto[-1]), upto[ends - 1]
    return Summary(chars, ends.tolist(), end_chars.tolist(), any(m in chunk for m in _MARKS), chunk[:_EDGE], chunk[-_EDGE:])


class ChunkCache:
    """Summaries of the chunks met lately. The key is the chunk itself, so equal hashes of different chunks do no harm."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held = limit, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.hits = self.asked = 0

    def of(self, chunk: bytes) -> Summary:
        self.asked += 1
        found = self.young.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            found = summarise(chunk)
        else:
            self.hits += 1
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[chunk] = found
        self.held += len(chunk)
        return found


def chunk_places(data: np.ndarray) -> list[int]:
    """Places after which a chunk may end: the rolling hash of the 32 bytes before has its upper bits zero."""
    rolled = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled = wider
    return (np.flatnonzero(rolled >> np.uint32(32 - BITS) == 0) + 1).tolist()


def chunk_edges(begin: int, end: int, places: list[int]) -> list[int]:
    """Edges of the chunks of data[begin:end]. No chunk is shorter than the hash's window, so texts before have no part in it."""
    edges, at = [begin], 0
    while (here := edges[-1]) < end:
        if here + LEAST >= end:
            edges.append(end)
            break
        at = bisect_left(places, here + LEAST, at)
        edges.append(min(places[at] if at < len(places) else end, here + MOST, end))
    return edges


class Chunked:
    """A text as its chunks' summaries: number of units, whether it holds a mark, and where a unit ends."""

    def __init__(self, data: bytes, edges: list[int], cache: ChunkCache):
        self.begin, self.end, self.edges = edges[0], edges[-1], edges
        self.parts = [cache.of(data[a:b]) for a, b in pairwise(edges)]
        self.line_feeds = list(accumulate(len(p.ends) for p in self.parts))
        self.chars = list(accumulate((p.chars for p in self.parts), initial=0))
        self.marked = any(p.marked for p in self.parts) or any(
            m in a.tail + b.head for a, b in pairwise(self.parts) for m in _MARKS
        )
        closed = not self.parts or self.parts[-1].tail.endswith(b"\n")
        self.units = (self.line_feeds[-1] if self.parts else 0) + (not closed)

    def end_of(self, units: int) -> tuple[int, int]:
        """The place (byte of the data, code point of the text) after so many units."""
        if not units:
            return self.begin, 0
        if units == self.units:
            return self.end, self.chars[-1]
        part = bisect_left(self.line_feeds, units)
        inside = units - 1 - (self.line_feeds[part - 1] if part else 0)
        return self.edges[part] + self.parts[part].ends[inside], self.chars[part] + self.parts[part].end_chars[inside]


def draws(key: int | None) -> tuple[int, int, int, int]:
    """The four unsigned 32-bit numbers drawn for an id."""
    digest = hashlib.sha256(f"{SALT}{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def rewrite(df: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and the whole output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for batch in common.slices(batches):
            texts = common.text_column(batch)
            joined = pa.concat_arrays([texts])  # a copy without an offset
            ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(texts) + 1].tolist()
            buffer = joined.buffers()[2]
            data = buffer.to_pybytes() if buffer is not None else b""
            places = chunk_places(np.frombuffer(data, np.uint8)[: ends[-1]])
            rows = []
            for key, begin, end in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
                low = bisect_left(places, begin)
                text = Chunked(data, chunk_edges(begin, end, places[low : bisect_left(places, end, low)]), cache)
                first, second, third, fourth = draws(key)
                if begin == end or text.marked or third % 100 >= rate:
                    rows.append((key, text.units, "plain", None, None, data[begin:end].decode()))
                    continue
                n = text.units + 1
                (a, a_chars), (b, b_chars) = (text.end_of(k) for k in sorted((first % n, second % n)))
                prefix, middle, suffix = (data[x:y].decode() for x, y in ((begin, a), (a, b), (b, end)))
                if fourth % 100 < suffix_first:
                    form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                else:
                    form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                rows.append((key, text.units, form, a_chars, b_chars - a_chars, output))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return common.map_arrow(
        common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, by its marks alone: no part of a rewritten text holds one."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    part = lambda begin, end: F.substr(output, begin + F.lit(len(PREFIX)), end - begin - F.lit(len(PREFIX)))
    rest = F.substr(output, m + F.lit(len(MIDDLE)))
    return (
        F.when(form == "psm", F.concat(part(p, s), rest, part(s, m)))
        .when(form == "spm", F.concat(part(p, m), rest, part(s, p)))
        .otherwise(output)
    )


def digests(df: DataFrame) -> DataFrame:
    """The columns of :func:`rewrite` with digests of the output and of the text restored from it."""
    made = rewrite(df)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
