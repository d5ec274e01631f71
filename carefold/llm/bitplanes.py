"""Token-id files of byte or bit planes.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK`` ids; each block is transposed into
planes (plane k holds byte, or bit, k of every id), and each plane is compressed with zstandard, so that the planes that
are constant for a small vocabulary cost next to nothing. A footer lists every chunk (place, number of ids, sizes of its
planes) and every document (id, number of ids); the last 8 bytes give the footer's length. ``index.json`` beside the
files lists them in order with the number of ids before each.

Documents are ordered by doc_id (nulls first), equal doc_ids by text. Null texts count as empty and still get their end
id; an empty table gives an index without files. Files are written under new names and count only once the list of
files is stored, so a repeated or lost task cannot spoil a file.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm import bpe, common
from carefold.session import estimated_bytes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MAGIC = b"IDPLANE1"
#: Ids per chunk.
BLOCK = 1 << 16
#: Bytes of the stored table per file.
SHARD_BYTES = 64 << 20
ORDER = "doc_id"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids: 4 planes of bytes, or 32 planes of bits (padded to whole bytes)."""
    by_byte = np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [by_byte[:, k].tobytes() for k in range(4)]
    return [np.packbits((by_byte[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    for k, plane in enumerate(planes):
        column = np.frombuffer(plane, np.uint8)
        if bits:
            out[:, k // 8] |= np.unpackbits(column, count=count) << (k % 8)
        else:
            out[:, k] = column
    return out.reshape(-1).view("<u4")


class Writer:
    """Appends documents to one file; holds one block and the footer."""

    def __init__(self, sink: io.RawIOBase, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.sink, self.bits, self.block = sink, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held = [], 0
        self.chunks, self.keys, self.counts = [], [], []
        self.place = sink.write(MAGIC)

    def add(self, keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys += keys
        self.counts += counts.tolist()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            joined = np.concatenate(self.held)
            whole = len(joined) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(joined[at : at + self.block])
            self.held, self.n_held = [joined[whole:].copy()], len(joined) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.pack(p) for p in to_planes(ids, self.bits)]
        self.chunks.append([self.place, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.place += self.sink.write(p)

    def close(self) -> int:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        footer = self.pack(json.dumps({"bits": self.bits, "chunks": self.chunks, "docs": self.keys, "counts": self.counts}).encode())
        self.sink.write(footer)
        self.sink.write(struct.pack("<Q", len(footer)))
        return sum(self.counts)


class Reader:
    """Reads the footer, then any chunk or all documents in order, one chunk at a time."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        if source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of id planes")
        (length,) = struct.unpack("<Q", source.read_at(8, size - 8))
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.footer = json.loads(self.unpack(source.read_at(length, size - 8 - length)))

    def chunk(self, number: int) -> np.ndarray:
        place, count, sizes = self.footer["chunks"][number]
        data = memoryview(self.source.read_at(sum(sizes), place))
        ends = np.cumsum(sizes).tolist()
        return from_planes([self.unpack(data[e - s : e]) for s, e in zip(sizes, ends, strict=True)], count, self.footer["bits"])

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """Each document's key, number of ids, and its ids in parts; the parts must be used before the next document."""
        chunk, at, number = np.zeros(0, "<u4"), 0, 0

        def parts(left: int) -> Iterator[np.ndarray]:
            nonlocal chunk, at, number
            while left:
                if at == len(chunk):
                    chunk, at, number = self.chunk(number), 0, number + 1
                piece = chunk[at : at + left]
                at, left = at + len(piece), left - len(piece)
                yield piece

        for key, count in zip(self.footer["docs"], self.footer["counts"], strict=True):
            yield key, count, parts(count)


def write(df: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 0, bits: bool = False, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encodes ``doc_id, text`` and writes the files and ``index.json`` into ``folder``; returns the index.

    The driver sees one line per file (its name and two counts), never ids or documents.
    """
    spark = df.sparkSession
    source = common.plain(df, "doc_id", "text")
    size = estimated_bytes(source)
    # the optimizer gives a size near the largest integer where it knows none
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // shard_bytes) if size < 1 << 55 else 0)
    key = F.col("doc_id").asc_nulls_first()
    dealt = source.repartitionByRange(shards, key, F.xxhash64("text")).sortWithinPartitions(key, F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder.of(tokenizer)
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.planes"
        writer = sink = None
        for batch in common.slices(batches, "text", 2 * common.SLICE_BYTES):
            if writer is None:
                filesystem, path = fs.FileSystem.from_uri(folder)
                filesystem.create_dir(path, recursive=True)
                sink = filesystem.open_output_stream(f"{path}/{name}")
                writer = Writer(sink, bits)
            ids, counts = encoder.encode(common.text_column(batch))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            writer.add(batch.column(0).to_pylist(), counts + 1, ids)
        if writer is not None:
            total = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.keys)], "n_ids": [total]})

    made = common.store(common.map_arrow(dealt, run, "shard long, file string, n_docs long, n_ids long", bpe.KEEPS), "id-files")
    index, before = [], 0
    for row in made.orderBy("shard").toLocalIterator():
        index.append({"file": row.file, "start": before, "n_docs": row.n_docs, "n_ids": row.n_ids})
        before += row.n_ids
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    with filesystem.open_output_stream(f"{path}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: one task per file, one chunk at a time."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    with filesystem.open_input_file(f"{path}/index.json") as file:
        index = json.loads(file.read())
    files = spark.createDataFrame([(x["file"], x["start"]) for x in index], "file string, start long").repartition(max(1, len(index)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with own.open_input_file(f"{at}/{name}") as file:
                    rows, before = [], start
                    for key, count, parts in Reader(file).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(np.ascontiguousarray(part), crc)
                        rows.append((key, before, count, crc))
                        before += count
                        if len(rows) == 20_000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return common.map_arrow(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long", bpe.KEEPS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def round_trip(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the files of ``df`` and reads them back."""
    folder = folder or common.shared_path(df.sparkSession, "id-planes")
    write(df, folder)
    return read_digests(df.sparkSession, folder)
