"""Tables, stored intermediates and Arrow batches shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carefold.session import shared_folder

#: Texts are worked on in slices of about so many bytes, so that a task's memory does not follow its partition.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch that Spark hands to a worker.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder of the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the folders that are stored inside the block, so that its caller can delete them when they are read no more."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def delete_unread(folders: list[str], docs: DataFrame) -> list[str]:
    """Deletes folders that ``docs`` does not read from; gives those that are left."""
    read = [f.split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()]
    left = []
    for folder in folders:
        if any(f.startswith(folder.split(":", 1)[-1].lstrip("/") + "/") for f in read):
            left.append(folder)
            continue
        path = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return left


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again.

    This cuts the lineage without a local copy: a lost executor costs only the tasks it held.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    for folders in _RECORDS:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo ``modulus``; a null key falls into fold -1."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus, F.lit(-1))


def fold_of(key: int | None, modulus: int) -> int:
    return -1 if key is None else zlib.crc32(str(key).encode()) % modulus


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The texts of a batch as a string array; a null text counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches at rows so that each piece holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for row, length in enumerate(lengths.tolist()):
            if held and held + length > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        yield batch.slice(begin)


#: What this process has built and keeps from one task to the next, by the kind of tasks that use it.
_KEPT: dict[str, dict[str, Any]] = {}


def kept(kind: str, name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, built once and kept until a task of another kind runs in this process."""
    built = _KEPT.setdefault(kind, {})
    if name not in built:
        built[name] = build()
    return built[name]


def drop_kept(keeps: str | None) -> None:
    """Drops what is kept for other kinds than ``keeps``, and gives freed memory back to the machine.

    Workers outlive their stage; what they keep would lie beside what the next stage needs.
    """
    others = [k for k in _KEPT if k != keeps]
    for kind in others:
        del _KEPT[kind]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if others else None
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str | None = None
) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, so that long rows do not make large batches.

    ``keeps`` is the kind of ``kept`` objects that the tasks use, or that tasks between them use.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        yield from run(batches)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df.mapInArrow(task, schema)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; columns of other names cannot clash with derived ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` has it, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
