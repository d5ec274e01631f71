"""Tables that are merged by key: bucketed files, rewritten bucket by bucket, and one manifest per snapshot.

A snapshot is a manifest, a small JSON file that names the folder of each bucket's rows. A merge reads the buckets its
rows fall into, writes those anew into a folder of its own and commits a manifest that names them beside the untouched ones.
Readers read the folders of one manifest, so they never see half a merge, and older snapshots stay readable. A manifest is
created under the next number or not at all: of two merges at once one fails and can be run again. Files of a merge that did
not commit are named by no manifest.

A merge may carry a ``mark``, such as the id and batch number of a stream. The manifest keeps the last mark of each
stream, so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a bucket that one task merges at ease.
BUCKET_ROWS = 500_000


class ConcurrentMerge(RuntimeError):
    """Another merge committed the snapshot that this one was about to."""


@dataclass(frozen=True)
class Manifest:
    """``folders``: bucket to folder; ``marks``: stream to its last batch."""

    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        found = json.loads(text)
        found["keys"] = tuple(found["keys"])
        found["folders"] = {int(k): v for k, v in found["folders"].items()}
        return cls(**found)


class SnapshotTable:
    """A table of one row per key below ``path``, in any file system that Spark reaches.

    ``create`` fixes keys and buckets; take so many buckets that one fits a task. Of rows with equal keys in one merge that
    of the largest order counts, of equal orders the largest row. A null key is a key like others. Columns named ``_bucket``
    and ``_rank`` are reserved. The file system must refuse a rename onto a name that exists, as HDFS does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------------ manifests
    def _files(self):
        """The Hadoop file system of the table, and its class of paths."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._files()
        folder = path(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions())
        text = self.spark.read.text(f"{self.path}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return Manifest.from_json(text)

    def _commit(self, manifest: Manifest) -> None:
        fs, path = self._files()
        fs.mkdirs(path(f"{self.path}/manifests"))
        target = path(f"{self.path}/manifests/{manifest.version:08d}.json")
        draft = path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(manifest.to_json().encode()))
        stream.close()
        # a rename onto a name that exists fails, so a number is given once
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise ConcurrentMerge(f"snapshot {manifest.version} exists")

    # ------------------------------------------------------------------ rows
    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> "SnapshotTable":
        table = cls(spark, path)
        table._commit(Manifest(0, schema.json(), tuple(keys), buckets))
        return table

    def _bucket(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in manifest.keys]), F.lit(manifest.buckets)).cast("int")

    def _read(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        folders = [f for b, f in sorted(manifest.folders.items()) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the newest by default."""
        return self._read(self.manifest(version))

    def read_key(self, *values, version: int | None = None) -> DataFrame:
        """The row of one key, from the files of its bucket alone."""
        manifest = self.manifest(version)
        schema = StructType.fromJson(json.loads(manifest.schema))
        wanted = self.spark.createDataFrame([values], StructType([schema[k] for k in manifest.keys]))
        bucket = wanted.select(self._bucket(manifest)).first()[0]
        same = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(manifest.keys, values, strict=True)]
        return self._read(manifest, [bucket]).filter(reduce(Column.__and__, same))

    def upsert(self, rows: DataFrame, order: str | None = None, mark: tuple[str, int] | None = None) -> Manifest:
        """Rows of new keys are added, those of known keys replaced.

        With ``order``, a column of the table, the row of the largest order counts, wherever it came first; so the same rows
        give the same table however they are split into merges. Of equal orders the later merge counts.
        """
        manifest = self.manifest()
        schema = StructType.fromJson(json.loads(manifest.schema))
        rank = F.col(f"`{order}`") if order else F.lit(0)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_rank", F.struct(rank.alias("order"), F.lit(0).alias("merge"))).unionByName(
                new.select(*schema.names, "_bucket", F.struct(rank.alias("order"), F.lit(1).alias("merge")).alias("_rank"))
            )
            fields = F.struct(*[F.col(f"`{n}`") for n in schema.names]).alias("row")
            keys = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(manifest.keys)]
            # dealt by bucket once, for the grouping and for the files
            best = both.repartition("_bucket").groupBy("_bucket", *keys).agg(F.max(F.struct("_rank", fields)).alias("best"))
            return best.select("_bucket", "best.row.*")

        return self._merge(manifest, rows, merge, mark)

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> Manifest:
        """Takes the rows of the given keys out; only buckets that a key falls into are rewritten."""
        manifest = self.manifest()

        def merge(old: DataFrame, gone: DataFrame) -> DataFrame:
            named = gone.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(manifest.keys)])
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(manifest.keys)]
            return old.join(named, reduce(Column.__and__, same), "left_anti").repartition("_bucket")

        return self._merge(manifest, keys.select(*manifest.keys), merge, mark)

    def _merge(self, manifest: Manifest, given: DataFrame, merge, mark: tuple[str, int] | None) -> Manifest:
        if mark is not None and manifest.marks.get(mark[0], -1) >= mark[1]:
            return manifest
        placed = given.withColumn("_bucket", self._bucket(manifest))
        # at most as many rows as the table has buckets
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())
        old = self._read(manifest, touched).withColumn("_bucket", self._bucket(manifest))
        folder = f"files/{uuid.uuid4().hex}"
        merge(old, placed).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, path = self._files()
        there = {s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))} if touched else set()
        folders = {b: f for b, f in manifest.folders.items() if b not in touched}
        folders |= {b: f"{folder}/_bucket={b}" for b in touched if f"_bucket={b}" in there}
        marks = manifest.marks | ({mark[0]: mark[1]} if mark else {})
        made = Manifest(manifest.version + 1, manifest.schema, manifest.keys, manifest.buckets, folders, marks)
        self._commit(made)
        return made
