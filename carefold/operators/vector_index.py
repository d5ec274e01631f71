"""Approximate vector search over an inverted file, beside the exact search of ``retrieval``.

Centroids are fitted on a bounded sample; every vector is then stored in the cell of its nearest centroid. A query looks
into the cells nearest to it and is compared exactly with what lies there, by the blocks of ``retrieval.blocked_top_k``; a
cell that holds a third of all vectors is cut into blocks like any other group. What is left out is a true neighbour in a cell
that was not looked into; ``recall`` measures how many are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold import settings
from carefold.operators.retrieval import blocked_top_k

#: Vectors that centroids are fitted on at most, those of the lowest hashes of their ids, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 8


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of length 1; a zero vector stays."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    if not len(rows):
        return rows.reshape(0, 1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of ``cells`` groups at most, by repeated assignment to the nearest; starts from evenly spaced rows."""
    if not len(sample):
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)
    return centres


class CellIndex:
    """Vectors of ``passage_id, <by>, vector`` by cell, below ``path``; ``kinds`` are the types of the id and of ``by``."""

    def __init__(self, spark: SparkSession, path: str, by: str = "category", kinds: tuple[str, str] = ("bigint", "string")):
        self.spark, self.path, self.by, self.kinds = spark, path.rstrip("/"), by, kinds

    @classmethod
    def build(cls, passages: DataFrame, path: str, cells: int = 64, by: str = "category", sample: int = SAMPLE) -> "CellIndex":
        """Fits ``cells`` centroids and stores every passage; null vectors and ids are left out.

        Centroids (a parameter's number of them) and the sample are what the driver holds.
        """
        index = cls(passages.sparkSession, path, by, tuple(passages.schema[c].dataType.simpleString() for c in ("passage_id", by)))
        given = passages.select("passage_id", by, F.col("vector").cast("array<double>").alias("vector")).filter(
            "passage_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
        )
        rows = given.select("vector", F.xxhash64("passage_id").alias("h"), "passage_id").orderBy("h", "passage_id").limit(sample).select("vector").collect()
        centres = fit_centroids(unit_rows([r.vector for r in rows]), cells)
        cell = given.withColumn("cell", _nearest(centres, 1)(F.col("vector"))[0])
        cell.repartition("cell", F.pmod(F.xxhash64("passage_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/passages")
        index.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, vector array<double>").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{index.path}/centroids")
        return index

    def passages(self) -> DataFrame:
        schema = f"passage_id {self.kinds[0]}, `{self.by}` {self.kinds[1]}, vector array<double>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/passages")

    def search(self, queries: DataFrame, top_k: int = settings.SEARCH_TOP_K, probes: int = 8) -> DataFrame:
        """query_id, passage_id, score and hit_rank among the passages of the query's ``by`` in its ``probes`` nearest cells."""
        rows = self.spark.read.schema("cell int, vector array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()
        centres = np.array([r.vector for r in rows])
        if not len(centres):
            return blocked_top_k(queries, self.passages(), top_k, by=self.by)
        # a group is a value of `by` within a cell
        place = F.concat_ws("|", F.col("cell").cast("string"), F.col(self.by).cast("string"))
        looked = queries.select("query_id", self.by, F.col("vector").cast("array<double>").alias("vector")).withColumn(
            "cell", F.explode(_nearest(centres, min(probes, len(centres)))(F.col("vector")))
        ).filter(f"{self.by} IS NOT NULL")
        return blocked_top_k(
            looked.select("query_id", place.alias("place"), "vector"),
            self.passages().filter(f"{self.by} IS NOT NULL").select("passage_id", place.alias("place"), "vector"), top_k, by="place",
        )


def _nearest(centres: np.ndarray, count: int):
    """The numbers of the ``count`` nearest centroids of each vector, nearest first; ties to the smaller number."""

    @F.pandas_udf("array<int>")
    def cells(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            # nested, so that workers get it by value
            rows = np.array([np.asarray(v, np.float64) for v in batch])
            order = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :count].astype(np.int32)
            yield pd.Series(list(order))

    return cells


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``queries``, ``wanted`` and ``found`` hits, and the share found: of the exact hits, those that ``found`` has too."""
    keys = ["query_id", "passage_id"]
    both = exact.select(*keys).join(found.select(*keys).withColumn("_hit", F.lit(1)), keys, "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found")
    ).withColumn("recall", F.try_divide("found", "wanted"))
