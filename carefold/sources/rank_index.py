"""Rows stored by rank, so that any page is read from the few files that hold it.

``build`` deals the rows by ranges of their order, one folder per range, and counts each range. The rank of a row is the count
of the ranges before plus its place in its own, so a page needs the counts and the ranges it lies in: page 10,000 costs what
page 1 does, and no row is numbered across the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a range, on average; from so many ranges on, smaller ranges grow up to it.
RANGE_ROWS, MANY_RANGES = 100_000, 256


class RankIndex:
    """An index of rows of ``schema`` below ``path``.

    ``order`` must tell all rows apart, or rows equal in it may change places between pages. The name ``_range`` is reserved.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: list[Column]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self.schema = StructType([*schema.fields, StructField("_range", IntegerType())])

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @classmethod
    def build(cls, df: DataFrame, path: str, order: list[Column], range_rows: int = RANGE_ROWS) -> "RankIndex":
        """Ranges have ``range_rows`` rows on average, as long as that makes few folders; those of a large table have up to ``RANGE_ROWS``."""
        index = cls(df.sparkSession, path, df.schema, order)
        rows = df.count()
        ranges = max(1, -(-rows // max(range_rows, min(RANGE_ROWS, -(-rows // MANY_RANGES)))))
        dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions("_range", *order).write.mode("overwrite").partitionBy("_range").parquet(f"{index.path}/rows")
        # one row per range
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = index._rows().groupBy("_range").agg(F.count("*").alias("count"))
        counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/ranges")
        return index

    def page(self, page_no: int, size: int) -> DataFrame:
        """Rows of one page, from 1 on, with ``rank``, ``total``, ``page``, ``size`` and ``pages``; beyond the last page none."""
        first = (page_no - 1) * size
        ranges = self.spark.read.schema("_range int, count long, base long").parquet(f"{self.path}/ranges")
        total = ranges.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        # as many rows as a page touches ranges
        met = ranges.filter((F.col("base") < first + size) & (F.col("base") + F.col("count") > first)).collect()
        rows = self._rows().filter(F.col("_range").isin([r["_range"] for r in met]))
        base = F.lit(0).cast("long")
        for r in met:
            base = F.when(F.col("_range") == r["_range"], r["base"]).otherwise(base)
        ranked = rows.withColumn("rank", base + F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)))
        return ranked.filter((F.col("rank") > first) & (F.col("rank") <= first + size)).drop("_range").select(
            "*", F.lit(total).cast("long").alias("total"), F.lit(page_no).alias("page"), F.lit(size).alias("size"),
            F.ceil(F.lit(total) / size).cast("long").alias("pages"),
        )
