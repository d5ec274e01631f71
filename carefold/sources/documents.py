"""Document intake: file registration and storage paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions.ids import stable_key

S3_PATH = r"^s3://([^/]*)/?(.*)$"


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Uploaded files with their bytes; only the columns a plan uses are read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def register_documents(
    files: DataFrame, bucket: str, patient_id: Column, filename: Column | None = None
) -> DataFrame:
    """One queued row per file. Re-registering a file gives the same id."""
    name = filename if filename is not None else F.element_at(F.split("path", "/"), -1)
    keyed = files.withColumn("patient_id", patient_id.cast("string")).withColumn("filename", name)
    storage = F.concat(F.lit(f"s3://{bucket}/"), "patient_id", F.lit("/"), "filename")
    return keyed.select(
        stable_key(storage).alias("document_id"),
        "patient_id",
        "filename",
        storage.alias("storage_path"),
        F.lit("unknown").alias("document_type"),
        F.lit("queued").alias("processing_status"),
        F.col("modificationTime").alias("uploaded_at"),
        F.col("length"),
    )


def parse_storage_path(path: Column, default_bucket: str) -> Column:
    """``s3://bucket/key`` split in two; a bare key lies in the default bucket."""
    is_s3 = F.startswith(path, F.lit("s3://"))
    return F.struct(
        F.when(is_s3, F.regexp_extract(path, S3_PATH, 1))
        .otherwise(F.lit(default_bucket))
        .alias("bucket"),
        F.when(is_s3, F.regexp_extract(path, S3_PATH, 2)).otherwise(path).alias("key"),
    )


__all__ = ["parse_storage_path", "register_documents", "scan_files"]
