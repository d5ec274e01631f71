"""Persisted tables: merging rows, status logs, deletes, vectors and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions.ids import entity_uuid

FINAL_STATUSES = ("complete", "failed")


def clinical_entities(entities: DataFrame, coded: DataFrame, documents: DataFrame) -> DataFrame:
    """Entities merged with their codes as stored rows; none is lost without a code.

    The coding confidence counts where there is one, and an undated entity takes
    the document's date or, failing that, its upload time. ``temp_id`` stays beside
    the id that is made of it, so that no one has to join to find it again.
    """
    codes = coded.filter(F.col("canonical_code").isNotNull()).select(
        "document_id", "temp_id", "normalized_value", "unit_canonical", "canonical_code",
        "coding_system", "coding_confidence", "reference_range_low", "reference_range_high",
        "reference_range_unit",
    )
    dates = documents.select(
        "document_id", F.coalesce("document_date", "uploaded_at").alias("fallback_date")
    )
    return (
        entities.join(codes, ["document_id", "temp_id"], "left")
        .join(dates, "document_id", "left")
        .select(
            entity_uuid(F.col("document_id"), F.col("temp_id")).alias("id"), "temp_id",
            "document_id", "patient_id", "entity_type", "raw_value", "entity_label",
            "normalized_value", "unit_raw", "unit_canonical", "canonical_code", "coding_system",
            F.coalesce("coding_confidence", "combined_confidence").alias("confidence"),
            "ocr_confidence", "ner_confidence", "source_span_start", "source_span_end",
            F.coalesce("entity_date", "fallback_date").alias("entity_date"),
            "is_negated", "assertion_status",
            F.lit("unverified").alias("verification_status"),
            "reference_range_low", "reference_range_high", "reference_range_unit",
        )
    )


def trend_rows(trends: DataFrame) -> DataFrame:
    """Trends as stored rows: first and last date and the number of points."""
    return trends.select(
        "patient_id", "metric_name", F.col("code").alias("metric_canonical_code"), "direction",
        "rate_of_change", F.col("first_ts").alias("trend_start_date"),
        F.col("last_ts").alias("trend_end_date"), "data_point_count", "statistical_confidence",
        "p_value", "change_point_date", "is_clinically_significant",
        "clinical_significance_reason",
    )


def insight_rows(verified: DataFrame) -> DataFrame:
    """Verified insights as stored rows, in the stored status vocabulary."""
    return verified.select(
        F.col("draft_id").alias("insight_id"), "patient_id",
        F.col("final_text").alias("draft_text"), "final_text", "supporting_entity_ids",
        F.lit(True).alias("model_inference_flag"),
        F.col("stored_status").alias("verification_status"), "verification_confidence",
        "verification_rationale", "severity", "requires_clinician_review",
        "patient_facing_text", "clinician_facing_text",
        F.lit(None).cast("string").alias("clinician_reviewed_by"),
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Current status per document from its log; the final ones carry a processed time."""
    last = log.groupBy("document_id").agg(
        F.max_by(F.struct("status", "changed_at"), F.struct("changed_at", "log_id")).alias("s")
    )
    return last.select(
        "document_id", F.col("s.status").alias("processing_status"),
        F.when(F.col("s.status").isin(*FINAL_STATUSES), F.col("s.changed_at")).alias("processed_at"),
    )


def delete_documents(documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining documents, and a one-row count of those removed."""
    gone = ids.select("document_id").distinct()
    removed = documents.join(gone, "document_id", "left_semi").agg(
        F.count("*").alias("deleted_count")
    )
    return documents.join(gone, "document_id", "left_anti"), removed


def upsert_vectors(stored: DataFrame, new: DataFrame, key: str = "passage_id") -> DataFrame:
    """New vectors replace stored ones of the same id."""
    fields = [c for c in stored.columns if c != key]
    both = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), "_v").alias("r")).select(key, "r.*")


def patient_bucket(patient_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(patient_id.cast("string")), F.lit(buckets)).cast("int")


def write_patient_vectors(
    vectors: DataFrame, path: str, buckets: int = 256, shards: int = 8
) -> None:
    """Vectors partitioned by a bucket of the patient; a directory per patient would not scale.

    The shard spreads a patient with very many vectors over several writers.
    """
    (
        vectors.withColumn("patient_bucket", patient_bucket(F.col("patient_id"), buckets))
        .withColumn("_shard", F.pmod(F.xxhash64("passage_id"), F.lit(shards)))
        .repartition("patient_bucket", "_shard")
        .drop("_shard")
        .sortWithinPartitions("patient_bucket", "patient_id")
        .write.mode("overwrite")
        .partitionBy("patient_bucket")
        .parquet(path)
    )


def read_patient_vectors(
    spark: SparkSession, path: str, patient_id: str, buckets: int = 256
) -> DataFrame:
    """One patient's vectors; the scan opens that patient's bucket only."""
    return spark.read.parquet(path).filter(
        (F.col("patient_bucket") == patient_bucket(F.lit(patient_id), buckets)) & (F.col("patient_id") == patient_id)
    )
