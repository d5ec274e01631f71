"""Patient reports, review queues and listings, for all patients at once.

A caller after one patient filters the result; the filter reaches the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold.functions.ids import digest
from carefold.functions.text import empty_to_null, title_words
from carefold.operators.insights import SEVERITIES
from carefold.sources.knowledge import local_frame

# ---------------------------------------------------------------------------
# Progress and label of each processing status.
# ---------------------------------------------------------------------------
PROGRESS = (
    ("queued", 0, "Queued"),
    ("ingesting", 10, "Ingestion & Triage"),
    ("ocr", 30, "OCR & Layout Extraction"),
    ("ner", 50, "Medical Entity Recognition"),
    ("normalizing", 60, "Ontology Normalization"),
    ("trend_analysis", 70, "Trend Analysis"),
    ("reasoning", 80, "Reasoning & Insight Generation"),
    ("verifying", 90, "Independent Verification"),
    ("complete", 100, "Complete"),
    ("failed", 0, "Failed"),
    ("needs_rescan", 0, "Needs Rescan"),
)


def _severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark cuts each key to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def patient_summary(
    patients: DataFrame, documents: DataFrame, entities: DataFrame, trends: DataFrame,
    insights: DataFrame,
) -> DataFrame:
    """Document, medication, metric and pending-review counts per patient."""
    docs = documents.groupBy("patient_id").agg(F.count("*").alias("document_count"))
    drugs = (
        entities.filter(F.col("entity_type") == "medication")
        .groupBy("patient_id")
        .agg(F.count("*").alias("active_medications"))
    )
    metrics = trends.groupBy("patient_id").agg(
        F.countDistinct("metric_name").alias("tracked_metrics")
    )
    reviews = (
        insights.filter(pending_review())
        .groupBy("patient_id")
        .agg(F.count("*").alias("pending_reviews"))
    )
    out = patients.select("patient_id")
    for part in (docs, drugs, metrics, reviews):
        out = out.join(part, "patient_id", "left")
    return out.na.fill(
        0, ["document_count", "active_medications", "tracked_metrics", "pending_reviews"]
    )


def pending_review() -> Column:
    return F.col("requires_clinician_review") & F.col("clinician_reviewed_by").isNull()


def recent_insights(insights: DataFrame, n: int = 3) -> DataFrame:
    """Latest insights per patient with the text a patient may see."""
    order = [F.col("created_at").desc(), F.col("insight_id").desc()]
    return top_per_key(insights, ["patient_id"], order, n).select(
        "patient_id", "rank", "insight_id",
        F.coalesce(
            empty_to_null(F.col("patient_facing_text")), empty_to_null(F.col("final_text")),
            F.col("draft_text"),
        ).alias("patient_facing_text"),
        F.coalesce("severity", F.lit("informational")).alias("severity"),
    )


def top_trends(trends: DataFrame, n: int = 3) -> DataFrame:
    """Significant metrics first."""
    order = [F.col("is_clinically_significant").desc(), F.col("metric_name"), F.col("code")]
    return top_per_key(trends, ["patient_id"], order, n).select(
        "patient_id", "rank", "metric_name",
        title_words(F.col("metric_name")).alias("metric_display"),
        "direction", "data_point_count", "is_clinically_significant",
    )


def recent_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    order = [F.col("uploaded_at").desc(), F.col("document_id").desc()]
    return top_per_key(documents, ["patient_id"], order, n).select(
        "patient_id", "rank", "document_id", "filename",
        F.col("processing_status").alias("status"), "uploaded_at",
    )


def timeline(entities: DataFrame) -> DataFrame:
    """Entities under their "Month YYYY" heading, undated ones under "Unknown Date"."""
    dated = F.col("entity_date").isNotNull()
    return entities.select(
        "patient_id",
        F.when(dated, F.date_format("entity_date", "MMMM yyyy"))
        .otherwise("Unknown Date")
        .alias("month"),
        F.col("id"),
        F.when(dated, F.date_format("entity_date", "dd MMM")).otherwise("Unknown").alias("date"),
        F.col("entity_type").alias("type"),
        F.coalesce(
            empty_to_null(F.col("entity_label")), title_words(F.col("entity_type"))
        ).alias("label"),
        F.coalesce(empty_to_null(F.col("normalized_value")), F.col("raw_value")).alias("value"),
        F.coalesce(
            empty_to_null(F.col("unit_canonical")), empty_to_null(F.col("unit_raw")), F.lit("")
        ).alias("unit"),
        F.coalesce(F.when(F.col("confidence") != 0, F.col("confidence")), F.lit(0.8)).alias(
            "confidence"
        ),
    )


def timeline_groups(events: DataFrame) -> DataFrame:
    return events.groupBy("patient_id", "month").agg(F.count("*").alias("event_count"))


def stored_trends(trends: DataFrame) -> DataFrame:
    return trends.select(
        "patient_id", "metric_name", "metric_canonical_code", "direction", "rate_of_change",
        "statistical_confidence", "is_clinically_significant", "clinical_significance_reason",
        F.lit(False).alias("monitoring_gap_detected"),
        F.col("trend_end_date").alias("last_measurement_date"),
    )


def stored_insights(insights: DataFrame) -> DataFrame:
    """Insights with defaults in place of what is missing."""
    empty = F.lit("")
    return insights.select(
        "patient_id", "insight_id",
        F.coalesce(empty_to_null(F.col("final_text")), F.col("draft_text")).alias("final_text"),
        F.coalesce("patient_facing_text", empty).alias("patient_facing_text"),
        F.coalesce("clinician_facing_text", empty).alias("clinician_facing_text"),
        F.coalesce("verification_status", F.lit("pending")).alias("verification_status"),
        F.coalesce("verification_confidence", F.lit(0.0)).alias("verification_confidence"),
        F.coalesce("verification_rationale", empty).alias("verification_rationale"),
        F.coalesce("severity", F.lit("informational")).alias("severity"),
        F.coalesce("requires_clinician_review", F.lit(False)).alias("requires_clinician_review"),
    )


def document_progress(documents: DataFrame) -> DataFrame:
    names = ("processing_status", "progress_percentage", "current_step")
    steps = local_frame(
        documents.sparkSession, [dict(zip(names, row)) for row in PROGRESS],
        "processing_status string, progress_percentage int, current_step string",
    )
    return documents.join(steps, "processing_status", "left").select(
        "document_id", "processing_status",
        F.coalesce("current_step", F.lit("Unknown")).alias("current_step"),
        F.coalesce("progress_percentage", F.lit(0)).alias("progress_percentage"),
    )


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """Rows of one page with ``total``, ``page``, ``size`` and ``pages`` beside them.

    The page is a top-k over the sort, the total one aggregate; no row is
    numbered across the whole table.
    """
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    total = df.agg(F.count("*").alias("total"))
    # A page of rows beside a single row.
    return rows.join(F.broadcast(total)).select(
        "*", F.lit(page_no).alias("page"), F.lit(size).alias("size"),
        F.ceil(F.col("total") / size).cast("long").alias("pages"),
    )


def filter_entities(
    df: DataFrame,
    start_date: str | None = None,
    end_date: str | None = None,
    entity_types: list[str] | None = None,
    severities: list[str] | None = None,
    search: str | None = None,
    confidence_min: float | None = None,
) -> DataFrame:
    """Applies the filters that are given; each is a plain predicate the scan can take."""
    if start_date is not None:
        df = df.filter(F.col("entity_date") >= F.lit(start_date).cast("timestamp"))
    if end_date is not None:
        df = df.filter(F.col("entity_date") <= F.lit(end_date).cast("timestamp"))
    if entity_types:
        df = df.filter(F.col("entity_type").isin(*entity_types))
    if severities:
        df = df.filter(F.col("severity").isin(*severities))
    if search:
        df = df.filter(F.contains(F.lower("raw_value"), F.lit(search.lower())))
    if confidence_min is not None:
        df = df.filter(F.col("confidence") >= confidence_min)
    return df


# --------------------------------------------------------------------------- review
def review_queue(insights: DataFrame) -> DataFrame:
    """Insights waiting for a clinician with their priority and the patient's urgent count."""
    priority = _severity_rank(F.col("severity"))
    waiting = insights.filter(pending_review()).withColumn("priority", priority)
    urgent = waiting.groupBy("patient_id").agg(
        F.count_if(F.col("priority") >= SEVERITIES.index("high")).alias("urgent_count")
    )
    return waiting.select("patient_id", "insight_id", "severity", "priority", "created_at").join(
        urgent, "patient_id"
    )


def apply_reviews(insights: DataFrame, actions: DataFrame) -> DataFrame:
    """The latest action of each insight applied: text, status and reviewer."""
    last = actions.groupBy("insight_id").agg(
        F.max_by(
            F.struct("action", "modified_text", "reviewer", "acted_at"),
            F.struct("acted_at", "action_id"),
        ).alias("a")
    )
    return insights.join(last, "insight_id", "left").select(
        "patient_id", "insight_id",
        F.coalesce(
            F.when(F.col("a.action") == "modified", empty_to_null(F.col("a.modified_text"))),
            F.col("final_text"),
        ).alias("final_text"),
        F.coalesce("a.action", "verification_status").alias("verification_status"),
        F.col("a.reviewer").alias("clinician_reviewed_by"),
        F.col("a.acted_at").alias("clinician_reviewed_at"),
        (F.col("requires_clinician_review") & F.col("a.action").isNull()).alias("still_pending"),
    )


def correction_queue(corrections: DataFrame, resolutions: DataFrame, entities: DataFrame) -> DataFrame:
    """Corrections with their entity and latest resolution; unresolved ones stay pending."""
    last = resolutions.groupBy("correction_id").agg(
        F.max_by(
            F.struct("status", "resolved_at", "resolution_notes"), F.struct("resolved_at", "status")
        ).alias("r")
    )
    named = entities.select(F.col("id").alias("entity_id"), "entity_label", "confidence")
    return (
        corrections.join(last, "correction_id", "left")
        .join(named, "entity_id", "left")
        .select(
            "correction_id", "entity_id", "patient_id", "correction_type", "original_value",
            "suggested_correction", "entity_label", "confidence",
            F.coalesce("r.status", F.lit("pending")).alias("status"),
            F.col("r.resolved_at").alias("resolved_at"),
        )
    )


def audit_events(
    steps: DataFrame, inputs: list[str], outputs: list[str]
) -> DataFrame:
    """One event per step row with hashes of what went in and came out."""
    return steps.select(
        "document_id", "patient_id", "agent_name", "action",
        digest(*[F.col(c) for c in inputs]).alias("input_hash"),
        digest(*[F.col(c) for c in outputs]).alias("output_hash"),
        F.greatest(
            F.lit(0), F.unix_millis("ended_at") - F.unix_millis("started_at")
        ).alias("duration_ms"),
        F.when(F.col("error_message").isNull(), "success").otherwise("failure").alias("status"),
        F.col("ended_at").alias("timestamp"),
    )


def audit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("agent_name", "status").agg(
        F.count("*").alias("event_count"), F.avg("duration_ms").alias("mean_duration_ms"),
        F.max("timestamp").alias("last_event"),
    )


def patient_directory(patients: DataFrame, documents: DataFrame, insights: DataFrame) -> DataFrame:
    docs = documents.groupBy("patient_id").agg(
        F.count("*").alias("document_count"), F.max("uploaded_at").alias("last_upload_at")
    )
    active = insights.groupBy("patient_id").agg(
        F.count_if(F.coalesce(F.col("verification_status"), F.lit("pending")) != "rejected").alias(
            "active_insight_count"
        ),
        F.count_if(pending_review()).alias("pending_review_count"),
    )
    return (
        patients.join(docs, "patient_id", "left")
        .join(active, "patient_id", "left")
        .na.fill(0, ["document_count", "active_insight_count", "pending_review_count"])
    )


def patient_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        "patient_id", "document_id", "filename", "document_type", "processing_status",
        "uploaded_at", "storage_path",
    )


def patient_state(
    documents: DataFrame, entities: DataFrame, trends: DataFrame, insights: DataFrame,
    page_rows: int = 1000,
) -> DataFrame:
    """Snapshot sections of each patient in pages of bounded size.

    One row per patient, section and page. Items fall to pages by hash, with as
    many pages as the section's count needs, so no list grows without bound.
    """
    def section(df: DataFrame, name: str, item_id: str, *fields: str) -> DataFrame:
        rows = df.select(
            "patient_id", F.lit(name).alias("section"), F.col(item_id).cast("string").alias("item_id"),
            F.to_json(F.struct(item_id, *fields)).alias("item"),
        )
        return rows

    rows = (
        section(documents, "documents", "document_id", "filename", "processing_status")
        .unionByName(section(entities, "entities", "id", "entity_type", "raw_value"))
        .unionByName(section(trends, "trends", "code", "metric_name", "direction"))
        .unionByName(section(insights, "insights", "insight_id", "severity"))
    )
    counts = rows.groupBy("patient_id", "section").agg(
        F.ceil(F.count("*") / page_rows).cast("int").alias("page_count")
    )
    paged = rows.join(counts, ["patient_id", "section"]).withColumn(
        "page_no", F.pmod(F.xxhash64("item_id"), F.col("page_count")).cast("int")
    )
    return paged.groupBy("patient_id", "section", "page_no", "page_count").agg(
        F.sort_array(F.collect_list("item")).alias("items")
    )
