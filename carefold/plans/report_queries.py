"""Report, review and listing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.operators import reports
from carefold.plans.inputs import DOCUMENTS, ENTITIES, INSIGHTS, Inputs, sql_select
from carefold.plans.registry import framed, query, values_sql
from carefold.plans.trend_queries import TREND_SQL, trend_table
from carefold.session import shared_folder
from carefold.sources.rank_index import RankIndex

_DOCS = sql_select(DOCUMENTS, "orders")
_ENTS = sql_select(ENTITIES, "lineitem")
_INS = sql_select(INSIGHTS, "orders")
_RANK = ("CASE severity WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END")
_PENDING = "(requires_clinician_review AND clinician_reviewed_by IS NULL)"


@query("patient_summary", TREND_SQL + f""",
d AS ({_DOCS}), e AS ({_ENTS}), ins AS ({_INS})
SELECT c.c_custkey AS patient_id,
  (SELECT count(*) FROM d WHERE d.patient_id = c.c_custkey) AS document_count,
  (SELECT count(*) FROM e WHERE e.patient_id = c.c_custkey AND entity_type = 'medication') AS active_medications,
  (SELECT count(DISTINCT metric_name) FROM tr WHERE tr.patient_id = c.c_custkey) AS tracked_metrics,
  (SELECT count(*) FROM ins WHERE ins.patient_id = c.c_custkey AND {_PENDING}) AS pending_reviews
FROM customer c""")
def patient_summary(i: Inputs) -> DataFrame:
    return reports.patient_summary(
        i.patients(), i.records(), i.entities(), trend_table(i), i.insights()
    )


@query("recent_insights", f"""
WITH ins AS ({_INS}), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, insight_id DESC) AS rank FROM ins)
SELECT patient_id, rank, insight_id, coalesce(nullif(patient_facing_text, ''), nullif(final_text, ''), draft_text) AS patient_facing_text,
  coalesce(severity, 'informational') AS severity FROM r WHERE rank <= 3""")
def recent_insights(i: Inputs) -> DataFrame:
    return reports.recent_insights(i.insights())


@query("top_trends", TREND_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY reason IS NOT NULL DESC, metric_name, code) AS rank FROM tr)
SELECT patient_id, rank, metric_name, CASE metric_name WHEN 'eGFR' THEN 'Egfr' WHEN 'HbA1c' THEN 'Hba1c' ELSE metric_name END AS metric_display,
  direction, n AS data_point_count, reason IS NOT NULL AS is_clinically_significant FROM r WHERE rank <= 3""")
def top_trends(i: Inputs) -> DataFrame:
    return reports.top_trends(trend_table(i))


@query("recent_documents", f"""
WITH d AS ({_DOCS}), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY uploaded_at DESC, document_id DESC) AS rank FROM d)
SELECT patient_id, rank, document_id, filename, processing_status AS status, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at FROM r WHERE rank <= 5""")
def recent_documents(i: Inputs) -> DataFrame:
    return reports.recent_documents(i.records()).withColumn(
        "uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd")
    )


def _stored(i: Inputs) -> DataFrame:
    return i.entities().withColumnRenamed("temp_id", "id").withColumn(
        "confidence", F.coalesce("coding_confidence", "combined_confidence")
    )


@query("timeline", f"""
SELECT patient_id, CASE WHEN entity_date IS NULL THEN 'Unknown Date' ELSE strftime(entity_date, '%B %Y') END AS month, temp_id AS id,
  CASE WHEN entity_date IS NULL THEN 'Unknown' ELSE strftime(entity_date, '%d %b') END AS date, entity_type AS type,
  coalesce(entity_label, CASE entity_type WHEN 'lab_value' THEN 'Lab Value' WHEN 'vital_sign' THEN 'Vital Sign' WHEN 'medication' THEN 'Medication'
    WHEN 'diagnosis' THEN 'Diagnosis' ELSE 'Procedure' END) AS label,
  coalesce(normalized_value, raw_value) AS value, coalesce(unit_canonical, unit_raw, '') AS unit,
  round(coalesce(nullif(coalesce(coding_confidence, combined_confidence), 0), 0.8), 4) AS confidence FROM ({_ENTS}) e""")
def timeline(i: Inputs) -> DataFrame:
    return reports.timeline(_stored(i)).withColumn("confidence", F.round("confidence", 4))


@query("timeline_groups", f"""
SELECT patient_id, CASE WHEN entity_date IS NULL THEN 'Unknown Date' ELSE strftime(entity_date, '%B %Y') END AS month, count(*) AS event_count
FROM ({_ENTS}) e GROUP BY ALL""")
def timeline_groups(i: Inputs) -> DataFrame:
    return reports.timeline_groups(reports.timeline(_stored(i)))


@query("patient_trends", TREND_SQL + """
SELECT patient_id, metric_name, code AS metric_canonical_code, direction, FALSE AS monitoring_gap_detected,
  strftime(last_ts, '%Y-%m-%d') AS last_measurement_date FROM tr""")
def patient_trends(i: Inputs) -> DataFrame:
    from carefold.sources import tables

    return reports.stored_trends(tables.trend_rows(trend_table(i))).select(
        "patient_id", "metric_name", "metric_canonical_code", "direction", "monitoring_gap_detected",
        F.date_format("last_measurement_date", "yyyy-MM-dd").alias("last_measurement_date"),
    )


@query("patient_insights", f"""
SELECT patient_id, insight_id, coalesce(final_text, draft_text) AS final_text, coalesce(patient_facing_text, '') AS patient_facing_text,
  coalesce(clinician_facing_text, '') AS clinician_facing_text, coalesce(verification_status, 'pending') AS verification_status,
  round(coalesce(verification_confidence, 0.0), 4) AS verification_confidence, coalesce(verification_rationale, '') AS verification_rationale,
  coalesce(severity, 'informational') AS severity, coalesce(requires_clinician_review, FALSE) AS requires_clinician_review FROM ({_INS}) x""")
def patient_insights(i: Inputs) -> DataFrame:
    return reports.stored_insights(i.insights()).withColumn(
        "verification_confidence", F.round("verification_confidence", 4)
    )


_STEPS = values_sql(list(reports.PROGRESS), "status, progress_percentage, current_step")


@query("document_progress", f"""
WITH d AS ({_DOCS})
SELECT document_id, processing_status, coalesce(v.current_step, 'Unknown') AS current_step, coalesce(v.progress_percentage, 0) AS progress_percentage
FROM d LEFT JOIN {_STEPS} ON v.status = d.processing_status""")
def document_progress(i: Inputs) -> DataFrame:
    return reports.document_progress(i.records())


@query("document_page", f"""
WITH d AS ({_DOCS})
SELECT document_id, patient_id, (SELECT count(*) FROM d) AS total, 3 AS page, 25 AS size,
  CAST(ceil((SELECT count(*) FROM d) / 25) AS BIGINT) AS pages
FROM d ORDER BY uploaded_at DESC, document_id LIMIT 25 OFFSET 50""")
def document_page(i: Inputs) -> DataFrame:
    order = [F.col("uploaded_at").desc(), F.col("document_id")]
    return reports.page(i.records(), order, 3, 25).select(
        "document_id", "patient_id", "total", "page", "size", "pages"
    )


@query("deep_page", f"""
WITH d AS ({_DOCS}), r AS (SELECT document_id, patient_id, row_number() OVER (ORDER BY uploaded_at DESC, document_id) AS rank FROM d),
t AS (SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM d)
SELECT document_id, patient_id, rank, total, CAST(greatest(pages - 1, 1) AS INTEGER) AS page, pages FROM r, t
WHERE rank > (greatest(pages - 1, 1) - 1) * 25 AND rank <= greatest(pages - 1, 1) * 25""")
def deep_page(i: Inputs) -> DataFrame:
    """The last page but one, from an index that is built over all documents and read where the page lies."""
    records = i.records()
    index = RankIndex.build(
        records, f"{shared_folder(i.spark)}/rank-index-{uuid.uuid4().hex}", [F.col("uploaded_at").desc(), F.col("document_id")], range_rows=500
    )
    pages = -(-records.count() // 25)
    return index.page(max(pages - 1, 1), 25).select("document_id", "patient_id", F.col("rank").cast("long").alias("rank"), "total", "page", "pages")


@query("filtered_entities", f"""
SELECT temp_id FROM ({_ENTS}) e WHERE entity_date >= TIMESTAMP '1997-01-01' AND entity_date <= TIMESTAMP '1999-06-30'
  AND entity_type IN ('medication', 'diagnosis') AND contains(lower(raw_value), 'item 1') AND combined_confidence >= 0.5""")
def filtered_entities(i: Inputs) -> DataFrame:
    found = reports.filter_entities(
        i.entities().withColumn("confidence", F.col("combined_confidence")),
        "1997-01-01", "1999-06-30", ["medication", "diagnosis"], None, "Item 1", 0.5,
    )
    return found.select("temp_id")


@query("review_queue", f"""
WITH w AS (SELECT *, {_RANK} AS priority FROM ({_INS}) x WHERE {_PENDING})
SELECT patient_id, insight_id, severity, priority,
  CAST(sum(CASE WHEN priority >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id) AS BIGINT) AS urgent_count FROM w""")
def review_queue(i: Inputs) -> DataFrame:
    return reports.review_queue(i.insights()).drop("created_at")


_ACTIONS = {
    "insight_id": "l_orderkey",
    "action_id": "CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) || '-' || CAST(l_quantity AS string)",
    "action": "CASE l_linenumber % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'modified' END",
    "modified_text": "CASE WHEN l_linenumber % 2 = 0 THEN 'Changed ' || CAST(l_partkey AS string) END",
    "reviewer": "'r' || CAST(l_suppkey % 9 AS string)",
    "acted_at": "l_shipdate",
}


@query("applied_reviews", f"""
WITH ins AS ({_INS}), act AS ({sql_select(_ACTIONS, 'lineitem')}),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY acted_at DESC, action_id DESC) AS rn FROM act) x WHERE rn = 1)
SELECT ins.patient_id, ins.insight_id,
  coalesce(CASE WHEN action = 'modified' THEN modified_text END, final_text) AS final_text,
  coalesce(action, verification_status) AS verification_status, reviewer AS clinician_reviewed_by,
  requires_clinician_review AND action IS NULL AS still_pending
FROM ins LEFT JOIN la ON la.insight_id = ins.insight_id""")
def applied_reviews(i: Inputs) -> DataFrame:
    return reports.apply_reviews(i.insights(), i.derive("lineitem", _ACTIONS)).drop(
        "clinician_reviewed_at"
    )


_CORRECTIONS = {
    "correction_id": "CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) "
                     "|| '-' || CAST(l_suppkey AS string) || '-' || CAST(l_quantity AS string)",
    "entity_id": "CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) "
                 "|| '-' || CAST(l_suppkey AS string) || '-' || CAST(l_quantity AS string)",
    "patient_id": "l_suppkey",
    "correction_type": "CASE l_linenumber % 3 WHEN 0 THEN 'ocr_error' WHEN 1 THEN 'unit_error' ELSE 'date_error' END",
    "original_value": "CAST(l_quantity AS string)",
    "suggested_correction": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity + 1 AS string) END",
}
_RESOLUTIONS = {
    "correction_id": _CORRECTIONS["correction_id"],
    "status": "CASE WHEN l_tax > 0.05e0 THEN 'corrected' ELSE 'dismissed' END",
    "resolved_at": "l_shipdate",
    "resolution_notes": "'checked'",
}


@query("correction_queue", f"""
WITH c AS ({sql_select(_CORRECTIONS, 'lineitem')} WHERE l_discount > 0.05),
r AS ({sql_select(_RESOLUTIONS, 'lineitem')} WHERE l_tax > 0.03), e AS ({_ENTS})
SELECT c.correction_id, c.patient_id, c.correction_type, c.original_value, c.suggested_correction, e.entity_label,
  coalesce(r.status, 'pending') AS status, strftime(r.resolved_at, '%Y-%m-%d') AS resolved_at
FROM c LEFT JOIN r ON r.correction_id = c.correction_id LEFT JOIN e ON e.temp_id = c.entity_id""")
def correction_queue(i: Inputs) -> DataFrame:
    items = i.table("lineitem").filter("l_discount > 0.05e0").selectExpr(
        *[f"{v} AS {k}" for k, v in _CORRECTIONS.items()]
    )
    resolved = i.table("lineitem").filter("l_tax > 0.03e0").selectExpr(
        *[f"{v} AS {k}" for k, v in _RESOLUTIONS.items()]
    )
    return reports.correction_queue(items, resolved, _stored(i)).select(
        "correction_id", "patient_id", "correction_type", "original_value", "suggested_correction",
        "entity_label", "status", F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved_at"),
    )


@query("audit_events", f"""
SELECT event_id, sha256({framed('event_id', 'props')}) AS input_hash, sha256({framed('value')}) AS output_hash,
  event_id % 900 AS duration_ms, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status FROM events""")
def audit_events(i: Inputs) -> DataFrame:
    return _audit(i).select(
        F.col("document_id").alias("event_id"), "input_hash", "output_hash", "duration_ms", "status"
    )


def _audit(i: Inputs) -> DataFrame:
    steps = i.table("events").select(
        F.col("event_id").alias("document_id"), F.col("user_id").alias("patient_id"),
        F.col("event_type").alias("agent_name"), F.lit("run").alias("action"),
        "event_id", "props", "value", F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 900) * 1000).alias("ended_at"),
        F.when(F.col("event_type") == "error", "step failed").alias("error_message"),
    )
    return reports.audit_events(steps, ["event_id", "props"], ["value"])


@query("audit_summary", """
SELECT event_type AS agent_name, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, count(*) AS event_count,
  round(avg(event_id % 900), 4) AS mean_duration_ms FROM events GROUP BY ALL""")
def audit_summary(i: Inputs) -> DataFrame:
    return reports.audit_summary(_audit(i)).select(
        "agent_name", "status", "event_count", F.round("mean_duration_ms", 4).alias("mean_duration_ms")
    )


@query("patient_directory", f"""
WITH d AS (SELECT patient_id, count(*) AS n, max(uploaded_at) AS last FROM ({_DOCS}) x GROUP BY patient_id),
ins AS (SELECT patient_id, count(*) FILTER (WHERE coalesce(verification_status, 'pending') <> 'rejected') AS active,
  count(*) FILTER (WHERE {_PENDING}) AS pending FROM ({_INS}) y GROUP BY patient_id)
SELECT c.c_custkey AS patient_id, c.c_name AS full_name, coalesce(d.n, 0) AS document_count, strftime(d.last, '%Y-%m-%d') AS last_upload_at,
  coalesce(ins.active, 0) AS active_insight_count, coalesce(ins.pending, 0) AS pending_review_count
FROM customer c LEFT JOIN d ON d.patient_id = c.c_custkey LEFT JOIN ins ON ins.patient_id = c.c_custkey""")
def patient_directory(i: Inputs) -> DataFrame:
    return reports.patient_directory(i.patients(), i.records(), i.insights()).withColumn(
        "last_upload_at", F.date_format("last_upload_at", "yyyy-MM-dd")
    )


@query("patient_documents", f"SELECT patient_id, document_id, filename, document_type, processing_status, storage_path FROM ({_DOCS}) d")
def patient_documents(i: Inputs) -> DataFrame:
    return reports.patient_documents(i.records()).drop("uploaded_at")


@query("patient_state", TREND_SQL + f""",
a AS (SELECT patient_id, 'documents' AS section, count(*) AS items FROM ({_DOCS}) d GROUP BY ALL
  UNION ALL SELECT patient_id, 'entities', count(*) FROM ({_ENTS}) e GROUP BY ALL
  UNION ALL SELECT patient_id, 'trends', count(*) FROM tr GROUP BY ALL
  UNION ALL SELECT patient_id, 'insights', count(*) FROM ({_INS}) i GROUP BY ALL)
SELECT patient_id, section, items, CAST(ceil(items / 50) AS INTEGER) AS page_count FROM a""")
def patient_state(i: Inputs) -> DataFrame:
    """Pages of a patient's snapshot put together again by section."""
    pages = reports.patient_state(i.records(), _stored(i), trend_table(i), i.insights(), page_rows=50)
    return pages.groupBy("patient_id", "section").agg(
        F.sum(F.size("items")).alias("items"), F.max("page_count").alias("page_count")
    )
