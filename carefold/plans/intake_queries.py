"""Registration and triage queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.functions.ids import entity_uuid
from carefold.operators import triage
from carefold.plans.inputs import DOCUMENTS, ENTITIES, PAGE_FILES, Inputs, sql_select
from carefold.plans.registry import framed, query
from carefold.session import shared_folder
from carefold.sources import documents, snapshots, tables

_FILES = f"SELECT *, octet_length(encode(html)) AS length FROM ({sql_select(PAGE_FILES, 'pages')}) f"


@query("registered_documents", f"""
WITH p AS (SELECT page_id, CAST(page_id % 50 AS VARCHAR) AS patient_id, 'page_' || CAST(page_id AS VARCHAR) || '.html' AS filename,
  octet_length(encode(html)) AS length FROM pages)
SELECT md5({framed("'s3://intake/' || patient_id || '/' || filename")}) AS document_id, patient_id, filename,
  's3://intake/' || patient_id || '/' || filename AS storage_path, 'unknown' AS document_type, 'queued' AS processing_status, length FROM p""")
def registered_documents(i: Inputs) -> DataFrame:
    files = i.table("pages").select(
        F.concat(F.lit("file:/in/page_"), "page_id", F.lit(".html")).alias("path"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.octet_length("html").cast("long").alias("length"),
        (F.col("page_id") % 50).alias("pid"),
    )
    return documents.register_documents(files, "intake", F.col("pid")).drop("uploaded_at")


@query("storage_paths", f"""
SELECT document_id, CASE WHEN starts_with(storage_path, 's3://') THEN split_part(substr(storage_path, 6), '/', 1) ELSE 'documents' END AS bucket,
  CASE WHEN starts_with(storage_path, 's3://') THEN substr(storage_path, 6 + length(split_part(substr(storage_path, 6), '/', 1)) + 1) ELSE storage_path END AS key
FROM ({_FILES}) f""")
def storage_paths(i: Inputs) -> DataFrame:
    parsed = documents.parse_storage_path(F.col("storage_path"), "documents")
    return i.files().select("document_id", parsed.alias("p")).select("document_id", "p.*")


_SIZE = ("CASE WHEN length < 1000 THEN 'corrupt_or_too_small' WHEN length > 26214400 THEN 'file_too_large' END")
_MIME = ("CASE WHEN starts_with(m, '25504446') THEN 'application/pdf' WHEN starts_with(m, 'FFD8FF') THEN 'image/jpeg' "
         "WHEN starts_with(m, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(m, '49492A00') THEN 'image/tiff' "
         "WHEN starts_with(m, '424D') THEN 'image/bmp' WHEN regexp_matches(m, '^52494646.{8}57454250') THEN 'image/webp' "
         "ELSE 'application/octet-stream' END")
_HAND = ("(coalesce(lower(declared_type) = 'handwritten', FALSE) OR regexp_matches(lower(filename), "
         "'handwritten|handwriting|note|script|scribble'))")
_REASON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in triage.REASONS.items())
TRIAGE_SQL = f"""
WITH f AS (SELECT *, {_SIZE} AS size_flag, magic || hex(encode(html[1:12])) AS m FROM ({_FILES}) x),
q AS (SELECT *, CASE WHEN size_flag IS NOT NULL THEN 'unknown' ELSE {_MIME} END AS mime,
  least(height, width) < 500 AS small, blur_variance < 80 AS blurred, brightness < 50 AS dark, brightness > 245 AS bright, abs(skew_degrees) > 5 AS turned,
  {_HAND} AS hand FROM f),
s AS (SELECT *, greatest(0.0, least(1.0, 1.0 - CASE WHEN small THEN 0.45 ELSE 0 END
    - CASE WHEN blurred THEN 0.4 * least(1.0, (80 - blur_variance) / 80) ELSE 0 END
    - CASE WHEN dark THEN 0.25 WHEN bright THEN 0.15 ELSE 0 END - CASE WHEN turned THEN 0.1 ELSE 0 END))::DOUBLE AS score,
  concat_ws(',', CASE WHEN small THEN 'low_resolution' END, CASE WHEN blurred THEN 'blurry' END,
    CASE WHEN dark THEN 'too_dark' WHEN bright THEN 'overexposed' END, CASE WHEN turned THEN 'skewed' END) AS flags FROM q),
v AS (SELECT *, CASE WHEN size_flag IS NOT NULL THEN size_flag
    WHEN mime = 'application/octet-stream' THEN 'unsupported_mime_type'
    WHEN mime = 'application/pdf' THEN CASE WHEN pdf_status = 'corrupt' THEN 'corrupt_pdf' WHEN pdf_status = 'encrypted' THEN 'encrypted_undecryptable'
      WHEN page_count = 0 THEN 'empty_pdf' WHEN mean_chars >= 40 THEN 'typed' WHEN pdf_status = 'unrenderable' THEN 'unrenderable_pdf' ELSE 'scanned' END
    WHEN height IS NULL THEN 'undecodable_image' ELSE 'scanned' END AS verdict FROM s),
r AS (SELECT *, CASE WHEN verdict = 'typed' THEN 'typed_pdf' WHEN verdict = 'scanned' THEN CASE WHEN hand THEN 'handwritten' ELSE 'scanned_image' END ELSE 'unknown' END AS kind,
  CASE WHEN verdict = 'typed' THEN 0.98 WHEN verdict = 'scanned' THEN score WHEN verdict = 'unrenderable_pdf' THEN 0.2 ELSE 0.0 END::DOUBLE AS final_score,
  CASE WHEN verdict = 'typed' THEN '' WHEN verdict = 'scanned' THEN flags ELSE verdict END AS final_flags FROM v),
t AS (SELECT *, CASE WHEN final_score < 0.5 OR kind = 'unknown' THEN 'reject' WHEN kind = 'handwritten' THEN 'handwriting_ocr' ELSE 'ocr' END AS routing FROM r),
u AS (SELECT *, CASE WHEN routing = 'reject' THEN CASE WHEN final_flags = '' THEN 'The quality score ' || printf('%.2f', final_score) || ' is below 0.5.'
  ELSE array_to_string(list_transform(string_split(final_flags, ','), lambda x: CASE x {_REASON} END), ' ') END END AS reason FROM t)
"""


@query("size_gate", TRIAGE_SQL + "SELECT document_id, size_flag FROM u")
def size_gate(i: Inputs) -> DataFrame:
    return i.files().select("document_id", triage.size_flag(F.col("length")).alias("size_flag"))


@query("mime_types", TRIAGE_SQL + f"SELECT document_id, {_MIME} AS mime FROM u")
def mime_types(i: Inputs) -> DataFrame:
    return i.files().select("document_id", triage.mime_type(F.col("content")).alias("mime"))


@query("typed_text_layer", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, round(avg(length(trim(line, ' ' || chr(9) || chr(10) || chr(13)))), 4) AS mean_chars,
  avg(length(trim(line, ' ' || chr(9) || chr(10) || chr(13)))) >= 40 AS is_typed FROM l WHERE page <= 3 GROUP BY doc_id""")
def typed_text_layer(i: Inputs) -> DataFrame:
    pages = i.texts().select("document_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    found = triage.text_layer(pages.withColumn("page", F.col("p") + 1))
    return found.select("document_id", F.round("mean_chars", 4).alias("mean_chars"), "is_typed")


@query("quality_scores", TRIAGE_SQL + "SELECT document_id, round(score, 4) AS score, flags FROM u")
def quality_scores(i: Inputs) -> DataFrame:
    measured = triage.quality(
        F.col("height"), F.col("width"), F.col("blur_variance"), F.col("brightness"), F.col("skew_degrees")
    )
    return i.files().withColumn("q", measured).select(
        "document_id", F.round("q.score", 4).alias("score"), F.array_join("q.flags", ",").alias("flags")
    )


@query("handwriting_hints", TRIAGE_SQL + "SELECT document_id, hand AS handwritten FROM u")
def handwriting_hints(i: Inputs) -> DataFrame:
    hint = triage.looks_handwritten(F.col("filename"), F.col("declared_type"))
    return i.files().select("document_id", hint.alias("handwritten"))


@query("triage_envelopes", TRIAGE_SQL + """
SELECT document_id, kind AS document_type, round(final_score, 4) AS quality_score, final_flags AS quality_flags, routing,
  reason AS rejection_reason, mime AS detected_mime_type FROM u""")
def triage_envelopes(i: Inputs) -> DataFrame:
    return triage.triage(i.files()).select(
        "document_id", "document_type", "quality_score",
        F.array_join("quality_flags", ",").alias("quality_flags"), "routing", "rejection_reason",
        F.element_at("metadata", "detected_mime_type").alias("detected_mime_type"),
    )


@query("rejections", TRIAGE_SQL + "SELECT reason AS rejection_reason, count(*) AS documents FROM u WHERE routing = 'reject' GROUP BY reason")
def rejections(i: Inputs) -> DataFrame:
    return triage.triage(i.files()).filter("routing = 'reject'").groupBy("rejection_reason").agg(
        F.count("*").alias("documents")
    )


@query("routing_counts", TRIAGE_SQL + "SELECT kind AS document_type, routing, count(*) AS documents FROM u GROUP BY ALL")
def routing_counts(i: Inputs) -> DataFrame:
    return triage.triage(i.files()).groupBy("document_type", "routing").agg(
        F.count("*").alias("documents")
    )


@query("pdf_failures", TRIAGE_SQL + "SELECT document_id, kind AS document_type, final_flags AS flags FROM u WHERE mime = 'application/pdf'")
def pdf_failures(i: Inputs) -> DataFrame:
    return (
        triage.triage(i.files())
        .filter(F.element_at("metadata", "detected_mime_type") == "application/pdf")
        .select("document_id", "document_type", F.array_join("quality_flags", ",").alias("flags"))
    )


@query("page_quality_labels", f"""
SELECT document_id, CASE WHEN least(height, width) < 600 THEN 'too_small' WHEN blur_variance < 100 THEN 'blurry'
  WHEN brightness < 60 THEN 'too_dark' ELSE 'ok' END AS label FROM ({_FILES}) f""")
def page_quality_labels(i: Inputs) -> DataFrame:
    label = triage.page_quality_label(
        F.col("height"), F.col("width"), F.col("blur_variance"), F.col("brightness")
    )
    return i.files().select("document_id", label.alias("label"))


# --------------------------------------------------------------------------- persisted tables
@query("document_statuses", """
WITH log AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_shipdate AS changed_at,
  CASE l_linestatus WHEN 'F' THEN CASE WHEN l_tax > 0.04 THEN 'complete' ELSE 'failed' END ELSE 'ner' END AS status,
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS log_id
  FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY changed_at DESC, log_id DESC) AS rn FROM log)
SELECT document_id, status AS processing_status,
  CASE WHEN status IN ('complete', 'failed') THEN strftime(changed_at, '%Y-%m-%d') END AS processed_at FROM r WHERE rn = 1""")
def document_statuses(i: Inputs) -> DataFrame:
    log = i.table("lineitem").selectExpr(
        "CAST(l_orderkey AS string) AS document_id", "l_shipdate AS changed_at",
        "CASE l_linestatus WHEN 'F' THEN CASE WHEN l_tax > 0.04e0 THEN 'complete' ELSE 'failed' END ELSE 'ner' END AS status",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS log_id",
    )
    return tables.latest_status(log).withColumn(
        "processed_at", F.date_format("processed_at", "yyyy-MM-dd")
    )


@query("deleted_documents", """
SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS remaining, count(*) FILTER (WHERE o_orderstatus = 'P') AS deleted_count FROM orders""")
def deleted_documents(i: Inputs) -> DataFrame:
    docs = i.records()
    gone = docs.filter("processing_status = 'trend_analysis'")
    left, removed = tables.delete_documents(docs, gone)
    return left.agg(F.count("*").alias("remaining")).join(F.broadcast(removed))


_DOCS = sql_select(DOCUMENTS, "orders")
_ENTS = sql_select(ENTITIES, "lineitem")


@query("stored_entities", f"""
WITH e AS ({_ENTS}), d AS ({_DOCS})
SELECT e.temp_id, e.normalized_value, e.canonical_code, round(coalesce(e.coding_confidence, e.combined_confidence), 4) AS confidence,
  strftime(coalesce(e.entity_date, d.document_date, d.uploaded_at), '%Y-%m-%d') AS entity_date, 'unverified' AS verification_status
FROM e LEFT JOIN d ON d.document_id = e.document_id""")
def stored_entities(i: Inputs) -> DataFrame:
    """Rows as persisted; the id is tied back to the temp id beside it for the comparison."""
    e = i.entities()
    plain = e.select(
        "document_id", "patient_id", "temp_id", "entity_type", "raw_value", "entity_label",
        "unit_raw", "entity_date", "source_span_start", "source_span_end", "ocr_confidence",
        "ner_confidence", "combined_confidence", "is_negated", "assertion_status",
    )
    rows = tables.clinical_entities(plain, e, i.records())
    tied = rows.filter(F.col("id") == entity_uuid(F.col("document_id"), F.col("temp_id")))
    return tied.select(
        "temp_id", "normalized_value", "canonical_code", F.round("confidence", 4).alias("confidence"),
        F.date_format("entity_date", "yyyy-MM-dd").alias("entity_date"), "verification_status",
    )


@query("upserted_vectors", """
SELECT vec_id AS passage_id, CASE WHEN label % 2 = 0 THEN label + 100 ELSE label END AS label,
  round(CAST(embedding[1] AS DOUBLE) * CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END, 5) AS first_value FROM embeddings""")
def upserted_vectors(i: Inputs) -> DataFrame:
    stored = i.table("embeddings").withColumnRenamed("vec_id", "passage_id").withColumn(
        "embedding", F.col("embedding").cast("array<double>")
    )
    new = stored.filter("label % 2 = 0").withColumn("label", F.col("label") + 100).withColumn(
        "embedding", F.transform("embedding", lambda x: x * 2)
    )
    return tables.upsert_vectors(stored, new).select(
        "passage_id", "label", F.round(F.col("embedding")[0], 5).alias("first_value")
    )


_VERSIONS = ("SELECT o_orderkey, 1 AS version FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 4 = 0 "
             "UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 6 = 0")


@query("snapshot_merges", f"""
WITH v AS ({_VERSIONS})
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(max(version) AS INTEGER) AS version, 'status ' || max(version) AS processing_status, 2 AS tables
FROM v WHERE o_orderkey % 10 <> 0 GROUP BY o_orderkey""")
def snapshot_merges(i: Inputs) -> DataFrame:
    """Documents whose versions are merged in three batches, once by version and once mixed, then deleted by key.

    Every batch is merged a second time under its mark, as after a failure. ``tables`` counts the two tables a row is in.
    """
    orders = i.table("orders").select("o_orderkey")
    versions = reduce(DataFrame.unionAll, [
        orders.filter(f"{each} = 1 OR o_orderkey % {every} = 0").select("o_orderkey", F.lit(each).alias("version")) for each, every in ((1, 1), (2, 4), (3, 6))
    ])
    rows = versions.select(
        F.col("o_orderkey").cast("string").alias("document_id"), "version", F.concat(F.lit("status "), F.col("version")).alias("processing_status"),
        (F.col("version") - 1).alias("by_version"), F.pmod(F.col("o_orderkey") + F.col("version"), F.lit(3)).alias("mixed"),
    )
    gone = rows.filter(F.col("document_id").cast("long") % 10 == 0).select("document_id").distinct()
    plain = rows.drop("by_version", "mixed")
    buckets = max(8, -(-orders.count() // snapshots.BUCKET_ROWS))
    merged = []
    for split in ("by_version", "mixed"):
        table = snapshots.SnapshotTable.create(
            i.spark, f"{shared_folder(i.spark)}/snapshots-{uuid.uuid4().hex}", plain.schema, ["document_id"], buckets
        )
        for k in (0, 1, 2):
            batch = rows.filter(F.col(split) == k).drop("by_version", "mixed")
            for _ in range(2):
                table.upsert(batch, order="version", mark=("intake", k))
        table.delete(gone)
        merged.append(table.read())
    return merged[0].unionByName(merged[1]).groupBy("document_id", "version", "processing_status").agg(F.count("*").cast("int").alias("tables"))


@query("patient_vectors", """
SELECT vec_id % 5 AS patient, count(*) AS vectors, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first_sum FROM embeddings GROUP BY ALL""")
def patient_vectors(i: Inputs) -> DataFrame:
    """Vectors stored by bucket of the patient and read back one patient at a time, each from one bucket."""
    vectors = i.table("embeddings").select(
        F.col("vec_id").alias("passage_id"), F.concat(F.lit("p"), F.col("vec_id") % 5).alias("patient_id"), "embedding"
    )
    path = f"{shared_folder(i.spark)}/patient-vectors-{uuid.uuid4().hex}"
    tables.write_patient_vectors(vectors, path, buckets=16)
    read = [
        tables.read_patient_vectors(i.spark, path, f"p{k}", buckets=16).select(F.lit(k).cast("long").alias("patient"), "embedding") for k in range(5)
    ]
    return reduce(DataFrame.unionAll, read).groupBy("patient").agg(
        F.count("*").alias("vectors"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first_sum")
    )
