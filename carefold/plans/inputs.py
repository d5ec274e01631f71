"""Stand-in clinical tables derived from the driver's tables.

Each is a projection of one given table, written as SQL expressions that Spark
and any ANSI engine read alike, so the work of every query grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.session import spread

TIMESTAMPS = {"events": ["ts"], "orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}
AS_OF = "2024-06-09 00:00:00"

# events as observations
OBSERVATIONS = {
    "patient_id": "user_id",
    "code": "CASE event_type WHEN 'click' THEN '2160-0' WHEN 'view' THEN '33914-3' "
            "WHEN 'error' THEN '718-7' WHEN 'signup' THEN '4548-4' ELSE '6690-2' END",
    "entity_id": "CAST(event_id AS string)",
    "document_id": "CAST(event_id % 1000 AS string)",
    "value": "value",
    "unit": "CASE WHEN event_id % 3 = 0 THEN 'mg/dL' ELSE 'mmol/L' END",
    "ts": "ts",
    "confidence": "0.5e0 + (event_id % 53) / 113e0",
    "low": "CASE event_type WHEN 'click' THEN 10e0 WHEN 'error' THEN 5e0 "
           "WHEN 'signup' THEN 20e0 END",
    "high": "CASE event_type WHEN 'click' THEN 60e0 WHEN 'view' THEN 80e0 "
            "WHEN 'signup' THEN 120e0 END",
    "ord": "0",
}

# events as report lines: identifiers and clinical wording around the event's values
_V, _U, _E = "CAST(value AS string)", "CAST(user_id AS string)", "CAST(event_id AS string)"
_U4 = "lpad(CAST(user_id % 10000 AS string), 4, '0')"
_E4 = "lpad(CAST(event_id % 10000 AS string), 4, '0')"
NOTE_LINES = (
    f"'MRN: 10' || {_U4} || '7 Hemoglobin: ' || {_V} || ' g/dL'",
    f"'Patient Name: Anna Berg DOB: 12/05/1980 seen ' || {_E}",
    f"'Metformin ' || CAST(event_id % 10 * 100 + 100 AS string) || 'mg BD. Lisinopril 10mg OD.'",
    "'No hypertension noted. Family history of heart failure. Possible gout.'",
    f"'Call (555) 201-' || {_U4} || ' or mail user' || {_U} || '@example.org today'",
    f"'Hospital ID: HOSP-1' || {_U4} || ' / Patient ID: P-2' || {_U4} || ' /'",
    f"'Creatinine ' || {_V} || ' mg/dL, eGFR: ' || {_V} || ' mL/min/1.73m2'",
    f"'Aadhaar: 4211 6690 ' || {_U4} || ' and PAN ABCDE' || {_E4} || 'F filed'",
    f"'Seen by Dr. Kavita Rao, 45 Park Road, 45 years old, visit ' || {_E}",
    f"'HbA1c: ' || {_V} || ' %; glucose ' || {_V} || ' mmol/L'",
    f"'NPI 1234567890, SSN 123-45-' || {_U4} || ', Accession: AB' || {_E4} || 'CD'",
    "'Heart rate ' || CAST(60 + event_id % 60 AS string) || ' bpm. SBP 120 mmHg'",
    "'Atrial fibrillation was ruled out. If creatinine 9.9 rises, consider referral.'",
    "'Atorvastatin 40mg at night. Aspirin as needed. Warfarin was discontinued'",
    f"'K ' || {_V} || ' mEq/L, Na 140 mEq/L; LDL: 98 mg/dL. Temp 37.2'",
    f"'Routine visit ' || {_E} || ' without findings'",
)
NOTES = {
    "document_id": "CAST(user_id AS string)",
    "patient_id": "CAST(user_id AS string)",
    "span_pos": "CAST(event_id AS int)",
    "confidence": "0.6e0 + (event_id % 37) / 97e0",
    "text": "CASE event_id % 16 "
            + " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(NOTE_LINES)) + " END",
}

# Bytes of events for one task: about 200,000 lines, half a minute of extraction.
NOTE_TASK_BYTES = 4 << 20

# documents with a report line at their end
DOCUMENT_LINE = (
    NOTES["text"].replace("event_id", "doc_id").replace("user_id", "(doc_id % 150)")
    .replace(_V, "CAST(n_chars / 10e0 AS string)")
)

# conversations as ordered spans
SPANS = {
    "document_id": "CAST(conv_id AS string)",
    "patient_id": "CAST(conv_id % 40 AS string)",
    "span_pos": "CAST(turn AS int)",
    "confidence": "0.55e0 + ((conv_id * 7 + turn * 5) % 44) / 101e0",
    "text": "text",
}

# lineitem as coded entities
ENTITIES = {
    "document_id": "CAST(l_orderkey AS string)",
    "patient_id": "l_suppkey",
    "temp_id": "CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' "
               "|| CAST(l_partkey AS string) || '-' || CAST(l_suppkey AS string) || '-' || CAST(l_quantity AS string)",
    "entity_type": "CASE l_partkey % 5 WHEN 0 THEN 'lab_value' WHEN 1 THEN 'vital_sign' "
                   "WHEN 2 THEN 'medication' WHEN 3 THEN 'diagnosis' ELSE 'procedure' END",
    "raw_value": "CASE WHEN l_partkey % 5 < 2 THEN CAST(l_quantity AS string) "
                 "ELSE 'Item ' || CAST(l_partkey % 20 AS string) END",
    "entity_label": "CASE WHEN l_tax < 0.07e0 THEN 'Label ' || CAST(l_partkey % 7 AS string) END",
    "unit_raw": "CASE WHEN l_linenumber % 2 = 0 THEN 'mg/dl' END",
    "entity_date": "CASE WHEN l_linenumber <> 3 THEN l_shipdate END",
    "source_span_start": "CAST(l_linenumber * 40 AS int)",
    "source_span_end": "CAST(l_linenumber * 40 + 12 AS int)",
    "ocr_confidence": "0.5e0 + l_quantity / 100e0",
    "ner_confidence": "0.9e0",
    "combined_confidence": "0.4e0 + l_discount * 5",
    "is_negated": "l_discount = 0.05e0",
    "assertion_status": "CASE WHEN l_discount = 0.05e0 THEN 'absent' ELSE 'present' END",
    "canonical_code": "CASE WHEN l_returnflag <> 'N' THEN 'C-' || CAST(l_partkey % 11 AS string) END",
    "coding_system": "CASE WHEN l_returnflag <> 'N' THEN 'LOINC' END",
    "normalized_value": "CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_partkey % 5 < 2 "
                        "THEN CAST(l_quantity AS string) ELSE 'Item ' || CAST(l_partkey % 20 AS string) END",
    "unit_canonical": "CASE WHEN l_returnflag <> 'N' AND l_linenumber % 3 = 0 THEN 'mg/dL' END",
    "reference_range_low": "CASE WHEN l_returnflag <> 'N' AND l_linenumber % 4 = 1 THEN 4.5e0 END",
    "reference_range_high": "CASE WHEN l_returnflag <> 'N' AND l_linenumber % 4 = 1 THEN 30e0 END",
    "reference_range_unit": "CASE WHEN l_returnflag <> 'N' AND l_linenumber % 4 = 1 THEN 'mg/dL' END",
    "coding_confidence": "CASE WHEN l_returnflag <> 'N' THEN 0.97e0 END",
    "coding_method": "CASE WHEN l_returnflag <> 'N' THEN 'exact' END",
}

# orders as documents
DOCUMENTS = {
    "document_id": "CAST(o_orderkey AS string)",
    "patient_id": "o_custkey",
    "filename": "'order_' || CAST(o_orderkey AS string) || '.pdf'",
    "storage_path": "'s3://records/' || CAST(o_custkey AS string) || '/' || CAST(o_orderkey AS string)",
    "document_type": "CASE WHEN o_totalprice > 200000 THEN 'lab_report' ELSE 'typed_pdf' END",
    "processing_status": "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' "
                         "ELSE 'trend_analysis' END",
    "uploaded_at": "o_orderdate",
    "document_date": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END",
}

# orders as insights
INSIGHTS = {
    "insight_id": "o_orderkey",
    "patient_id": "o_custkey",
    "draft_text": "'Draft ' || o_orderpriority",
    "final_text": "CASE WHEN o_orderkey % 3 <> 0 THEN 'Final ' || o_orderpriority END",
    "patient_facing_text": "CASE WHEN o_orderkey % 5 = 0 THEN 'For you: ' || o_orderpriority END",
    "clinician_facing_text": "CASE WHEN o_orderkey % 4 <> 0 THEN 'Note ' || o_orderpriority END",
    "verification_status": "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' END",
    "verification_confidence": "CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100) / 100e0 END",
    "verification_rationale": "CASE WHEN o_orderkey % 2 = 0 THEN 'checked' END",
    "severity": "CASE o_orderkey % 6 WHEN 0 THEN 'informational' WHEN 1 THEN 'low' "
                "WHEN 2 THEN 'moderate' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' END",
    "requires_clinician_review": "o_orderkey % 6 IN (3, 4) OR o_orderstatus = 'P'",
    "clinician_reviewed_by": "CASE WHEN o_orderkey % 4 = 0 THEN 'reviewer' END",
    "created_at": "o_orderdate",
}

# pages as intake files with measured signals
PAGE_FILES = {
    "document_id": "CAST(page_id AS string)",
    "patient_id": "CAST(page_id % 50 AS string)",
    "filename": "CASE page_id % 9 WHEN 0 THEN 'handwritten_' WHEN 1 THEN 'Doctor_Note_' ELSE 'scan_' END "
                "|| CAST(page_id AS string)",
    "storage_path": "CASE WHEN page_id % 2 = 0 THEN 's3://intake/' || CAST(page_id AS string) || '/' || url "
                    "ELSE url END",
    "declared_type": "CASE WHEN page_id % 11 = 0 THEN 'Handwritten' WHEN page_id % 11 = 1 THEN 'typed' END",
    "magic": "CASE page_id % 8 WHEN 0 THEN '255044462D312E34' WHEN 1 THEN 'FFD8FFE000104A46' "
             "WHEN 2 THEN '89504E470D0A1A0A' WHEN 3 THEN '49492A0008000000' WHEN 4 THEN '424D36000000' "
             "WHEN 5 THEN '524946464F000000574542505650' WHEN 6 THEN '255044462D312E37' ELSE '' END",
    "html": "html",
    "pdf_status": "CASE page_id % 7 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'encrypted' "
                  "WHEN 2 THEN 'unrenderable' ELSE 'ok' END",
    "page_count": "CAST(page_id % 6 AS int)",
    "mean_chars": "CAST(page_id % 80 AS double)",
    "height": "CASE WHEN page_id % 13 <> 0 THEN CAST(300 + (page_id * 37) % 1500 AS int) END",
    "width": "CAST(400 + (page_id * 53) % 1200 AS int)",
    "blur_variance": "((page_id * 29) % 200) * 1e0",
    "brightness": "((page_id * 17) % 260) * 1e0",
    "skew_degrees": "((page_id * 3) % 21 - 10) * 1e0",
}



def select_list(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def sql_select(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(select_list(columns))} FROM {table}"


class Inputs:
    """The driver's tables and the stand-ins over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for column in TIMESTAMPS.get(name, []):
            df = df.withColumn(column, F.col(column).cast("timestamp"))
        return df

    def derive(self, table: str, columns: dict[str, str]) -> DataFrame:
        return self.table(table).selectExpr(*select_list(columns))

    def observations(self) -> DataFrame:
        return self.derive("events", OBSERVATIONS)

    def notes(self) -> DataFrame:
        # a line is made where it is read: what is dealt out are the few columns of its event
        return spread(self.table("events").select("event_id", "user_id", "value"), NOTE_TASK_BYTES).selectExpr(*select_list(NOTES))

    def spans(self) -> DataFrame:
        return spread(self.derive("conversations", SPANS))

    def texts(self) -> DataFrame:
        return spread(
            self.table("documents").selectExpr("CAST(doc_id AS string) AS document_id", "text")
        )

    def reports(self) -> DataFrame:
        return spread(self.table("documents").selectExpr(
            "CAST(doc_id AS string) AS document_id", f"text || chr(10) || ({DOCUMENT_LINE}) AS text"
        ))

    def entities(self) -> DataFrame:
        return self.derive("lineitem", ENTITIES)

    def records(self) -> DataFrame:
        return self.derive("orders", DOCUMENTS)

    def insights(self) -> DataFrame:
        return self.derive("orders", INSIGHTS)

    def patients(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS patient_id", "c_name AS full_name")

    def files(self) -> DataFrame:
        df = self.derive("pages", PAGE_FILES)
        return df.withColumn("length", F.octet_length("html").cast("long")).withColumn(
            "content", F.concat(F.unhex("magic"), F.encode("html", "UTF-8"))
        )

    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")
