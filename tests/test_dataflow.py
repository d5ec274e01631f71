"""One report from spans to evidence, lazily and with stored steps."""

from pyspark.sql import functions as F

from carefold.operators.entities import Dictionary
from carefold.plans import dataflow
from carefold.sources import knowledge, tables

LINES = [
    "Patient Name: Anna Berg", "MRN: 90817263", "HbA1c: 7.9 %", "Creatinine 1.6 mg/dL", "eGFR: 41 mL/min/1.73m2",
    "Known type 2 diabetes. No hypertension.", "Metformin 850mg BID",
]


def test_report(spark, tmp_path):
    rows = [(f"d{p}", f"p{p}", k, t, 0.9) for p in (1, 2) for k, t in enumerate(LINES)]
    spans = spark.createDataFrame(rows, "document_id string, patient_id string, span_pos int, text string, confidence double")
    as_of = F.lit("2024-06-01").cast("timestamp")
    encode = dataflow.hashed_encoder()
    passages = dataflow.embedded_passages(
        knowledge.guideline_passages(knowledge.builtin_guidelines(spark)), encode)
    history = spark.createDataFrame(
        [("p1", "2160-0", f"h{k}", "old", v, "mg/dL", f"2024-0{k}-01", 0.97, 0.6, 1.3) for k, v in ((1, "0.9"), (2, "1.2"), (3, "1.4"))],
        "patient_id string, canonical_code string, id string, document_id string, normalized_value string, unit_canonical string, "
        "d string, confidence double, reference_range_low double, reference_range_high double",
    ).withColumn("entity_date", F.col("d").cast("timestamp")).drop("d")
    args = (spans, Dictionary.builtin(), knowledge.builtin_bands(spark), knowledge.builtin_metrics(spark), as_of)
    stored = dataflow.process_spans(*args, history=history, passages=passages, encode=encode, folder=str(tmp_path))
    assert "Anna Berg" not in " ".join(r.text for r in stored["masked"].collect())
    assert {r.entity_label for r in stored["entities"].filter("patient_id = 'p1'").collect()} == {
        "HbA1c", "Creatinine", "eGFR", "Type 2 Diabetes", "Hypertension", "Metformin"}
    trend = {(r.patient_id, r.code): r for r in stored["trends"].collect()}
    kidney = trend[("p1", "2160-0")]
    assert (kidney.data_point_count, kidney.direction, kidney.clinical_trend) == (4, "increasing", "worsening")
    assert kidney.crossing_count == 1 and trend[("p2", "2160-0")].direction == "insufficient_data"
    assert stored["queries"].groupBy("patient_id").count().agg(F.max("count")).first()[0] == 6
    block = {r.patient_id: r.evidence_block for r in stored["evidence_blocks"].collect()}["p1"]
    assert "Creatinine: 1.6 mg/dL" in block and "Creatinine trend: increasing" in block
    lazy = dataflow.process_spans(*args, history=history, passages=passages, encode=encode)
    for name in ("coded",):
        assert {str(r) for r in lazy[name].collect()} == {str(r) for r in stored[name].collect()}
    rows = tables.clinical_entities(
        stored["entities"], stored["coded"],
        spans.select("document_id").distinct().withColumn("document_date", F.lit(None).cast("timestamp")).withColumn("uploaded_at", as_of))
    assert rows.count() == 12 and rows.filter("entity_date IS NULL").count() == 0


def test_from_spans_to_stored_insights(spark, tmp_path):
    rows = [(f"d{p}", f"p{p}", k, t, 0.9) for p in (1, 2) for k, t in enumerate(LINES)] + [("d3", "p3", 0, "nothing to find", 0.9)]
    spans = spark.createDataFrame(rows, "document_id string, patient_id string, span_pos int, text string, confidence double")
    as_of = F.lit("2024-06-01").cast("timestamp")
    history = spark.createDataFrame(
        [("p1", "2160-0", f"h{k}", "old", v, "mg/dL", f"2024-0{k}-01", 0.97, 0.6, 1.3) for k, v in ((1, "0.9"), (2, "1.2"), (3, "1.4"))],
        "patient_id string, canonical_code string, id string, document_id string, normalized_value string, unit_canonical string, "
        "d string, confidence double, reference_range_low double, reference_range_high double",
    ).withColumn("entity_date", F.col("d").cast("timestamp")).drop("d")
    args = (spans, Dictionary.builtin(), knowledge.builtin_bands(spark), knowledge.builtin_metrics(spark), as_of)
    steps = dataflow.process_spans(*args, history=history, folder=str(tmp_path / "steps"))

    def generate(blocks):
        """One insight per trend line of the block, one that cites what is not there, and one without a text."""
        import re

        import pandas as pd

        out = []
        for r in blocks.itertuples():
            ids = [i for i in re.findall(r"^- \[([^]]+)\]", r.evidence_block, re.M) if i.startswith("trend-")]
            for pos, ids_ in enumerate([[i, "trend-none"] for i in ids] + [["trend-none"], ids]):
                text = "  " if pos == len(ids) + 1 else f"About {ids_[0]}"
                out.append((r.patient_id, r.run_id, pos, "trend", "high" if pos == 0 else "low", 0.9, ids_, text, f"Plain {ids_[0]}"))
        columns = ["patient_id", "run_id", "pos", "insight_type", "severity", "confidence", "evidence_ids", "clinician_facing_text", "patient_facing_text"]
        return pd.DataFrame(out, columns=columns)

    def check(drafts):
        """Every cited item is one claim; those on one code do not hold."""
        import pandas as pd

        out = [
            (r.draft_id, pos, f"Claim: {e['text'][:20]}", "718-7" not in e["evidence_id"] and "4548-4" not in e["evidence_id"], 0.95, [e["evidence_id"]], [])
            for r in drafts.itertuples() for pos, e in enumerate(r.evidence)
        ]
        return pd.DataFrame(out, columns=["draft_id", "pos", "assertion_text", "supported", "confidence", "supporting_evidence_ids", "contradicting_evidence_ids"])

    done = dataflow.conclude_runs(steps, spans, generate, check, folder=str(tmp_path / "done"))
    pool = {(r.patient_id, r.evidence_id) for r in steps["evidence"].collect()}
    trend_ids = {(p, e) for p, e in pool if e.startswith("trend-")}
    drafts = {(r.patient_id, r.supporting_evidence_ids[0]): r for r in done["drafts"].collect()}
    assert set(drafts) == trend_ids and all(len(r.supporting_evidence_ids) == 1 for r in drafts.values())
    verified = {r.draft_id: r for r in done["verified"].collect()}
    want = {r.draft_id for (p, e), r in drafts.items() if e not in ("trend-718-7", "trend-4548-4")}
    assert set(verified) == want and len(want) >= 3
    assert {r.draft_id for r in done["rejected"].collect()} == {r.draft_id for r in drafts.values()} - want
    assert all(r.assertions[0].verified and r.verification_status == "auto_verified" for r in verified.values())
    behind = {}
    for r in done["insight_entities"].collect():
        behind.setdefault(r.draft_id, set()).add(r.entity_id)
    points = {}
    for r in steps["observations"].collect():
        points.setdefault((r.patient_id, f"trend-{r.code}"), set()).add(r.entity_id)
    assert behind == {drafts[key].draft_id: points[key] for key in drafts if drafts[key].draft_id in want}
    assert {"h1", "h2", "h3"} < behind[drafts["p1", "trend-2160-0"].draft_id]
    stored = done["insight_rows"].collect()
    assert {r.insight_id for r in stored} == want and {r.verification_status for r in stored} == {"approved"}
    assert {r.document_id: r.processing_status for r in done["statuses"].collect()} == {"d1": "complete", "d2": "complete", "d3": "complete"}
