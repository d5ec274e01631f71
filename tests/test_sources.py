"""Knowledge files, stored tables, triage and text assembly."""

import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from carefold.functions.ids import stable_key
from carefold.operators import layout, reports, triage
from carefold.session import shared_folder
from carefold.sources import documents, knowledge, tables


def write(path, content):
    path.write_text(json.dumps(content), encoding="utf-8")
    return str(path)


def test_ontology_files(spark, tmp_path):
    labs = write(tmp_path / "l.json", {"loinc_codes": {
        "Iron": {"code": "1-1", "display": "Iron", "unit_canonical": "ug/dL", "aliases": ["Fe", "serum iron"]},
        "Ferritin": {"code": "2-2", "display": "Ferritin", "aliases": ["fe"]}}})
    drugs = write(tmp_path / "d.json", {"rxnorm_codes": {"Drug": {"code": "9", "display": "Drug", "drug_class": "X", "aliases": []}}})
    ontology = knowledge.load_ontology(spark, labs, drugs)
    assert {(r.domain, r.ordinal, r.key, r.drug_class) for r in ontology.collect()} == {
        ("lab", 0, "Iron", None), ("lab", 1, "Ferritin", None), ("medication", 0, "Drug", "X")}
    names = {(r.form, r.alias): r.key for r in knowledge.build_aliases(ontology).collect()}
    assert names[("exact", "Fe")] == "Iron" and names[("exact", "fe")] == "Ferritin"
    assert names[("lower", "fe")] == "Ferritin"  # defined last
    assert knowledge.load_ontology(spark, str(tmp_path / "none.json"), drugs).count() == 1


def test_range_and_guideline_files(spark, tmp_path):
    path = write(tmp_path / "r.json", {
        "reference_ranges": {"c": {"unit": "u", "ranges": [
            {"sex": "any", "age_min": 0, "age_max": 9, "low": 1, "high": 2.5},
            {"sex": "M", "age_min": 10, "age_max": 99, "low": 2, "high": 3, "interpretation": "Normal"}]}},
        "unit_conversions": {"t": {"F_to_C": "formula:(F-32)*5/9", "C_to_F": "formula:C*9/5+32"}, "g": {"a_to_b": 2.5}}})
    assert [(r.band_pos, r.sex, r.high) for r in knowledge.load_reference_ranges(spark, path).orderBy("band_pos").collect()] == [
        (0, "any", 2.5), (1, "M", 3.0)]
    factors = {(r.from_unit, r.to_unit): (r.slope, r.offset) for r in knowledge.load_unit_factors(spark, path).collect()}
    assert factors[("F", "C")] == pytest.approx((5 / 9, -160 / 9)) and factors[("C", "F")] == (1.8, 32.0)
    assert factors[("a", "b")] == (2.5, 0.0)
    guide = write(tmp_path / "g.json", {
        "monitoring_guidelines": {"x": {"icd10_codes": ["A1"], "display_name": "X", "required_monitoring": [
            {"metric_code": "m", "metric_name": "M", "interval_days": 30, "interval_description": "monthly",
             "evidence_source": "s", "by_stage": {"G1": {"interval_days": 60}}}]}},
        "critical_value_rules": [{"metric_code": "m", "condition": "low", "threshold": 3, "unit": "u", "action": "a", "reason": "r"}]})
    (passage,) = knowledge.guideline_passages(knowledge.load_guidelines(spark, guide)).collect()
    assert passage.text == "Condition: X. Metric: M (LOINC: m). Interval: monthly. Source: s."
    assert knowledge.load_critical_rules(spark, guide).first().threshold == 3.0
    assert knowledge.load_stage_intervals(spark, guide).first().interval_days == 60


def test_files_are_registered(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4" + b"x" * 50)
    files = documents.scan_files(spark, str(tmp_path / "in"))
    (row,) = documents.register_documents(files, "b", F.lit("p7")).collect()
    assert (row.storage_path, row.filename, row.processing_status, row.length) == ("s3://b/p7/a.pdf", "a.pdf", "queued", 58)
    kinds = files.select(triage.mime_type(F.col("content")).alias("m")).collect()
    assert kinds[0].m == "application/pdf"


def test_patient_vectors_round_trip(spark, tmp_path):
    rows = [(k, f"p{k % 5}", [float(k), 1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "passage_id long, patient_id string, vector array<double>")
    path = str(tmp_path / "vectors")
    tables.write_patient_vectors(df, path, buckets=3, shards=2)
    one = tables.read_patient_vectors(spark, path, "p2", buckets=3)
    assert {r.passage_id for r in one.collect()} == {k for k in range(40) if k % 5 == 2}
    assert "PartitionFilters: [isnotnull(patient_bucket" in one._jdf.queryExecution().toString()


SIGNALS = ("document_id string, filename string, declared_type string, magic string, length long, pdf_status string, "
           "page_count int, mean_chars double, height int, width int, blur_variance double, brightness double, skew_degrees double")


def test_triage_cases(spark):
    png, pdf = "89504E470D0A1A0A", "255044462D312E34"
    good = (1600, 1200, 500.0, 200.0, 0.0)
    rows = [
        ("typed", "a.pdf", None, pdf, 5000, "ok", 1, 900.0, None, None, None, None, None),
        ("scan", "s.pdf", None, pdf, 5000, "ok", 2, 3.0, *good),
        ("declared", "x.png", "Handwritten", png, 5000, None, None, None, *good),
        ("named", "my_script.png", None, png, 5000, None, None, None, *good),
        ("tiny", "x.png", None, png, 10, None, None, None, *good),
        ("huge", "x.png", None, png, 26 * 1024 * 1024, None, None, None, *good),
        ("text", "x.txt", None, "48656C6C6F", 5000, None, None, None, *good),
        ("corrupt", "c.pdf", None, pdf, 5000, "corrupt", 0, None, *good),
        ("locked", "c.pdf", None, pdf, 5000, "encrypted", 3, None, *good),
        ("empty", "c.pdf", None, pdf, 5000, "ok", 0, None, *good),
        ("undrawn", "c.pdf", None, pdf, 5000, "unrenderable", 1, 2.0, *good),
        ("broken", "x.png", None, png, 5000, None, None, None, None, None, None, None, None),
        ("bad", "x.png", None, png, 5000, None, None, None, 200, 200, 0.0, 120.0, 0.0),
        ("soft", "x.png", None, png, 5000, None, None, None, 1600, 1200, 40.0, 200.0, -7.0),
    ]
    df = spark.createDataFrame(rows, SIGNALS).withColumn("content", F.unhex("magic")).withColumn(
        "patient_id", F.lit("p")).withColumn("storage_path", F.lit("s"))
    got = {r.document_id: (r.document_type, r.routing, r.quality_score, r.quality_flags) for r in triage.triage(df).collect()}
    assert got["typed"] == ("typed_pdf", "ocr", 0.98, [])
    assert got["scan"] == ("scanned_image", "ocr", 1.0, [])
    assert got["declared"][:2] == got["named"][:2] == ("handwritten", "handwriting_ocr")
    flags = {"tiny": "corrupt_or_too_small", "huge": "file_too_large", "text": "unsupported_mime_type", "corrupt": "corrupt_pdf",
             "locked": "encrypted_undecryptable", "empty": "empty_pdf", "undrawn": "unrenderable_pdf", "broken": "undecodable_image"}
    for name, flag in flags.items():
        assert got[name][0] == "unknown" and got[name][1] == "reject" and got[name][3] == [flag], name
    assert got["undrawn"][2] == 0.2
    assert got["bad"] == ("scanned_image", "reject", 0.15, ["low_resolution", "blurry"])
    assert got["soft"] == ("scanned_image", "ocr", 0.7, ["blurry", "skewed"])


def test_lines_from_word_boxes(spark):
    words = [("d", 1, k, 10.0 * (5 - k % 6), 20.0 * (k // 6) + (k % 2), 10.0 * (5 - k % 6) + 8, 20.0 * (k // 6) + 10, f"w{k}") for k in range(12)]
    short = [("e", 1, k, 0.0, 0.0, 1.0, 1.0, "x") for k in range(10)]
    df = spark.createDataFrame(words + short, "document_id string, page int, word_pos int, x0 double, y0 double, x1 double, y1 double, text string")
    (row,) = layout.rebuild_lines(df).collect()
    assert row.text == "w5 w4 w3 w2 w1 w0\nw11 w10 w9 w8 w7 w6"


def test_snapshot_pages_hold_everything(spark):
    docs = spark.createDataFrame([(1, f"d{k}", "f", "queued") for k in range(25)], "patient_id int, document_id string, filename string, processing_status string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    state = reports.patient_state(
        docs, none("patient_id int, id string, entity_type string, raw_value string"),
        none("patient_id int, code string, metric_name string, direction string"),
        none("patient_id int, insight_id string, severity string"), page_rows=10).collect()
    assert sorted(i for r in state for i in r["items"]) == sorted(
        '{"document_id":"d%d","filename":"f","processing_status":"queued"}' % k for k in range(25))
    assert all(r.page_count == 3 for r in state)


def test_one_shared_folder_for_a_session(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_missing_rules_are_an_error(spark, tmp_path):
    for load in (knowledge.load_critical_rules, knowledge.load_reference_ranges, knowledge.load_unit_factors, knowledge.load_guidelines):
        with pytest.raises(AnalysisException):
            load(spark, str(tmp_path / "none.json")).collect()


def test_keys_tell_their_parts_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("", "x"), ("-", "x")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(stable_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == len(rows)


def test_a_folder_of_documents_loads_like_one(spark):
    from carefold.plans import loader_queries
    from carefold.plans.inputs import Inputs

    inputs = Inputs(spark, "/root/testdata/sf0.001")
    content = "named_struct('critical_value_rules', collect_list(named_struct('metric_code', concat('C-', s_suppkey), 'condition', 'low')))"
    few, one = (
        knowledge.load_critical_rules(spark, loader_queries._folder(inputs, "supplier", "s_suppkey", content, rows)).select("metric_code", "condition")
        for rows in (3, 1_000_000)
    )
    assert sorted(few.collect()) == sorted(one.collect()) and one.count() == inputs.table("supplier").count()
    assert len(few.inputFiles()) > 1 and len(one.inputFiles()) == 1


def test_words_are_dealt_out_once_and_nulls_keep_their_places(spark):
    nan = float("nan")
    boxes = [  # word_pos, x0, y0, text
        (0, 9.0, 0.0, "b"), (1, 0.0, 0.0, "a"), (2, 0.0, 20.0, None), (3, 0.0, 40.0, "z"), (4, None, 40.0, "y"), (5, nan, 40.0, "last"),
        (6, 5.0, 40.0, None), (7, 0.0, None, "first\nline"), (None, 0.0, 60.0, ""), (8, 0.0, 60.0, "c"), (9, 0.0, nan, "end"),
    ]
    df = spark.createDataFrame(
        [("d", 1, k, x, y, 0.0, y, t) for k, x, y, t in boxes], "document_id string, page int, word_pos int, x0 double, y0 double, x1 double, y1 double, text string")
    lines = layout.rebuild_lines(df)
    (row,) = lines.collect()
    assert row.text == "first\nline\na b\n\ny z last\n c\nend" and row.line_count == 6
    plan = layout.rebuild_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="needs the driver's tables")
def test_stored_rows_keep_the_temp_id_beside_the_id(spark):
    from carefold.functions.ids import entity_uuid
    from carefold.plans import catalog
    from carefold.plans.inputs import Inputs

    kinds = "document_id string, patient_id string, temp_id string, entity_type string, raw_value string, entity_label string, unit_raw string, entity_date timestamp, " \
        "source_span_start int, source_span_end int, ocr_confidence double, ner_confidence double, combined_confidence double, is_negated boolean, assertion_status string"
    entities = spark.createDataFrame([("d", "p", t, *[None] * 12) for t in ("t1", "t2")], kinds)
    coded = spark.createDataFrame([], "document_id string, temp_id string, normalized_value string, unit_canonical string, canonical_code string, coding_system string, "
                                  "coding_confidence double, reference_range_low double, reference_range_high double, reference_range_unit string")
    documents = spark.createDataFrame([("d", None, None)], "document_id string, document_date timestamp, uploaded_at timestamp")
    rows = tables.clinical_entities(entities, coded, documents).withColumn("want", entity_uuid(F.col("document_id"), F.col("temp_id")))
    assert {r.temp_id for r in rows.filter("id = want").collect()} == {"t1", "t2"}
    plan = catalog.QUERIES["stored_entities"](Inputs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
