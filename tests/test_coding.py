"""Coding, units and reference bands."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from carefold.functions import similarity, units
from carefold.functions.text import exact_round, fixed_point, significant
from carefold.operators import coding, entities, monitoring
from carefold.sources import knowledge
from carefold.sources import knowledge_values as kv

SCHEMA = ("document_id string, patient_id string, temp_id string, entity_type string, raw_value string, "
          "entity_label string, unit_raw string, combined_confidence double")


@pytest.fixture(scope="module")
def code(spark):
    def run(*rows, patients=None):
        full = [("d", "p", f"t{k}", *r, 0.8) for k, r in enumerate(rows)]
        df = coding.code_entities(
            spark.createDataFrame(full, SCHEMA), entities.Dictionary.builtin(),
            knowledge.builtin_bands(spark), patients, F.lit("2024-06-01").cast("timestamp"),
        )
        return [r for r in sorted(df.collect(), key=lambda r: int(r.temp_id[1:]))]

    return run


def test_exact_codes(code):
    lab, drug, diagnosis, vital = code(
        ("lab_value", "12.1", "Hemoglobin", "g/dL"), ("medication", "x", "Metformin", None),
        ("diagnosis", "Gout", "Gout", None), ("vital_sign", "145", "BloodPressureSystolic", "mmHg"),
    )
    assert (lab.canonical_code, lab.coding_system, lab.normalized_value) == ("718-7", "LOINC", "12.1")
    assert (lab.reference_range_low, lab.reference_range_high) == (12.0, 17.5)
    assert (drug.coding_system, drug.normalized_value, drug.coding_confidence) == ("RxNorm", "Metformin", 0.97)
    assert (diagnosis.canonical_code, diagnosis.coding_method) == ("M10.9", "exact")
    assert (vital.reference_range_low, vital.unit_canonical) == (90.0, "mmHg")


def test_near_names_take_the_library_ratio(code):
    names = ["Metfromin", "atorvastatn", "Zzzblorp9000", "glucofage", "warfarrin"]
    aliases = {}
    for key, c, display, _, al in kv.DRUGS:
        for a in (key, *al):
            aliases[a.lower()] = display
    for name, row in zip(names, code(*[("medication", n, None, None) for n in names])):
        near = difflib.get_close_matches(name.lower(), aliases, n=1, cutoff=0.8)
        if near:
            ratio = difflib.SequenceMatcher(None, name.lower(), near[0]).ratio()
            assert (row.normalized_value, row.coding_confidence) == (aliases[near[0]], round(ratio, 4))
            assert row.coding_method == "fuzzy"
        else:
            assert row.canonical_code is None


def test_values_that_are_no_lab_results_stay_uncoded(code):
    rows = code(
        ("lab_value", "Hemoglobin", "Hemoglobin", None), ("lab_value", "-1", "Hemoglobin", None),
        ("lab_value", "42", None, None), ("procedure", "x", "y", None), ("lab_value", "5d", "Hemoglobin", None),
    )
    assert all(r.canonical_code is None for r in rows) and len(rows) == 5


def test_other_system_costs_confidence(code):
    clash, spelled, unknown = code(
        ("lab_value", "5", "Glucose", "mmol/l"), ("lab_value", "5", "Glucose", "MG / DL"),
        ("lab_value", "5", "Glucose", "drops"),
    )
    assert (clash.coding_confidence, clash.unit_canonical) == (0.72, "mg/dL")
    assert spelled.coding_confidence == unknown.coding_confidence == 0.97


def test_sex_and_age_choose_the_band(spark, code):
    patients = spark.createDataFrame([("p", "F", "1980-06-02")], "patient_id string, sex string, d string").select(
        "patient_id", "sex", F.col("d").cast("date").alias("date_of_birth"))
    (row,) = code(("lab_value", "12.1", "Hemoglobin", None), patients=patients)
    assert (row.reference_range_low, row.reference_range_high) == (12.0, 15.5)


def _band(bands, sex, age):
    fit = [b for b in bands if (sex is None or b[0] in (sex, "any")) and (age is None or b[1] <= age <= b[2])] or list(bands)
    if age is None:
        fit = [b for b in fit if b[1] >= 18] or fit
    normal = [b for b in fit if any(w in (b[5] or "").lower() for w in ("normal", "desirable", "optimal"))]
    if normal:
        return normal[0][3:5]
    if len(fit) > 1 and sex is None and len({b[0] for b in fit}) > 1:
        return min(b[3] for b in fit), max(b[4] for b in fit)
    return fit[0][3:5]


def test_bands_for_every_code_sex_and_age(spark):
    cases = [(c, s, a) for c, *_ in kv.BANDS for s in (None, "M", "F") for a in (None, 0, 10, 17, 18, 60, 130)]
    df = spark.createDataFrame(cases, "code string, sex string, age int")
    bands = {c: b for c, _, _, _, b in kv.BANDS}
    for r in coding.with_reference_band(df, knowledge.builtin_bands(spark)).collect():
        assert (r.reference_range_low, r.reference_range_high) == tuple(_band(bands[r.code], r.sex, r.age))


def test_units(spark):
    rows = [("MG/DL",), (" k/uL ",), ("ml / min / 1.73 m2",), ("odd  unit",), ("",), (None,), ("°c",)]
    got = [r.u for r in spark.createDataFrame(rows, "u string").select(units.normal_unit(F.col("u")).alias("u")).collect()]
    assert got == ["mg/dL", "10^3/uL", "mL/min/1.73m2", "odd unit", None, None, "°C"]


def test_conversion_and_critical_values(spark):
    df = spark.createDataFrame(
        [("temperature", "F", "C", 212.0), ("glucose", "mmol/L", "mg/dL", 10.0), ("weight", "kg", "kg", 3.0), ("weight", "kg", "t", 3.0)],
        "analyte string, unit string, target_unit string, value double")
    got = {(r.analyte, r.target_unit): r.converted_value for r in monitoring.convert_units(df, knowledge.builtin_unit_factors(spark)).collect()}
    assert got[("temperature", "C")] == pytest.approx(100.0) and got[("glucose", "mg/dL")] == pytest.approx(180.182)
    assert got[("weight", "kg")] == 3.0 and got[("weight", "t")] is None
    obs = spark.createDataFrame([("2823-3", 6.8), ("2823-3", 5.0), ("none", 1.0)], "code string, value double")
    flags = {(r.code, r.value): r.requires_clinician_review for r in monitoring.flag_critical(obs, knowledge.builtin_critical_rules(spark)).collect()}
    assert flags == {("2823-3", 6.8): True, ("2823-3", 5.0): False, ("none", 1.0): False}


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(5)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(-4, 5) for _ in range(3000)]
    xs += [round(rng.random(), 5) for _ in range(3000)] + [k / 8 for k in range(-40, 40)] + [0.0]
    x = F.col("x")
    for r in spark.createDataFrame([(v,) for v in xs], "x double").select(
        "x", exact_round(x, 4).alias("a"), fixed_point(x, 1).alias("b"), significant(x).alias("c")
    ).collect():
        assert (r.a, r.b, r.c) == (round(r.x, 4), f"{r.x:.1f}", f"{r.x:.4g}")


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "two words"), ("cat", "cat"), ("a", "b")], "a string, b string")
    got = [r.s for r in df.select(similarity.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [pytest.approx(4 / 11), 1.0, 0.0]
