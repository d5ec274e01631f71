"""Extraction rules on sentences of each kind."""

import random

import pytest
from pyspark.sql import functions as F

from carefold.functions import spans as sp
from carefold.operators import entities, layout
from carefold.session import spread

DICTIONARY = entities.Dictionary.builtin()


@pytest.fixture(scope="module")
def extract(spark):
    def run(*lines, confidence=0.9, **options):
        rows = [("d", "p", k, t, confidence if isinstance(confidence, float) else confidence[k])
                for k, t in enumerate(lines)]
        spans = spark.createDataFrame(
            rows, "document_id string, patient_id string, span_pos int, text string, confidence double"
        )
        found = entities.extract(spans, DICTIONARY, layout.span_offsets(spans), **options)
        return sorted(found.collect(), key=lambda r: (r.source_span_start, r.entity_type))

    return run


def test_value_with_unit(extract):
    (e,) = extract("Hemoglobin: 11.4 g/dL")
    assert (e.entity_type, e.raw_value, e.unit_raw, e.assertion_status) == ("lab_value", "11.4", "g/dL", "present")
    assert (e.source_span_start, e.source_span_end) == (0, 21)
    assert (e.ner_confidence, e.combined_confidence) == (0.93, 0.837)


def test_canonical_unit_when_none_is_written(extract):
    (e,) = extract("sodium = 139")
    assert (e.raw_value, e.unit_raw) == ("139", "mEq/L")


def test_name_without_a_number_is_no_lab(extract):
    assert extract("The hemoglobin was talked about.") == []


def test_value_must_stand_on_the_line(extract):
    assert extract("Hemoglobin:", "12.0 g/dL") == []


def test_vital_sign(extract):
    (e,) = extract("Pulse 71 bpm")
    assert e.entity_type == "vital_sign" and e.entity_label == "HeartRate"


def test_doses_and_frequencies_stay_with_their_drug(extract):
    rows = extract("Metformin 850mg BID. Ramipril 5mg nightly, Zocor")
    assert [(r.raw_value, r.unit_raw) for r in rows] == [
        ("Metformin", "850mg twice daily"), ("Ramipril", "5mg at night"), ("Simvastatin", None)]
    assert [r.ner_confidence for r in rows] == [0.92, 0.92, 0.82]


@pytest.mark.parametrize("line,status", [
    ("No sign of gout.", "absent"),
    ("Gout was ruled out.", "absent"),
    ("Should gout return, call.", "hypothetical"),
    ("Gout, tablets as needed.", "conditional"),
    ("Suspected gout.", "possible"),
    ("Gout?", "possible"),
    ("Denies pain. Gout since May.", "present"),
    ("Known gout.", "present"),
])
def test_assertion(extract, line, status):
    (e,) = extract(line)
    assert e.assertion_status == status and not e.is_negated


def test_absent_can_count_as_negated(extract):
    (e,) = extract("No gout.", treat_absent_as_negated=True)
    assert e.is_negated


def test_family_history_is_ambiguous(extract):
    (e,) = extract("Mother has hypertension.")
    assert e.ambiguity_flag and "family" in e.ambiguity_reason.lower()


def test_short_alias_needs_its_case_and_bounds(extract):
    assert extract("Take 5 kilos, k 4.0, OK 3") == []
    (e,) = extract("K 4.0")
    assert e.entity_label == "Potassium" and e.ner_confidence == 0.8


def test_longest_alias_wins_and_domains_are_independent(extract):
    rows = extract("insulin glargine 10 units, low hemoglobin 9.1")
    assert [(r.entity_type, r.entity_label) for r in rows] == [
        ("medication", "Insulin Glargine"), ("diagnosis", "Anemia"), ("lab_value", "Hemoglobin")]


def test_confidence_comes_from_the_span(extract):
    rows = extract("Hemoglobin: 12.1 g/dL", "Creatinine 1.8 mg/dL", confidence=[0.99, 0.4])
    assert [r.ocr_confidence for r in rows] == [0.99, 0.4]


def test_empty_text(extract):
    assert extract("", "  ") == []


def test_ids_repeat(extract):
    assert extract("Gout", "Gout")[1].temp_id == extract("Gout", "Gout")[1].temp_id
    assert len({r.temp_id for r in extract("Gout", "Gout")}) == 2


def test_sentences_and_fallback(spark):
    text = "One. Two!\n\n  \nThree?  Four"
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    found = entities.sentences(docs).orderBy("start").collect()
    assert [(text[r.start:r.end]) for r in found] == [r.sentence for r in found] == ["One.", "Two!", "Three?", "Four"]
    wanted = [("d", "a", 1), ("d", "b", 6), ("d", "c", 4), ("d", "e", 999)]
    at = spark.createDataFrame(wanted, "document_id string, mention_id string, offset int")
    got = {r.mention_id: r.sentence for r in entities.sentence_of(at, entities.sentences(docs), 4).collect()}
    assert got == {"a": "One.", "b": "Two!", "c": "Four", "e": "Four"}


def test_too_many_aliases_are_refused():
    with pytest.raises(ValueError):
        entities.Dictionary(DICTIONARY.entries, 10)


def test_shared_beginnings_find_what_the_plain_alternation_finds(spark):
    dictionary = entities.Dictionary.builtin()
    rng = random.Random(4)
    words = [a for d in entities.DOMAINS for a in dictionary.aliases[d]] + ["x", "9", "\u212a+", "K", "metforminx", "low", "HDL", "hdl"]
    texts = [rng.choice(["", " "]).join(
        "".join(rng.choice([c, c.upper(), c.lower()]) for c in rng.choice(words)) + rng.choice(["", " ", ", ", "-", "\n"]) for _ in range(8)
    ) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for domain in entities.DOMAINS:
        ordered = sorted(dict.fromkeys(dictionary.aliases[domain]), key=len, reverse=True)
        flat = [
            flags + "(?<![A-Za-z0-9])(?:" + "|".join(map(entities._escape, [a for a in ordered if (len(a) > 3) == (flags != "")])) + ")(?![A-Za-z0-9])"
            for flags in ("(?iu)", "")
        ]
        for new, old in zip(dictionary.patterns(domain), flat, strict=True):
            assert len(new) < len(old) + 60
            both = df.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (new, old)]).collect()
            assert all(a == b for a, b in both) and any(a for a, _ in both)


def test_texts_are_split_as_by_the_pattern(spark):
    texts = ["", "a. b", ". a\n\nb. ", "one", "x\u0001y. z", "\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(sp.split_at(F.col("text"), entities.SENTENCE_BREAK).alias("a"), F.split("text", entities.SENTENCE_BREAK, -1).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_narrow_rows_are_dealt_out_by_their_bytes(spark):
    rows = spark.range(0, 1 << 20, 1, 2)
    assert spread(rows, 1 << 20).rdd.getNumPartitions() >= 8
    assert spread(rows).rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
