"""Masking against a plain reading of the rules on small texts."""

import random
import time
import re
import uuid

import pytest
from pyspark.sql import functions as F

from carefold.functions import spans as sp
from carefold.operators import masking

REPORT = [
    "Patient Name: Anna Berg",
    "DOB: 03/11/1968, age 55 years old",
    "MRN: 90817263 / Hospital ID: HX-55012 / Patient ID: Q-7781",
    "Aadhaar: 1234 5678 9012, PAN ABCDE1234F",
    "Call (555) 867-5309 or +1 555-867-5309 or 9876543210",
    "Write to anna.berg@example.org; NPI 1234567890",
    "Lives at 12 Oak Hill Road, seen by Dr. Omar Faruk",
    "Potassium 4.4 mEq/L",
    "Äußere Zeile ohne Kennung",
    "",
]


def expected_matches(text):
    found = []
    for order, spec in enumerate(masking.IDENTIFIERS):
        flags = re.IGNORECASE if "(?iU)" in spec.pattern else 0
        for m in re.finditer(re.sub(r"^\(\?i?U\)", "", spec.pattern), text, flags):
            found.append((spec.priority, m.start() - m.end(), m.start(), order, m.end(), m.group(), spec))
    kept = []
    for p, neg, start, order, end, value, spec in sorted(found, key=lambda f: f[:4]):
        if not any(start < e and end > s for s, e, *_ in kept):
            kept.append((start, end, value, spec))
    return sorted(kept, key=lambda k: k[0])


def expected_token(spec, value):
    name = uuid.uuid5(uuid.UUID(masking.TOKEN_NAMESPACE), f"{spec.category}:{value}")
    return f"[[PHI:{spec.prefix}:{name}]]"


@pytest.fixture(scope="module")
def spans(spark):
    rows = [("d1", k, t, 0.65 if k % 2 else 0.9) for k, t in enumerate(REPORT)]
    return spark.createDataFrame(rows, "document_id string, span_pos int, text string, confidence double")


def test_masked_text_and_tokens(spans):
    for row in masking.mask(spans).collect():
        text, out, end = REPORT[row.span_pos], "", 0
        for start, stop, value, spec in expected_matches(text):
            out += text[end:start] + expected_token(spec, value)
            end = stop
        assert row.text == out + text[end:]


def test_restore_gives_the_text_back_and_leaves_unknown_tokens(spans):
    masked = masking.mask(spans)
    tokens = masking.token_map(masked)
    keys = ["document_id", "span_pos"]
    back = masking.restore(masked.drop("matches"), tokens, keys)
    assert {(r.span_pos, r.text) for r in back.collect()} == set(enumerate(REPORT))
    partial = masking.restore(masked.drop("matches"), tokens.filter("category <> 'MRN'"), keys)
    line = {r.span_pos: r.text for r in partial.collect()}[2]
    assert line.startswith("[[PHI:MRN:") and "HX-55012" in line


def test_equal_values_share_a_token_across_documents(spark, spans):
    other = spans.withColumn("document_id", F.lit("d2"))
    tokens = masking.token_map(masking.mask(spans.unionByName(other)))
    per_token = tokens.groupBy("token").agg(F.countDistinct("document_id").alias("n"))
    assert {r.n for r in per_token.collect()} == {2}


def test_switched_off(spans):
    off = masking.mask(spans, enabled=False)
    assert {r.text for r in off.collect()} == set(REPORT) and masking.token_map(off).count() == 0


def test_overlap_choice_on_random_spans(spark):
    rng = random.Random(7)
    rows = []
    for k in range(200):
        spans = []
        for o in range(rng.randint(0, 12)):
            start = rng.randint(0, 40)
            spans.append((start, start + rng.randint(1, 12), "v", "c", "p", rng.randint(0, 3), o))
        rows.append((k, spans))
    df = spark.createDataFrame(rows, f"k int, c array<{masking._FOUND_TYPE}>")
    got = df.select("k", sp.resolve_overlaps(F.col("c"), masking._FOUND_TYPE).alias("r")).collect()
    for row in got:
        kept = []
        for s in sorted(rows[row.k][1], key=lambda x: (x[5], x[0] - x[1], x[0], x[6])):
            if not any(s[0] < e[1] and s[1] > e[0] for e in kept):
                kept.append(s)
        assert [tuple(x) for x in row.r] == sorted(kept)


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([("é😀 12 x 345",)], "t string")
    found = df.select(sp.find_matches(F.col("t"), r"\d+").alias("m")).first().m
    assert [(m.start, m.end, m.value) for m in found] == [(3, 5, "12"), (8, 11, "345")]


def test_guard_is_sequential_and_reversible(spark):
    text = "MRN: 1234567 SSN 123-45-6789 Dr. Omar Faruk, Accession: AB12CD34, mail a@b.org"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    guarded = masking.guard(df, ["id"])
    row = guarded.first()
    assert len(row.guard_tokens) == 5 and "1234567" not in row.text
    tokens = masking.guard_map(guarded, ["id"], F.lit("2024-01-01 00:00:00").cast("timestamp"))
    back = masking.guard_restore(guarded.drop("guard_tokens"), tokens, tokens.limit(0), ["id"])
    assert back.first().text == text
    at = lambda s: F.lit(s).cast("timestamp")
    assert masking.live_tokens(tokens, at("2024-01-01 00:59:59")).count() == 5
    assert masking.live_tokens(tokens, at("2024-01-01 01:00:00")).count() == 0


def test_store(spark, spans):
    tokens = masking.token_map(masking.mask(spans))
    hidden = masking.encrypt_values(tokens, F.lit("0123456789abcdef"))
    assert not {r.value for r in hidden.collect()} & {r.value for r in tokens.collect()}
    opened = masking.decrypt_values(hidden, F.lit("0123456789abcdef"))
    assert {tuple(r) for r in opened.collect()} == {tuple(r) for r in tokens.collect()}
    assert masking.save_mapping(tokens, tokens).count() == tokens.count()
    gone = spark.createDataFrame([("d1",)], "document_id string")
    assert masking.purge_mapping(tokens, gone).count() == 0


def test_equal_tokens_of_two_records_stay_apart(spark):
    texts = {"a": "MRN 10026956 here", "b": "MRN 10050615 here"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    guarded = masking.guard(df, ["id"])
    tokens = masking.guard_map(guarded, ["id"], F.lit("2024-01-01 00:00:00").cast("timestamp"))
    # the same token in both records, each with its own value
    same = tokens.withColumn("token", F.lit("[PHI_MRN_00000001]"))
    clashing = guarded.withColumn("text", F.regexp_replace("text", masking.GUARD_TOKEN_PATTERN, "[PHI_MRN_00000001]"))
    back = masking.guard_restore(clashing.drop("guard_tokens"), same.limit(0), same, ["id"])
    assert {r.id: r.text for r in back.collect()} == texts


def test_equal_values_of_a_record_have_tokens_of_their_own(spark):
    text = " ".join(["MRN 12345678"] * 300 + ["123-45-6789"] * 300)
    guarded = masking.guard(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    tokens = [t.token for t in guarded.guard_tokens]
    assert len(set(tokens)) == len(tokens) == 600
    assert all(t in guarded.text for t in tokens)


def test_very_many_matches_take_linear_time(spark):
    n = 50_000
    df = spark.range(1).select(F.expr(f"repeat('MRN: 1234567 then a@b.org ', {n})").alias("text"))
    begin = time.time()
    row = masking.mask(df).select(F.size("matches").alias("n"), F.expr("regexp_count(text, 'PHI:')").alias("shown")).first()
    assert (row.n, row.shown) == (2 * n, 2 * n) and time.time() - begin < 60
