"""Dictionaries that are tables: the same mentions as compiled ones, and names matched at any size."""

import difflib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carefold.functions import similarity
from carefold.functions.atoms import Atoms
from carefold.operators import coding, entities
from carefold.operators.table_dictionary import TableDictionary
from carefold.sources import knowledge

DICTIONARY = entities.Dictionary.builtin()
KEEP = ["document_id", "span_pos"]


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(
        *KEEP, "domain", "key", "code", "mention_start", "mention_end", "matched_text", "text_before", "text_after").collect())


def _spans(spark, texts):
    return spark.createDataFrame([(f"d{k % 7}", k, t, 0.9) for k, t in enumerate(texts)], "document_id string, span_pos int, text string, confidence double")


def _texts(seed, n=400):
    draw = random.Random(seed)
    aliases = [a for d in entities.DOMAINS for a in DICTIONARY.aliases[d]]
    fill = ["", " ", ", ", ";", "x", "-", " and ", "\n", " 12 ", "é", "日", ".", "/"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 12)):
            alias = draw.choice(aliases)
            parts += [draw.choice((alias, alias.upper(), alias.lower(), alias.title())), draw.choice(fill)]
        texts.append("".join(parts))
    return texts


def test_mentions_are_those_of_the_compiled_dictionary(spark):
    spans = _spans(spark, [*_texts(1), None, "", "nothing here"])
    table = TableDictionary(knowledge.builtin_ontology(spark), bits=14)
    wanted = _rows(entities.mentions(spans, DICTIONARY, KEEP))
    assert len(wanted) > 1000 and _rows(entities.mentions(spans, table, KEEP)) == wanted
    columns = ["entity_type", "raw_value", "entity_label", "unit_raw", "source_span_start", "source_span_end", "assertion_status"]
    both = [sorted(map(str, entities.extract(spans, d, keep=tuple(KEEP)).select(*KEEP, *columns).collect())) for d in (DICTIONARY, table)]
    assert both[0] == both[1]


def test_overlaps_short_names_and_repeated_rows(spark):
    entries = [("diagnosis", 0, "heart failure", ["acute heart failure", "HF", "β", "a (b)", "%"]), ("diagnosis", 1, "failure of heart", ["heart failure of"]),
               ("lab", 0, "HF", ["hf"]), ("lab", 1, "twice", ["Twice", None, " "])]
    table = TableDictionary(spark.createDataFrame(
        [(d, o, k, f"c{o}", k, None, None, a) for d, o, k, a in entries],
        "domain string, ordinal int, key string, code string, display string, unit_canonical string, drug_class string, aliases array<string>"))
    texts = ["Acute  heart failure, acute heart failure of", "xheart failure heart failure", "HF hf Hf", "β αβ βx a (b) a (b)c 5% % x%", "heart failure"] + ["heart failure"]
    found = entities.mentions(_spans(spark, texts), table, KEEP).collect()
    by = {}
    for r in found:
        by.setdefault(r.span_pos, set()).add((r.domain, r.key, r.mention_start, r.mention_end))
    assert by[0] == {("diagnosis", "heart failure", 7, 20), ("diagnosis", "heart failure", 22, 41)}
    assert by[1] == {("diagnosis", "heart failure", 15, 28)}
    assert by[2] == {("diagnosis", "heart failure", 0, 2), ("lab", "HF", 0, 2), ("lab", "HF", 3, 5)}
    starts = {m[2] for m in by[3]}
    assert {texts[3][s] for s in starts} == {"β", "a", "%"} and 0 in starts and texts[3].index("% ") + 2 in starts
    assert 3 in starts and texts[3].index("5%") + 1 not in starts
    assert by[4] == by[5] == {("diagnosis", "heart failure", 0, 13)}
    assert entities.mentions(_spans(spark, ["heart failure"]).limit(0), table, KEEP).collect() == []


def test_a_million_aliases(spark):
    ontology = spark.range(1_000_000).select(
        F.lit("diagnosis").alias("domain"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("finding "), F.col("id")).alias("key"),
        F.concat(F.lit("C"), F.col("id")).alias("code"), F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("unit_canonical"),
        F.lit(None).cast("string").alias("drug_class"), F.array().cast("array<string>").alias("aliases"),
    )
    texts = [f"seen finding {k * 3331}, no finding {k}x" for k in range(300)] + ["finding 1000000"]
    found = entities.mentions(_spans(spark, texts), TableDictionary(ontology), KEEP).collect()
    assert sorted((r.span_pos, r.code) for r in found) == [(k, f"C{k * 3331}") for k in range(300)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é日.\n\t", max_size=12), max_size=5))
def test_atoms_cover_what_is_no_space(texts):
    atoms = Atoms(pa.array(texts, pa.string()))
    found = [(int(t), texts[t][b:e]) for t, b, e in zip(atoms.text, atoms.begin, atoms.end)]
    wanted = []
    for number, text in enumerate(texts):
        run = ""
        for c in text + "\n":
            if c.isascii() and c.isalnum():
                run += c
                continue
            wanted += [(number, run)] if run else []
            run = ""
            wanted += [(number, c)] if c not in " \n\t" else []
    assert found == wanted


# --------------------------------------------------------------------------- close names
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.sampled_from("abcdz")), max_size=5), st.sampled_from([0.6, 0.8, 0.9, 1.0]))
def test_no_pair_at_the_cutoff_is_lost(name, edits, cutoff):
    other = list(name)
    for kind, at, c in edits:
        at %= len(other) + 1
        other[at : at + (kind > 0)] = [c] if kind < 2 else []
    other = "".join(other)
    if other and difflib.SequenceMatcher(None, other, name).ratio() >= cutoff:
        assert len(other) in similarity.lengths_near(len(name), cutoff)
        assert similarity.name_keys(name, cutoff) & set(similarity.alias_keys(other, cutoff))


def test_closest_names_with_ties_against_every_comparison(spark):
    draw = random.Random(3)
    aliases = sorted({(d, a.lower()) for d in entities.DOMAINS for a in DICTIONARY.aliases[d]} | {("lab", "abcdefgx"), ("lab", "abcdefgy"), ("lab", "zbcdefgh")})
    names = {("lab", "abcdefgh"), ("lab", "none at all"), (None, "x"), ("lab", None), ("lab", "")}
    for domain, alias in aliases:
        text = list(alias)
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice(["", "e", "ab"])
        names.add((domain, "".join(text)))
    want = {}
    for domain, text in names:
        near = difflib.get_close_matches(text, [a for d, a in aliases if d == domain], n=1, cutoff=0.8) if domain and text else []
        if near:
            want[domain, text] = (near[0], difflib.SequenceMatcher(None, text, near[0]).ratio())
    got = similarity.close_names(
        spark.createDataFrame([*names, *names], "domain string, text string"), spark.createDataFrame(aliases, "domain string, alias string"), 0.8
    )
    assert {(r.domain, r.text): (r.alias, r.score) for r in got.collect()} == want and len(want) > 100


def test_codes_from_a_table_are_those_of_the_compiled_dictionary(spark):
    draw = random.Random(9)
    rows = []
    for k in range(300):
        domain = draw.choice(entities.DOMAINS)
        alias = draw.choice(DICTIONARY.aliases[domain])
        at = draw.randrange(len(alias))
        kind = {"lab": draw.choice(["lab_value", "vital_sign"])}.get(domain, domain)
        name = draw.choice([alias, alias[:at] + alias[at + 1 :], alias.upper() + "q", "zzz", None, alias])
        rows.append((f"t{k}", kind if k % 20 else "procedure", name, name if domain != "lab" else "5.1", "mg/dL"))
    df = spark.createDataFrame(rows, "temp_id string, entity_type string, entity_label string, raw_value string, unit_raw string")
    df = df.withColumn("entity_label", F.when(F.col("entity_type").isin("lab_value", "vital_sign") | (F.rand(1) < 0.5), F.col("entity_label"))).cache()
    columns = ["temp_id", "code", "display", "entry_unit", "coding_method", "base_confidence"]
    compiled = coding.with_codes(df, DICTIONARY).select(*columns).collect()
    table = coding.with_codes(df, TableDictionary(knowledge.builtin_ontology(spark))).select(*columns).collect()
    assert sorted(map(str, compiled)) == sorted(map(str, table))
    assert sum(r.coding_method == "fuzzy" for r in compiled) > 20


@pytest.mark.parametrize("bits", [6, 10])
def test_a_small_bitmap_only_costs_time(spark, bits):
    spans = _spans(spark, _texts(4, 60))
    table = TableDictionary(knowledge.builtin_ontology(spark), bits=bits)
    assert _rows(entities.mentions(spans, table, KEEP)) == _rows(entities.mentions(spans, DICTIONARY, KEEP))
