"""Classifiers by held-out accuracy, counts by brute force, and the odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import features, language, quality, rules, toxicity
from carefold.llm.words import ALNUM, NOT_SPACE, Words

SCHEMA = "doc_id long, text string, lang string, source string, label string, score double"
DRAW = random.Random(4)
COMMON = ["".join(DRAW.choice("aeioulnrst") for _ in range(DRAW.randint(1, 8))) for _ in range(600)]
BAD = ["zokri", "wuvex", "qamby"]


def prose(n, draw=DRAW, words=COMMON):
    return " ".join(draw.choice(words) for _ in range(n))


def corpus():
    """Texts with labels: toxic ones hold a bad word, poor ones are full of symbols or say the same again and again."""
    draw, rows = random.Random(6), []
    for k in range(900):
        toxic, good = int(draw.random() < 0.2), int(draw.random() < 0.6)
        words = prose(draw.randint(20, 120), draw).split()
        if not good:
            words = [w + draw.choice(["***", "$$$", "%%%"]) for w in words] if k % 2 else words[:4] * 25
        if toxic:
            for _ in range(2):
                words.insert(draw.randrange(len(words)), draw.choice(BAD) + draw.choice(["", "eta", "ing"]))
        rows.append((k, " ".join(words), good, toxic))
    return rows


ODD = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "word " * 60_000), (10_004, "again"), (10_004, "again"), (None, "no id"), (10_005, "日本語 é")]


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, None, None, "clash", 0.0) for k, t, _, _ in rows] + [(k, t, "xx", "s", "clash", 0.0) for k, t in ODD], SCHEMA).repartition(6).cache()
    labels = spark.createDataFrame([(k, g, x) for k, _, g, x in rows] + [(10_004, None, None), (None, 1, 1), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {k: (g, x) for k, _, g, x in rows}


def crc(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


@pytest.mark.parametrize("module, place, modulus, held", [(quality, 0, 3, 1), (toxicity, 1, 5, 0)])
def test_held_out_rows_are_told(tables, module, place, modulus, held):
    docs, labels, want = tables
    got = module.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, modulus) == held) for r in got)
    test = [(r.predicted, want[r.doc_id][place]) for r in got if r.doc_id in want and r.held_out]
    assert len(test) > 100 and sum(a == b for a, b in test) > 0.93 * len(test)
    assert len({r.score for r in got if r.doc_id == 10_004}) == 1
    assert len({r.score for r in got if r.doc_id in (10_000, 10_001)}) == 1


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_learned(tables, module, column):
    docs, labels, _ = tables
    held = "pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), " + ("3) = 1" if column == "quality" else "5) = 0")
    turned = labels.selectExpr("doc_id", *[f"CASE WHEN {held} THEN 1 - {c} ELSE {c} END AS {c}" if c == column else c for c in ("quality", "toxic")])
    score = lambda t: {r.doc_id: r.score for r in module.classify(docs.filter("doc_id <> 10004"), t).collect()}
    assert score(labels) == score(turned)


@pytest.mark.parametrize("module", [quality, toxicity, rules])
def test_without_labels_or_rows(tables, module):
    docs, labels, _ = tables
    assert module.classify(docs.limit(0), labels).collect() == []
    got = module.classify(docs, labels.limit(0)).collect()
    assert len(got) == docs.count()
    if module is not rules:
        assert len({r.score for r in got}) == 1


def test_toxic_documents_go(tables):
    docs, labels, want = tables
    left = toxicity.keep_clean(docs, toxicity.fit(docs, labels)).collect()
    assert left[0].asDict().keys() == set(docs.columns)
    kept = {r.doc_id for r in left}
    assert sum(k in kept for k, (_, x) in want.items() if x) <= 0.05 * sum(x for _, x in want.values())
    assert sum(k in kept for k, (_, x) in want.items() if not x) >= 0.97 * sum(not x for _, x in want.values())
    assert {k for k, _ in ODD} <= kept


def test_the_risk_stays_above_zero():
    draw = np.random.default_rng(0)
    positive = (draw.random((40, 60)) < 0.5).astype(np.uint8)
    unlabelled = (draw.random((60, 60)) < 0.5).astype(np.uint8)
    weights, bias = toxicity.train(positive, unlabelled, 0.3, steps=800)
    scores = 1 / (1 + np.exp(-(unlabelled @ weights + bias)))
    # without the correction the unlabelled rows would all be driven to zero
    assert np.isfinite(weights).all() and 0.1 < scores.mean() < 0.6


def test_neighbours_are_exact():
    draw = np.random.default_rng(1)
    counts = draw.poisson(1.0, (60, 300))
    labels = draw.integers(0, 2, 60)
    model = quality.Model.fit(counts, labels, 10)
    asked = draw.poisson(1.0, (25, 300)).astype(np.float32)
    own = features.unit((features.unit(np.log1p(asked)) - model.mean) @ model.projection)
    for row, score in zip(own, model.score(asked, 7, block=4), strict=True):
        cosine = model.vectors @ row
        near = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[near], 0).astype(float) ** quality.POWER
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-5


# --- rules -------------------------------------------------------------------------------------------------------------

SPACE = " \t\n\v\f\r"


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            len(words) < 10 or 100 * len(repeated) > 20 * len(words))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#\x0b日\xa0", max_size=80), max_size=8))
def test_base_counts(texts):
    found = rules.base_counts(pa.array(texts, pa.string()))
    got = list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), strict=True))
    assert got == [counts_by_hand(t) for t in texts]


def test_verdicts(tables):
    docs, labels, want = tables
    got = rules.classify(docs, labels).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts_by_hand(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= rules.LIMIT)
    known = [r for r in got if r.doc_id in want and not r.base_failed]
    assert sum(r.kept == want[r.doc_id][0] for r in known) > 0.95 * len(known)
    # probabilities are calibrated: their mean is about the share of good rows among those they are given for
    assert abs(np.mean([r.probability for r in got if r.doc_id in want]) - np.mean([g for g, _ in want.values()])) < 0.08


# --- words and languages -----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n.#日", max_size=30), max_size=6))
def test_words(texts):
    for keep, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[A-Za-z0-9\u0080-\U0010ffff]+")):
        words = Words(pa.array(texts, pa.string()), keep)
        want = [(row, w) for row, t in enumerate(texts) for w in re.findall(pattern, t)]
        assert [(int(d), words.text(i)) for i, d in enumerate(words.doc)] == want
        strings = [w for _, w in want]
        for values in (words.hashes().tolist(), words.exact_ids().tolist()):
            assert len(set(zip(values, strings, strict=True))) == len(set(values)) == len(set(strings))
        assert words.hashes(3).tolist() == Words(pa.array([w.encode()[:3].decode("latin-1") for w in strings], pa.string()), keep).hashes(3).tolist() or not all(w.isascii() for w in strings)


LANGUAGES = {
    "aa": ["the", "thing", "with", "shall", "other", "when", "night", "which"], "bb": ["und", "schein", "nicht", "ung", "zwischen", "auch", "durch", "machen"],
    "cc": ["que", "los", "ciudad", "donde", "mucho", "quien", "año", "llave"],
}


def test_languages(spark):
    draw = random.Random(3)
    rows = [(k, prose(draw.randint(4, 80), draw, LANGUAGES[name]), name) for k, name in enumerate(draw.choices(list(LANGUAGES), [6, 3, 1], k=400))]
    mixed = prose(60, draw, LANGUAGES["aa"]) + " " + prose(30, draw, LANGUAGES["bb"])
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ... 7", "cc"), (1003, mixed, None), (1004, "the thing " * 50_000, None), (1005, "the when", None), (1005, "the when", None)]
    rows += [(None, "und nicht durch schein", "bb")]
    docs = spark.createDataFrame([(k, t, n, "s", 1.0) for k, t, n in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)
    model = language.fit(docs)
    assert model.names == ["aa", "bb", "cc"]
    got = language.classify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in rows)
    names = {k: n for k, _, n in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif names[r.doc_id]:
            assert r.lang_pred == names[r.doc_id] and r.score > 0.8
    both = next(r for r in language.identify(docs, model).collect() if r.doc_id == 1003)
    assert both.lang_pred == "aa" and set(both.mixture) == {"aa", "bb"} and abs(both.mixture["bb"] - 1 / 3) < 0.12
    assert language.classify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.classify(docs.withColumn("lang", docs.lang_pred.substr(5, 1)).replace("", None, ["lang"])).collect()} == {"und"}


def test_the_mixture_raises_the_likelihood():
    draw = np.random.default_rng(2)
    model = language.Model.fit({k: draw.gamma(0.3, size=language.BINS) * 100 for k in "abcd"})
    chance = np.exp(model.logs.astype(float))
    row = draw.multinomial(4000, 0.5 * chance[0] + 0.3 * chance[2] + 0.2 * chance[3]).astype(np.float32)
    chosen, shares = model.mixture(row)
    assert sorted(chosen) == [0, 2, 3] and abs(shares.sum() - 1) < 1e-9
    assert np.abs(np.array([shares[chosen.index(k)] for k in (0, 2, 3)]) - [0.5, 0.3, 0.2]).max() < 0.05


def test_a_language_behind_many_related_ones_is_found():
    draw = np.random.default_rng(5)
    shared, own = np.zeros(language.BINS), np.zeros(language.BINS)
    shared[:300], own[2000:2300] = draw.gamma(0.5, size=300), draw.gamma(0.5, size=300)
    related = [shared * draw.uniform(0.3, 1.7, language.BINS) for _ in range(12)]
    model = language.Model.fit({f"r{k:02}": v / v.sum() * 1e5 for k, v in enumerate(related)} | {"alone": own / own.sum() * 1e5})
    chance = np.exp(model.logs.astype(float))
    at = {n: k for k, n in enumerate(model.names)}
    row = draw.multinomial(6000, (m := 0.45 * chance[at["alone"]] + 0.3 * chance[at["r03"]] + 0.25 * chance[at["r07"]]) / m.sum()).astype(np.float32)
    chosen, shares = model.mixture(row)
    found = {model.names[k]: s for k, s in zip(chosen, shares, strict=True)}
    assert max(found, key=found.get) == "alone" and abs(found["alone"] - 0.45) < 0.03
    assert {"r03", "r07"} <= set(found)


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_BLOCK", 3, raising=False)
    monkeypatch.setattr(language, "LANGUAGES", 4, raising=False)
    draw = random.Random(17)
    texts = {f"l{k:02}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(10)}
    rows = [(k, prose(30, draw, texts[n]), n) for k, n in enumerate(list(texts) * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert language.fit(docs).names == list(texts)
    assert {r.doc_id: r.lang_pred for r in language.classify(docs).collect()} == {k: n for k, _, n in rows}


def test_one_letter_is_a_language_of_its_word():
    words = {"en": "a cat and a dog saw a bird", "de": "o hund o katze o vogel", "fr": "y chat y chien y oiseau"}
    model = language.Model.fit({k: 1000 * language.trigrams(pa.array([v]))[0][0].astype(np.float64) for k, v in words.items()})
    names, scores, sets = model.predict(pa.array(["a", "A", " y ", "o.", "", "1", "é"]))
    assert names[:4] == ["en", "en", "fr", "de"] and names[4:6] == ["und", "und"]
    assert names[6] in words
    assert all(0 < s <= 1 for s in [*scores[:4], *scores[6:]]) and scores[4] == scores[5] == 0
    assert all(len(s) >= 1 for s in sets[:4]) and sets[4] == {}
