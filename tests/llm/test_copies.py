"""Near duplicates, repeated passages and test items, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carefold.llm import decontaminate, neardup, substrings
from carefold.llm.words import ALNUM, Words

SCHEMA = "doc_id long, text string, n_chars long, `row` string, node string"
DRAW = random.Random(11)
VOCABULARY = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randint(2, 7))) for _ in range(4000)]


def prose(n, draw=DRAW):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def sentences(n, draw=DRAW):
    return " ".join(prose(draw.randint(6, 14), draw).capitalize() + "." for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, len(t or ""), "clash", "clash") for k, t in rows], SCHEMA)


# --- near duplicates ---------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def classes_by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return {i: rows[min(group, key=key)][0] for group in members.values() for i in group}


def copies():
    draw = random.Random(5)
    rows, number = [], 0

    def add(text):
        nonlocal number
        rows.append((number, text))
        number += 1

    for _ in range(25):
        add(prose(draw.randint(3, 200), draw))
    original = prose(180, draw).split()
    for _ in range(60):  # copies of one text that are nearer to it than to each other
        own = list(original)
        for _ in range(3):
            own[draw.randrange(len(own))] = prose(1, draw)
        add(" ".join(own))
    chain = prose(120, draw).split()
    for k in range(8):  # neighbours are alike, the ends are not
        add(" ".join(chain[4 * k :] + prose(4 * k, random.Random(1)).split()))
    for text in (prose(80, draw), "one two", "same, SAME same"):
        for _ in range(12):
            add(text)
    shared = prose(60, draw)
    for _ in range(10):  # a common passage alone makes no copy
        add(shared + " " + prose(60, draw))
    for text in (None, None, "", " \n ", "...", "...", "long " * 20_000, "Long " * 20_000):
        add(text)
    rows += [(None, original_text := " ".join(original)), (None, "nobody else"), (3, rows[3][1])]
    assert original_text
    return rows


def test_classes_match_brute_force(spark):
    rows = copies()
    want = classes_by_hand(rows)
    got = neardup.classes(frame(spark, rows).repartition(7)).select("doc_id", "class_id").collect()
    assert Counter(map(tuple, got)) == Counter((rows[i][0], want[i]) for i in range(len(rows)))


def test_one_of_each_class_stays(spark):
    rows = copies()
    want = classes_by_hand(rows)
    left = neardup.keep_one(frame(spark, rows)).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "n_chars", "row", "node"}
    worded = [r for r in left if shingle_set(r.text)]
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in worded) == sorted(
        -1 if c is None else c for c in {want[i] for i in range(len(rows)) if shingle_set(rows[i][1])})
    assert sum(not shingle_set(r.text) for r in left) == sum(not shingle_set(t) for _, t in rows)
    empty = frame(spark, rows).limit(0)
    assert neardup.keep_one(empty).collect() == [] and neardup.classes(empty).collect() == []


def test_a_block_repeated_in_one_text_only_loses_no_link(spark):
    draw, rows = random.Random(21), []
    for times, edits in [(20, 0)] * 6 + [(5, 5)] * 6 + [(4, 6)] * 6:
        words = prose(404, draw).split()
        other = list(words)
        for k in range(edits):
            other[130 + 40 * k] = prose(1, draw)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other[:120] * times + other[120:]))]
    want = classes_by_hand(rows)
    assert set(want.values()) == set(range(0, len(rows), 2))
    assert {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows).repartition(5)).collect()} == want


def test_texts_of_one_shingle_set_have_one_signature():
    cycle = prose(9).split()
    made = neardup.sketch(pa.array([" ".join(cycle * k) for k in (2, 3, 40)]))
    assert len(set(made["node"].tolist())) == 1
    assert all((made[k] == made[k][0]).all() for k in ("keys", "bits", "marks"))


@pytest.mark.parametrize("overlap", [0.3, 0.6, 0.8, 0.95])
def test_signatures_estimate_probability_jaccard(overlap):
    draw = np.random.default_rng(4)
    both = draw.integers(1, 2**63, 400).astype(np.uint64)
    cut = int(400 * overlap)
    left, right = np.concatenate([both[:cut], draw.integers(1, 2**63, 400 - cut).astype(np.uint64)]), both
    weights = [draw.uniform(0.5, 4, 400), draw.uniform(0.5, 4, 400)]
    signed = neardup.signatures(np.concatenate([left, right]), np.concatenate(weights), np.repeat([0, 1], 400), 2, 4096)
    x, y = dict(zip(left.tolist(), weights[0], strict=True)), dict(zip(right.tolist(), weights[1], strict=True))
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {**x, **y}) for d in x.keys() & y.keys())
    assert abs((signed[0] == signed[1]).mean() - want) < 5 * math.sqrt(0.25 / 4096)


# --- repeated passages -------------------------------------------------------------------------------------------------

UNIT = re.compile(r".*?(?:[.!?](?=[ \t\n\v\f\r])|\n|$)", re.S)


def units_by_hand(text):
    out = []
    for found in UNIT.finditer(text + "\n"):
        words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", found[0])
        if words:
            begin = found.start() + re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", found[0]).start()
            digest = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words)
            out.append((begin, found.end() - found[0].endswith("\n"), digest))
    return out


def passages_by_hand(rows, least=substrings.LEAST_WORDS):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    units = {r: units_by_hand(r[1] or "") for r in rows}
    for r in rows:
        for k, (_, _, digest) in enumerate(units[r]):
            first.setdefault(digest, (r, k))
    for r in rows:
        run = []
        for k, (begin, end, digest) in enumerate([*units[r], (0, 0, None)]):
            if digest is not None and first[digest] != (r, k):
                run.append((begin, end, digest))
            elif run:
                if sum(len(x[2]) for x in run) >= least:
                    out.append((r[0], run[0][0], run[-1][1], sum(len(x[2]) for x in run), first[run[0][2]][0][0]))
                run = []
    return out


def passage_rows():
    draw = random.Random(8)
    passage, line = sentences(8, draw), sentences(4, draw)
    rows = [(k, sentences(draw.randint(1, 9), draw) + draw.choice(["\n", " "]) + sentences(2, draw)) for k in range(30)]
    for k in range(30, 70):  # in the middle of a line, as a line, changed in case and marks
        form = draw.choice([passage, passage.upper(), passage.replace(" ", "  "), line])
        rows.append((k, sentences(2, draw) + draw.choice([" ", "\n", "\n\n"]) + form + draw.choice([" ", "\n"]) + sentences(2, draw)))
    rows += [(70, "Short. Short. Short."), (71, "Short. Short."), (72, None), (73, ""), (74, " \n"), (75, (sentences(3, draw) + "\n") * 50)]
    rows += [(76, "é ß " + passage), (None, passage), (None, passage), (5, rows[5][1]), (78, "x. " * 60_000)]
    return rows


def test_passages_match_brute_force(spark):
    rows = passage_rows()
    got = substrings.repeated_passages(frame(spark, rows).repartition(6)).drop("row").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted(map(tuple, got), key=key) == sorted(passages_by_hand(rows), key=key)


def test_removed_passages_leave_the_rest(spark):
    rows = passage_rows()
    docs = frame(spark, rows)
    left = substrings.remove(docs, substrings.repeated_passages(docs)).collect()
    cuts = defaultdict(list)
    for doc, begin, end, _, _ in passages_by_hand(rows):
        cuts[doc].append((begin, end))
    want = []
    for doc, text in rows:
        for begin, end in sorted(cuts[doc], reverse=True) if text else []:
            text = text[:begin] + text[end:]
        want.append((doc, text))
    assert Counter((r.doc_id, r.text) for r in left) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None) and left[0].row == "clash"
    assert substrings.repeated_passages(docs.limit(0)).collect() == []


def test_the_pipeline_cuts_whole_lines_of_any_length(spark):
    import corpus_pipeline

    draw = random.Random(13)
    license_, footer, header = prose(9, draw), "All rights reserved. See below.", prose(14, draw) + ". " + prose(4, draw)
    rows = passage_rows()
    rows += [(100 + k, f"{header}\n{prose(12, draw)}\n{draw.choice([license_, license_.upper()])}\n{prose(11, draw)} {license_}\nok then\n{footer}") for k in range(20)]
    rows += [(200, header.replace(". ", " ")), (201, None), (999, footer + "\n" + license_)]
    covered = defaultdict(set)
    for doc, begin, end, *_ in passages_by_hand(rows, substrings.LEAST_RUN_WORDS):
        covered[doc].update(range(begin, end))
    seen = set()
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        place = 0
        for line in (text or "").split("\n"):
            words = tuple(w.lower() if w.isascii() else w for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", line))
            if len(words) >= substrings.LEAST_LINE_WORDS:
                if words in seen:
                    covered[doc].update(range(place + re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", line).start(), place + len(line)))
                seen.add(words)
            place += len(line) + 1
    left = corpus_pipeline.cut_repeated_passages(spark, frame(spark, rows).repartition(5), "").collect()
    want = [(d, None if t is None else "".join(c for i, c in enumerate(t) if i not in covered[d])) for d, t in rows]
    assert Counter((r.doc_id, r.text) for r in left) == Counter(want)
    # the first of each stays, the others are gone; a line inside another one stays
    first = next(r.text for r in left if r.doc_id == 100)
    assert header in first and footer in first and license_.lower() in first.lower()
    assert not any(footer in r.text or header in r.text for r in left if r.doc_id in range(101, 120))


def test_closing_marks_end_a_sentence_and_short_runs_go(spark):
    draw = random.Random(23)
    inner, tail = prose(10, draw), prose(9, draw)
    rows = [(k, f'{prose(12, draw)}{stop} {inner}{stop} {prose(13, draw)}. {tail}.) {prose(7, draw)}') for k, stop in enumerate([".", '."', ".)", "!***", "?'", ".***"])]
    cuts = {k: set() for k, _ in rows}
    for r in substrings.all_repeats(frame(spark, rows)).collect():
        cuts[r.doc_id].update(range(r.begin, r.end))
    for k, text in rows:
        gone = "".join(c for i, c in enumerate(text) if i in cuts[k])
        assert re.findall(r"[a-z]+", gone) == ([] if k == 0 else (inner + " " + tail).split())


# --- test items --------------------------------------------------------------------------------------------------------


def test_wand_finds_all_above_the_threshold():
    draw = random.Random(2)
    words = VOCABULARY[:150]
    items = [" ".join(draw.choice(words) for _ in range(draw.randint(3, 70))) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), [Words(pa.array([t]), ALNUM).hashes() for t in items])
    for _ in range(60):
        passage = np.unique(Words(pa.array([" ".join(draw.choice(words) for _ in range(draw.randint(1, 90)))]), ALNUM).hashes())
        scores = np.zeros(len(index.unit_item))
        for code in np.flatnonzero(np.isin(index.terms, passage)):
            scores[index.unit[index.first[code] : index.first[code + 1]]] += index.impact[index.first[code] : index.first[code + 1]]
        for threshold in (0.3, 0.5, 0.8):
            got = dict(index.wand(passage, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
            assert all(abs(got[u] - min(1, scores[u])) < 1e-9 for u in got)


def test_candidates_hold_every_passage_above_the_threshold():
    draw = random.Random(7)
    words = VOCABULARY[:300]
    index = decontaminate.Index(list(range(80)), [Words(pa.array([" ".join(draw.choice(words) for _ in range(draw.randint(5, 120)))]), ALNUM).hashes() for _ in range(80)])
    texts = pa.array([" ".join(draw.choice(words) for _ in range(draw.randint(0, 400))) for _ in range(40)])
    found = Words(texts, ALNUM)
    hashes = found.hashes()
    candidates = set(index.candidates(found, hashes).tolist())
    base, owner = decontaminate.passages(found)
    for window in range(len(owner)):
        begin = found.first[owner[window]] + (window - base[owner[window]]) * decontaminate.STRIDE_WORDS
        end = min(begin + decontaminate.PASSAGE_WORDS, found.first[owner[window] + 1])
        if index.wand(hashes[begin:end]):
            assert window in candidates


def test_planted_items_are_found_and_clean_documents_stay(spark):
    draw = random.Random(9)
    items = [(k, prose(draw.choice([12, 30, 55, 140]), draw).capitalize() + ".") for k in range(40)] + [(40, None), (41, ""), (None, prose(20, draw))]
    rows, want = [], set()
    for k in range(80):
        text = prose(draw.randint(0, 300), draw)
        if k % 4 == 0:
            item = items[(k // 4) % 40]
            text = text + "\n" + (item[1].upper() if k % 8 else item[1]) + " " + prose(draw.randint(0, 120), draw)
            want.add((k, item[0]))
        elif k % 4 == 1:  # the question without the answer is no leak
            words = items[k % 40][1].split()
            text += " " + " ".join(words[: len(words) // 2]) + " " + prose(60, draw)
        rows.append((k, text))
    rows += [(80, None), (81, ""), (82, items[42][1]), (82, items[42][1]), (None, items[0][1])]
    want |= {(82, None), (None, 0)}
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert sum(r.doc_id == 82 for r in got) == 2 and all(r.score >= 0.5 and r.begin_word < r.end_word for r in got)
    kept = decontaminate.keep_clean(docs, bench).collect()
    assert Counter(r.doc_id for r in kept) == Counter(k for k, _ in rows if not any(k == d for d, _ in want))
    assert decontaminate.find(docs, bench.limit(0)).collect() == [] and decontaminate.find(docs.limit(0), bench).collect() == []


def test_items_in_several_passes(spark, monkeypatch):
    items = [(k, prose(25)) for k in range(9)]
    docs = frame(spark, [(k, t) for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 4)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()} == {(k, k) for k, _ in items}
    assert decontaminate.keep_clean(docs, bench).collect() == []


def test_packed_signatures_count_what_differs(spark):
    draw = np.random.default_rng(8)
    left, right = (draw.integers(0, 2**63, (30, neardup.SIZE)).astype(np.uint64) for _ in range(2))
    right[:, ::3] = left[:, ::3]
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(neardup._packed(left), neardup._packed(right), strict=True))]
    got = spark.createDataFrame(rows, "k long, a array<long>, b array<long>").select("k", neardup.differing(F.col("a"), F.col("b")).alias("n")).collect()
    want = ((left & np.uint64(15)) != (right & np.uint64(15))).sum(axis=1)
    assert {r.k: r.n for r in got} == dict(enumerate(want.tolist()))


def test_sentences_that_collide_in_a_polynomial_are_not_repeats(spark):
    ones = [bin(k).count("1") % 2 for k in range(1024)]
    texts = [" ".join("yes" if x == side else "no" for x in ones) + "." for side in (0, 1)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert substrings.repeated_passages(docs).collect() == [] and substrings.all_repeats(docs).collect() == []
    assert {r.text for r in substrings.remove(docs, substrings.all_repeats(docs)).collect()} == set(texts)
    assert substrings.row_tags(substrings.Words(pa.array(texts), substrings.ALNUM)).tolist()[0] != substrings.row_tags(substrings.Words(pa.array(texts[1:]), substrings.ALNUM)).tolist()[0]


def test_columns_with_derived_names_are_kept(spark):
    names = ["_id", "_tag", "_rows", "_stays", "_wordless", "_row_tag", "_cuts", "_cut_doc", "_cut_row", "_ROW_TAG_", "text_hash", "node", "label"]
    body = "one two three four five six seven eight nine ten eleven twelve."
    rows = [(k, body if k < 3 else f"text number {k} of its own words here", *[k] * len(names)) for k in range(6)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] not in (1, 2)}
    cut = substrings.remove(docs, substrings.all_repeats(docs))
    assert cut.columns == docs.columns and {tuple(r)[2:] for r in cut.collect()} == {r[2:] for r in rows}
    assert {r.doc_id: r.text for r in cut.collect()}[1] == ""


def test_many_rows_without_an_id(spark):
    base = [f"w{k} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k} k{k}" for k in range(500)]
    rows = [(None, t) for t in base] + [(None, f"{t} tail{k}") for k, t in enumerate(base)] + [(7, t) for t in base[:200]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.keep_one(docs).collect()]
    assert len(kept) == 500 and len({t.split()[0] for _, t in kept}) == 500
    assert all(k == 7 for k, t in kept if int(t.split()[0][1:]) < 200)
