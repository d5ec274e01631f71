"""The pipeline against plain versions of its stages."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from test_copies import classes_by_hand, passages_by_hand, prose, sentences, shingle_set
from test_tokens import REFERENCE

BAD = ["zokri", "wuvex", "qamby"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw, path = random.Random(12), tmp_path_factory.mktemp("tables")
    rows, labels = [], []

    def add(text, toxic=0):
        rows.append((len(rows), text, "en", "s", len(text or ""), "clash"))
        labels.append((rows[-1][0], 1, toxic))

    for _ in range(220):
        words = sentences(draw.randint(3, 12), draw).split(" ")
        toxic = int(draw.random() < 0.25)
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        add(" ".join(words), toxic)
    original = sentences(14, draw)
    for _ in range(15):
        words = original.split(" ")
        words[draw.randrange(len(words))] = prose(1, draw)
        add(" ".join(words))
    for _ in range(10):
        add(original)
    passage = sentences(7, draw)
    for _ in range(20):
        add(sentences(6, draw) + "\n" + passage + "\n" + sentences(6, draw))
    items = [(k, prose(30, draw)) for k in range(12)]
    for k in range(12):
        add(sentences(5, draw) + " " + items[k][1] + ". " + sentences(5, draw))
    for text in (None, "", " ", "one two", "one two"):
        add(text)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_match_plain_versions(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    texts = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(texts)
        docs = stage(spark, docs, path)
        kept = docs.collect()
        assert docs.columns == columns and len({r.doc_id for r in kept}) == len(kept)
        assert all(r.n_chars == len(r.text or "") and (r.lang, r.source, r.tag) == ("en", "s", "clash") for r in kept)
        texts = {r.doc_id: r.text for r in kept}
        if name == "toxicity":
            bad = {k for k, t in before.items() if any(w in (t or "").lower() for w in BAD)}
            assert set(texts) == set(before) - bad
        elif name == "near_duplicates":
            order = sorted(before.items())
            want = classes_by_hand(order)
            assert set(texts) == {want[i] for i in range(len(order))} | {k for k, t in order if not shingle_set(t)}
        elif name == "repeated_passages":
            cuts = defaultdict(list)
            for doc, begin, end, *_ in passages_by_hand(sorted(before.items())):
                cuts[doc].append((begin, end))
            for doc, text in before.items():
                for begin, end in sorted(cuts[doc], reverse=True):
                    text = text[:begin] + text[end:]
                assert texts[doc] == text
            assert len(cuts) >= 15
        else:
            leaks = {k for k, t in before.items() if any(item in (t or "").lower() for _, item in items)}
            assert len(leaks) == 12 and set(texts) == set(before) - leaks
        docs = spark.createDataFrame(kept, docs.schema)


def test_run_returns_the_ids_of_what_is_left(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
    want = {r.doc_id: REFERENCE.encode_ordinary(r.text or "") for r in docs.collect()}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.n_tokens == len(r.ids) for r in got)


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
