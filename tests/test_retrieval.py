"""Search, ranking, screening and verification on small tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carefold.operators import evidence, insights, lineage, retrieval, vector_index, verification
from carefold.sources import knowledge


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_blocked_search_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    passages = rng.normal(size=(90, 8))
    passages[17] = passages[3]  # equal vectors: the lower id comes first
    queries = rng.normal(size=(25, 8))
    cats = ["monitoring", "follow_up"]
    p = spark.createDataFrame(
        [(k, cats[k % 3 == 0], [float(x) for x in v]) for k, v in enumerate(passages)],
        "passage_id long, category string, vector array<double>")
    q = spark.createDataFrame(
        [(k, "general" if k % 5 == 0 else cats[k % 2], [float(x) for x in v]) for k, v in enumerate(queries)],
        "query_id long, category string, vector array<double>")
    everywhere = p.unionByName(p.withColumn("category", F.lit("general")))
    got = {}
    for r in retrieval.blocked_top_k(q, everywhere, 4, block_rows=block_rows).collect():
        got.setdefault(r.query_id, []).append((r.hit_rank, r.passage_id, r.score))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(queries) @ unit(passages).T
    for k in range(25):
        allowed = [j for j in range(90) if k % 5 == 0 or cats[j % 3 == 0] == cats[k % 2]]
        best = sorted(allowed, key=lambda j: (-round(scores[k, j], 12), j))[:4]
        hits = sorted(got[k])
        assert [h[1] for h in hits] == best
        assert [h[2] for h in hits] == pytest.approx([scores[k, j] for j in best])
    assert got.keys() == set(range(25))
    found = retrieval.search_knowledge(q, p, 4)
    assert {(r.query_id, r.hit_rank, r.passage_id) for r in found.collect()} == {
        (k, h[0], h[1]) for k, hits in got.items() for h in hits}


def test_ranking_lifts_passages_found_by_several_queries(spark):
    rows = [  # guideline, score, query
        ("a", 0.80, "q1"), ("b", 0.78, "q1"), ("b", 0.79, "q2"), ("b", 0.40, "q3"), ("c", 0.49, "q1"),
        ("d", 0.80, "q4"), ("e", 0.9, "q1"),
    ]
    df = spark.createDataFrame(
        [(1, g, "" if g == "e" else "text", s, q, k) for k, (g, s, q) in enumerate(rows)],
        "patient_id int, guideline_id string, text string, relevance_score double, retrieval_query string, arrival int")
    got = retrieval.rank_candidates(df).orderBy("rank").collect()
    # b: best 0.79 with three queries, one of them below the floor.
    assert [(r.guideline_id, r.relevance_score, r.query_count) for r in got] == [("b", 0.79, 3), ("a", 0.8, 1), ("d", 0.8, 1)]
    assert [r.guideline_id for r in retrieval.rank_candidates(df, max_results=1).collect()] == ["b"]


def test_equal_queries_count_once(spark):
    coded = spark.createDataFrame(
        [(1, "t1", "diagnosis", "Gout", "M10.9", False), (1, "t2", "diagnosis", "gout ", "M10.9", False),
         (1, "t3", "diagnosis", "Anemia", "D64.9", True)],
        "patient_id int, temp_id string, entity_type string, normalized_value string, canonical_code string, is_negated boolean",
    ).withColumn("raw_value", F.col("normalized_value"))
    planned = retrieval.plan_queries(retrieval.disease_queries(coded)).orderBy("rank").collect()
    # Both spellings ask for one set of criteria; a negated finding asks for nothing.
    assert [(r.category, r.priority, r.source_entity_ids) for r in planned] == [
        ("disease_guideline", 3, ["t1"]), ("disease_guideline", 3, ["t2"]), ("diagnostic_criteria", 1, ["t1"])]


def test_guideline_passages_number_the_file(spark):
    rows = knowledge.guideline_passages(knowledge.builtin_guidelines(spark)).orderBy("passage_id").collect()
    assert [r.passage_id for r in rows] == list(range(1, 15))
    assert rows[0].text.startswith("Condition: Type 2 Diabetes Mellitus. Metric: HbA1c (LOINC: 4548-4).")


POOL = "patient_id int, evidence_id string, source_type string, source_ref string, text string, relevance_score double, entity_ids array<string>, branch int"


@pytest.fixture(scope="module")
def pool(spark):
    rows = [
        (1, "e1", "pso_entity", "r", "one", 0.9, ["x", "y"], 0), (1, "e1", "guideline", "r", "newer", 0.8, ["y"], 3),
        (1, "e2", "pso_entity", "r", "two", 0.5, ["y", "z"], 1), (1, "low", "pso_entity", "r", "low", 0.49, [], 1),
        (2, "e9", "guideline", "r", "nine", 1.0, [], 3),
    ]
    return evidence.pool(spark.createDataFrame(rows, POOL))


def test_pool_and_block(pool):
    assert {(r.patient_id, r.evidence_id, r.text) for r in pool.collect()} == {
        (1, "e1", "newer"), (1, "e2", "two"), (2, "e9", "nine")}
    block = {r.patient_id: r.evidence_block for r in evidence.evidence_block(pool).collect()}[1]
    assert block == "- [e1] (guideline, relevance=0.80) newer\n- [e2] (pso_entity, relevance=0.50) two"


def test_screening(spark, pool):
    rows = [
        (1, 0, "trend", "high", 0.9, ["e2", "nope", "e1"], " keep ", "p"),
        (1, 1, "trend", "odd", 0.55, ["e1"], "edge", "p"),
        (1, 2, "trend", "low", 0.54, ["e1"], "unsure", "p"),
        (1, 3, "trend", "low", 0.9, ["e9"], "other patient's", "p"),
        (1, 4, "trend", "low", 0.9, ["e1"], "blank", "  "),
    ] + [(1, k, "trend", "low", 0.9, ["e1"], f"late {k}", "p") for k in range(5, 12)]
    df = spark.createDataFrame(rows, "patient_id int, pos int, insight_type string, severity string, confidence double, "
                               "evidence_ids array<string>, clinician_facing_text string, patient_facing_text string")
    drafts = insights.screen_candidates(df, pool).orderBy("pos").collect()
    assert [(d.pos, d.text, d.severity) for d in drafts] == [
        (0, "keep", "high"), (1, "edge", "informational"), (5, "late 5", "low"), (6, "late 6", "low"), (7, "late 7", "low")]
    assert drafts[0].supporting_evidence_ids == ["e2", "e1"] and drafts[0].supporting_entity_ids == ["y", "z"]
    assert {r.evidence_id for r in insights.dropped_citations(df, pool).collect()} == {"nope", "e9"}


def test_verification(spark, pool):
    drafts = spark.createDataFrame(
        [(1, d, ids, sev, "t", "p", "c", []) for d, ids, sev in (
            ("ok", ["e1"], "low"), ("high", ["e1"], "high"), ("weak", ["e1"], "low"), ("part", ["e1"], "low"),
            ("contra", ["e1"], "low"), ("none", ["e1"], "low"), ("silent", ["e1"], "low"), ("lost", ["e9"], "low"))],
        "patient_id int, draft_id string, supporting_evidence_ids array<string>, severity string, text string, "
        "patient_facing_text string, clinician_facing_text string, supporting_entity_ids array<string>")
    checks = [("ok", 0, True, 0.9, ["e1", "e2"], []), ("high", 0, True, 0.9, ["e1"], []), ("weak", 0, True, 0.7, [], []),
              ("part", 0, True, 0.9, ["e1"], []), ("part", 1, False, 0.9, [], []),
              ("contra", 0, True, 1.0, ["e1"], ["e2", "nope"]), ("none", 0, False, 0.9, [], []), ("lost", 0, True, 1.0, [], [])]
    assertions = spark.createDataFrame(
        [(d, p, "claim", s, c, a, b) for d, p, s, c, a, b in checks],
        "draft_id string, pos int, assertion_text string, supported boolean, confidence double, "
        "supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>")
    screened = {(r.draft_id, r.pos): r for r in verification.screen_assertions(assertions, drafts, pool).collect()}
    assert screened[("ok", 0)].supporting == ["e1"] and screened[("contra", 0)].contradicting == ["e2"]
    verified = verification.verify(drafts, assertions, pool)
    got = {r.draft_id: (r.verification_status, r.verification_confidence, r.requires_clinician_review, r.stored_status)
           for r in verified.collect()}
    assert got == {
        "ok": ("auto_verified", 0.9, False, "approved"), "high": ("auto_verified", 0.9, True, "approved"),
        "weak": ("flagged", 0.7, True, "pending"), "part": ("flagged", 0.45, True, "pending"),
        "contra": ("flagged", 1.0, True, "pending")}
    assert {r.draft_id for r in verification.rejected(drafts, verified).collect()} == {"none", "silent", "lost"}


def test_an_index_covers_all_vectors_and_finds_most(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(k, "a" if k % 3 else "b", (centres[k % 30] + 0.3 * rng.normal(size=16)).tolist()) for k in range(1500)] + [(1500, "a", [0.0] * 16), (1501, None, [1.0] * 16)]
    passages = spark.createDataFrame(rows, "passage_id long, category string, vector array<double>")
    index = vector_index.CellIndex.build(passages, str(tmp_path / "ix"), cells=20, sample=400)
    assert index.passages().count() == 1502 and index.passages().select("cell").distinct().count() <= 20
    asked = passages.filter("passage_id % 20 = 0 AND passage_id < 1500").withColumnRenamed("passage_id", "query_id")
    exact = retrieval.blocked_top_k(asked, passages, 5)
    share = vector_index.recall(exact, index.search(asked, 5, probes=4)).first()
    assert (share.queries, share.wanted) == (75, 375) and share.recall >= 0.9
    everything = index.search(asked, 5, probes=20)
    assert {tuple(r) for r in everything.select("query_id", "passage_id", "hit_rank").collect()} == {
        tuple(r) for r in exact.select("query_id", "passage_id", "hit_rank").collect()}
    empty = vector_index.CellIndex.build(passages.limit(0), str(tmp_path / "e"), cells=4)
    assert empty.search(asked.limit(0), 5).collect() == []


def test_entities_behind_references(spark):
    points = spark.createDataFrame([(1, "c", "e1"), (1, "c", "e2"), (2, "c", "e3"), (1, "d", "e4")], "patient_id long, code string, entity_id string")
    rows = spark.createDataFrame(
        [(1, "x", ["trend:c", "own", "own", None]), (2, "y", ["trend:c", "trend:none"]), (2, "z", None), (1, "w", ["trend:c", "trend:d"])],
        "patient_id long, item string, refs array<string>")
    found = {tuple(r) for r in lineage.entities_behind(rows, points, ["patient_id", "item"], "refs").collect()}
    assert found == {(1, "x", "own"), (1, "x", "e1"), (1, "x", "e2"), (2, "y", "e3"), (1, "w", "e1"), (1, "w", "e2"), (1, "w", "e4")}


def test_of_equal_ids_the_one_added_last_stays(spark):
    items = spark.createDataFrame(
        [("p", 1, "g1", "zz first", "s", None, None, 0.9), ("p", 2, "g1", "aa last", "s", None, None, 0.8), ("p", 3, "g1", "below", "s", None, None, 0.1)],
        "patient_id string, rank int, guideline_id string, text string, source string, section string, citation string, relevance_score double")
    (row,) = evidence.pool(evidence.guideline_evidence(items), min_relevance=0.5).collect()
    assert row.text == "aa last"


def test_a_full_cell_is_scored_in_little_memory():
    n, draw = 4096, np.random.default_rng(3)
    vectors = draw.normal(size=(n, 16))
    vectors[100:120] = vectors[7]
    side = lambda key: pd.DataFrame({key: np.arange(n), "vector": list(vectors)})
    search, queries, passages = retrieval._cell_search(8), side("query_id"), side("passage_id").sample(frac=1, random_state=1)
    tracemalloc.start()
    found = search(queries, passages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    assert len(found) == n * 8 and (found.groupby("query_id").size() == 8).all()
    best = np.sort(scores, axis=1)[:, ::-1][:, :8]
    assert np.allclose(found["score"].to_numpy().reshape(n, 8), best)
    assert np.allclose(scores[found["query_id"], found["passage_id"]], found["score"])
    assert search(queries.head(0), passages).empty
