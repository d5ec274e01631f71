"""Retrieval, evidence, insight, verification and evaluation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.functions.runs import run_keys
from carefold.operators import evaluation, evidence, insights, lineage, retrieval, vector_index, verification
from carefold.plans.inputs import ENTITIES, Inputs, sql_select
from carefold.plans.registry import framed, query, values_sql
from carefold.plans.trend_queries import TREND_SQL, trend_table
from carefold.session import shared_folder
from carefold.sources import knowledge, tables
from carefold.sources import knowledge_values as kv

#: Of 64 cells; vectors without groups of their own need many.
INDEX_PROBES = 32

_ENTS = sql_select(ENTITIES, "lineitem")
_USE = f"""u AS (SELECT *, coalesce(nullif(normalized_value, ''), raw_value) AS name,
  coalesce(' ' || nullif(unit_canonical, ''), '') AS un FROM ({_ENTS}) e WHERE canonical_code IS NOT NULL AND NOT is_negated)"""
_LAB_Q = """SELECT patient_id, 'clinical interpretation of ' || name || un || ' lab result' AS text, 'lab_interpretation' AS category, 2 AS priority,
    temp_id AS source, 0 AS branch, temp_id AS arrival, 0 AS part FROM u WHERE entity_type = 'lab_value'
  UNION ALL SELECT patient_id, 'normal reference range for ' || name, 'reference_range', 1, temp_id, 0, temp_id, 1 FROM u
    WHERE entity_type = 'lab_value' AND (reference_range_low IS NULL OR reference_range_high IS NULL)"""
_DIS_Q = """SELECT patient_id, 'clinical practice guideline for ' || name || ' management' AS text, 'disease_guideline' AS category, 3 AS priority,
    temp_id AS source, 1 AS branch, temp_id AS arrival, 0 AS part FROM u WHERE entity_type IN ('diagnosis', 'procedure')
  UNION ALL SELECT patient_id, 'diagnostic criteria for ' || name, 'diagnostic_criteria', 1, temp_id, 1, temp_id, 1 FROM u
    WHERE entity_type IN ('diagnosis', 'procedure')"""
_MED_Q = """SELECT patient_id, 'dosing and monitoring guidance for ' || name AS text, 'medication_guidance' AS category, 2 AS priority,
    temp_id AS source, 2 AS branch, temp_id AS arrival, 0 AS part FROM u WHERE entity_type = 'medication'
  UNION ALL SELECT patient_id, 'contraindications and precautions for ' || name, 'contraindication', 1, temp_id, 2, temp_id, 1 FROM u
    WHERE entity_type = 'medication'"""
_TREND_Q = """SELECT patient_id, 'monitoring frequency recommendations for ' || metric_name AS text, 'monitoring' AS category, 2 AS priority,
    'trend:' || code AS source, 3 AS branch, code AS arrival, 0 AS part FROM tr WHERE gap
  UNION ALL SELECT patient_id, 'follow-up recommendations for ' || clinical_trend || ' ' || metric_name, 'follow_up', 3, 'trend:' || code, 3, code, 1
    FROM tr WHERE reason IS NOT NULL OR clinical_trend = 'worsening'"""
_CONTEXT = "CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN ' Review of ' || c_mktsegment || ' ' END"
_CONTEXT_Q = f"""SELECT c_custkey AS patient_id, trim({_CONTEXT}) AS text, 'general' AS category, 1 AS priority, '' AS source, 4 AS branch,
    '0' AS arrival, 0 AS part FROM customer WHERE trim({_CONTEXT}) <> ''"""


def _flat(queries: DataFrame) -> DataFrame:
    return queries.select(
        "patient_id", "text", "category", "priority", F.array_join("source_entity_ids", ",").alias("source")
    )


def _both(df: DataFrame) -> DataFrame:
    """Rows of a patient in both runs."""
    return df.withColumn("run_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))


def _contexts(i: Inputs) -> DataFrame:
    return i.table("customer").selectExpr("c_custkey AS patient_id", f"{_CONTEXT} AS clinical_context")


for _name, _sql, _build in (
    ("lab_queries", f"WITH {_USE} SELECT patient_id, text, category, priority, source FROM ({_LAB_Q}) q",
     lambda i: retrieval.lab_queries(i.entities())),
    ("disease_queries", f"WITH {_USE} SELECT patient_id, text, category, priority, source FROM ({_DIS_Q}) q",
     lambda i: retrieval.disease_queries(i.entities())),
    ("medication_queries", f"WITH {_USE} SELECT patient_id, text, category, priority, source FROM ({_MED_Q}) q",
     lambda i: retrieval.medication_queries(i.entities())),
    ("trend_follow_up_queries", TREND_SQL + f"SELECT patient_id, text, category, priority, source FROM ({_TREND_Q}) q",
     lambda i: retrieval.trend_queries(trend_table(i))),
    ("context_queries", f"SELECT patient_id, text, category, priority, source FROM ({_CONTEXT_Q}) q",
     lambda i: retrieval.context_queries(_contexts(i))),
):
    query(_name, _sql)(lambda i, build=_build: _flat(build(i)))


@query("planned_queries", TREND_SQL + f""", {_USE},
q AS (SELECT *, CAST(split_part(source, '-', 1) AS BIGINT) % 2 AS run_id FROM ({_LAB_Q} UNION ALL {_DIS_Q} UNION ALL {_MED_Q}) e
  UNION ALL SELECT t.*, x.run_id FROM ({_TREND_Q} UNION ALL {_CONTEXT_Q}) t, (VALUES (0), (1)) x(run_id)),
k AS (SELECT *, category || ':' || lower(trim(text)) AS key,
  row_number() OVER (PARTITION BY patient_id, run_id, category || ':' || lower(trim(text)) ORDER BY priority DESC, branch, arrival, part) AS dup,
  first_value((branch, arrival, part)) OVER (PARTITION BY patient_id, run_id, category || ':' || lower(trim(text)) ORDER BY branch, arrival, part) AS pos FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, run_id ORDER BY priority DESC, pos) AS rank FROM k WHERE dup = 1)
SELECT patient_id, run_id, rank, text, category, priority, source FROM r WHERE rank <= 6""")
def planned_queries(i: Inputs) -> DataFrame:
    """Two documents, so two runs, of every patient, each with its own six queries."""
    entities = i.entities().withColumn("run_id", F.col("document_id").cast("long") % 2)
    planned = retrieval.plan_queries(
        retrieval.entity_queries(entities), retrieval.trend_queries(_both(trend_table(i))), retrieval.context_queries(_both(_contexts(i))),
    )
    return planned.select(
        "patient_id", "run_id", "rank", "text", "category", "priority",
        F.array_join("source_entity_ids", ",").alias("source"),
    )


# --------------------------------------------------------------------------- search
def _passages(i: Inputs) -> DataFrame:
    return i.table("embeddings").select(
        F.col("vec_id").alias("passage_id"), F.concat(F.lit("c"), "label").alias("category"),
        F.col("embedding").alias("vector"),
    )


def _vector_queries(i: Inputs) -> DataFrame:
    return i.table("embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("label") == 0, "general").otherwise(F.concat(F.lit("c"), "label")).alias("category"),
        F.col("embedding").alias("vector"),
    )


_HITS = """hits AS (SELECT * FROM (SELECT q.vec_id AS query_id, p.vec_id AS passage_id,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, p.vec_id) AS hit_rank,
    q.label AS qlabel, p.label AS plabel
  FROM embeddings q JOIN embeddings p ON (q.label = 0 OR q.label = p.label)) x WHERE hit_rank <= 8)"""


def hits(i: Inputs) -> DataFrame:
    return retrieval.search_knowledge(_vector_queries(i), _passages(i))


@query("knowledge_search", f"WITH {_HITS} SELECT query_id, passage_id, hit_rank, round(score, 4) AS score FROM hits")
def knowledge_search(i: Inputs) -> DataFrame:
    return hits(i).select("query_id", "passage_id", "hit_rank", F.round("score", 4).alias("score"))


@query("indexed_search", """
SELECT (SELECT count(*) FROM embeddings) AS indexed, count(*) AS queries, count(*) * 8 AS wanted, TRUE AS recall_reached FROM embeddings WHERE vec_id % 20 = 0""")
def indexed_search(i: Inputs) -> DataFrame:
    """The index over all vectors, and whether the eight nearest of every twentieth vector are found, at 0.9 at least."""
    passages = _passages(i).withColumn("category", F.lit("all"))
    asked = passages.filter("passage_id % 20 = 0").withColumnRenamed("passage_id", "query_id")
    index = vector_index.CellIndex.build(passages, f"{shared_folder(i.spark)}/cells-{uuid.uuid4().hex}", cells=64)
    exact = retrieval.blocked_top_k(asked, passages, 8)
    measured = vector_index.recall(exact, index.search(asked, 8, probes=INDEX_PROBES))
    return measured.join(F.broadcast(index.passages().agg(F.count("*").alias("indexed")))).select(
        "indexed", "queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached")
    )


@query("patient_history_search", """
WITH h AS (SELECT q.vec_id AS query_id, p.vec_id AS passage_id,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings p ON q.vec_id % 20 = p.vec_id % 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS hit_rank FROM h WHERE score >= 0.75)
SELECT query_id, passage_id, hit_rank, round(score, 4) AS score FROM r WHERE hit_rank <= 5""")
def patient_history_search(i: Inputs) -> DataFrame:
    vectors = i.table("embeddings").select(
        F.col("vec_id"), (F.col("vec_id") % 20).alias("patient_id"), F.col("embedding").alias("vector")
    )
    return retrieval.search_history(
        vectors.withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "passage_id")
    ).select("query_id", "passage_id", "hit_rank", F.round("score", 4).alias("score"))


_PAYLOAD = {
    "passage_id": "vec_id",
    "guideline_id": "CASE WHEN vec_id % 2 = 0 THEN 'g' || CAST(vec_id % 90 AS string) END",
    "source": "CASE WHEN vec_id % 3 = 0 THEN 'Source A' WHEN vec_id % 3 = 1 THEN '' END",
    "evidence_source": "CASE WHEN vec_id % 4 = 0 THEN 'Evidence B' END",
    "section": "CASE WHEN vec_id % 5 = 0 THEN 'Section ' || CAST(vec_id % 6 AS string) END",
    "condition": "CASE WHEN vec_id % 2 = 1 THEN 'condition' END",
    "title": "CASE WHEN vec_id % 7 = 0 THEN 'Title' END",
    "display_name": "CASE WHEN vec_id % 7 = 1 THEN 'Display' END",
    "metric_name": "CASE WHEN vec_id % 7 = 2 THEN 'Metric' END",
    "category": "CASE WHEN vec_id % 4 = 1 THEN 'monitoring' WHEN vec_id % 4 = 2 THEN 'unheard' END",
    "citation": "CASE WHEN vec_id % 9 = 0 THEN 'Cited' END",
    "text": "CASE WHEN vec_id % 10 <> 3 THEN 'Passage ' || CAST(vec_id AS string) END",
    "reference_range_low": "CAST(NULL AS double)",
    "reference_range_high": "CAST(NULL AS double)",
    "reference_range_unit": "CAST(NULL AS string)",
}
_CANDIDATES = _HITS + f""", pl AS ({sql_select(_PAYLOAD, 'embeddings')}),
cand AS (SELECT h.query_id % 25 AS patient_id, h.query_id // 25 % 2 AS run_id, coalesce(guideline_id, CAST(h.passage_id AS VARCHAR)) AS guideline_id,
  coalesce(nullif(source, ''), evidence_source, 'Clinical Guideline') AS source, coalesce(section, condition) AS section,
  coalesce(title, display_name, metric_name, condition, nullif(source, ''), evidence_source, 'Clinical Guideline') AS title, text,
  CASE WHEN category = 'monitoring' THEN category ELSE 'follow_up' END AS category, round(score, 4) AS relevance_score,
  coalesce(citation, coalesce(nullif(source, ''), evidence_source, 'Clinical Guideline') || ' -- ' || coalesce(section, condition),
    coalesce(nullif(source, ''), evidence_source, 'Clinical Guideline')) AS citation,
  'query ' || CAST(query_id AS VARCHAR) AS retrieval_query, query_id * 100 + hit_rank AS arrival
  FROM hits h JOIN pl ON pl.passage_id = h.passage_id WHERE text IS NOT NULL)"""
_RANKED = _CANDIDATES + """, n AS (SELECT patient_id, run_id, guideline_id, count(DISTINCT retrieval_query) AS qc FROM cand GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY patient_id, run_id, guideline_id ORDER BY relevance_score DESC, arrival) AS rn,
  min(arrival) OVER (PARTITION BY patient_id, run_id, guideline_id) AS fa FROM cand WHERE relevance_score >= 0.5),
sc AS (SELECT b.*, qc, relevance_score + least(0.12::DOUBLE, (qc - 1) * 0.03::DOUBLE) AS boosted FROM b JOIN n USING (patient_id, run_id, guideline_id) WHERE rn = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY patient_id, run_id ORDER BY boosted DESC, fa) AS rank FROM sc)
"""


def candidates(i: Inputs) -> DataFrame:
    payload = i.derive("embeddings", _PAYLOAD)
    found = hits(i).select(
        (F.col("query_id") % 25).alias("patient_id"), F.floor(F.col("query_id") / 25 % 2).alias("run_id"), "passage_id", "score",
        F.lit("follow_up").alias("query_category"),
        F.concat(F.lit("query "), "query_id").alias("query_text"),
        (F.col("query_id") * 100 + F.col("hit_rank")).alias("arrival"),
    )
    return retrieval.to_candidates(retrieval.attach_payload(found, payload))


@query("knowledge_candidates", f"WITH {_CANDIDATES} SELECT patient_id, run_id, guideline_id, title, source, section, text, category, relevance_score, citation, retrieval_query FROM cand")
def knowledge_candidates(i: Inputs) -> DataFrame:
    return candidates(i).drop(
        "arrival", "reference_range_low", "reference_range_high", "reference_range_unit"
    )


@query("ranked_knowledge", f"WITH {_RANKED} SELECT patient_id, run_id, rank, guideline_id, relevance_score, qc AS query_count, retrieval_query FROM rk WHERE rank <= 10")
def ranked_knowledge(i: Inputs) -> DataFrame:
    return retrieval.rank_candidates(candidates(i)).select(
        "patient_id", "run_id", "rank", "guideline_id", "relevance_score", "query_count", "retrieval_query"
    )


@query("knowledge_items", f"WITH {_RANKED} SELECT patient_id, run_id, rank, guideline_id, title, source, section, text, relevance_score, category, citation FROM rk WHERE rank <= 10")
def knowledge_items(i: Inputs) -> DataFrame:
    return retrieval.to_knowledge_items(retrieval.rank_candidates(candidates(i))).select(
        "patient_id", "run_id", "rank", "guideline_id", "title", "source", "section", "text",
        "relevance_score", "category", "citation",
    )


@query("text_vectors", r"""
WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
c AS (SELECT document_id, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
d AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM c GROUP BY bucket),
r AS (SELECT document_id, bucket, tf * idf AS raw FROM c JOIN d USING (bucket)),
n AS (SELECT document_id, sqrt(sum(raw * raw)) AS length FROM r GROUP BY document_id)
SELECT document_id, bucket, round(raw / length, 6) AS weight FROM r JOIN n USING (document_id) WHERE length > 0""")
def text_vectors(i: Inputs) -> DataFrame:
    """Hashed TF-IDF weights of all documents."""
    weights = retrieval.hashed_weights(i.texts(), "document_id", features=64)
    return weights.select("document_id", "bucket", F.round("weight", 6).alias("weight"))


_PASSAGES = values_sql(
    [(n, c, m, f"Condition: {d}. Metric: {name} (LOINC: {m}). Interval: {text}. Source: {src}.")
     for n, (c, d, m, name, text, src) in enumerate(
         ((c, d, m, name, text, src) for c, d, _, ms in kv.GUIDELINES for m, name, _, text, src in ms), 1)],
    "passage_id, condition, metric_code, text",
)


@query("guideline_passages", f"""
WITH o AS (SELECT DISTINCT user_id AS patient_id, CASE event_type WHEN 'click' THEN '2160-0' WHEN 'view' THEN '33914-3' WHEN 'error' THEN '718-7'
  WHEN 'signup' THEN '4548-4' ELSE '2823-3' END AS metric_code FROM events)
SELECT o.patient_id, v.passage_id, v.condition, v.text FROM o JOIN {_PASSAGES} ON v.metric_code = o.metric_code""")
def guideline_passages(i: Inputs) -> DataFrame:
    """The guideline passages that concern a patient's measured metrics."""
    passages = knowledge.guideline_passages(knowledge.builtin_guidelines(i.spark))
    measured = i.observations().select(
        "patient_id",
        F.when(F.col("code") == "6690-2", "2823-3").otherwise(F.col("code")).alias("metric_code"),
    ).distinct()
    return measured.join(F.broadcast(passages), "metric_code").select(
        "patient_id", "passage_id", "condition", "text"
    )


# --------------------------------------------------------------------------- evidence
_UUID = ("(h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') "
         "|| h[18:20] || '-' || h[21:32])")
_OBS_EV = f"""SELECT patient_id, 'obs-' || temp_id AS evidence_id, 'pso_entity' AS source_type, document_id AS source_ref,
  CASE WHEN canonical_code IS NOT NULL THEN coalesce(entity_label, entity_type) || ': ' || coalesce(nullif(normalized_value, ''), raw_value)
    || coalesce(' ' || unit_canonical, ' ' || unit_raw, '') || coalesce(' on ' || strftime(entity_date, '%Y-%m-%d'), '')
    || CASE WHEN reference_range_low IS NOT NULL THEN ' (reference range ' || reference_range_low || '-' || reference_range_high || ' ' || reference_range_unit || ')' ELSE '' END
    || ' [' || coding_system || ' ' || canonical_code || ']' || CASE WHEN is_negated THEN ' [negated / not present]' ELSE '' END
  ELSE coalesce(entity_label, entity_type) || ': ' || raw_value || coalesce(' ' || unit_raw, '') || ' [uncoded]'
    || CASE WHEN is_negated THEN ' [negated / not present]' ELSE '' END END AS text,
  round(CASE WHEN canonical_code IS NOT NULL THEN coding_confidence ELSE combined_confidence END, 4) AS relevance_score, temp_id, document_id
  FROM ({_ENTS}) e"""
_TREND_EV = """SELECT patient_id, 'trend-' || code AS evidence_id, 'pso_entity' AS source_type, 'trend:' || code AS source_ref,
  concat_ws('; ', metric_name || ' trend: ' || direction, 'clinical trend: ' || clinical_trend,
    CASE WHEN prev_value IS NOT NULL AND prev_value <> 0 THEN printf('change: %.1f%%', (last_value - prev_value) / abs(prev_value) * 100.0) END,
    CASE WHEN n > 1 AND elapsed > 0 THEN 'rate: ' || printf('%.4g', (last_value - first_value) / elapsed) || '/day' END,
    CASE WHEN persistent THEN 'abnormal persistence across recent readings' END,
    CASE WHEN crossings > 0 THEN crossings || ' reference-range crossing(s)' END,
    'significance: ' || reason, 'last measured ' || strftime(last_ts, '%Y-%m-%d')) AS text, confidence AS relevance_score, 1 AS branch FROM tr"""
_GAP_EV = """SELECT patient_id, 'gap-' || code AS evidence_id, 'pso_entity' AS source_type, 'gap:' || code AS source_ref,
  'Monitoring gap for ' || metric_name || ': no measurement since ' || strftime(last_ts, '%Y-%m-%d') || ' (expected every ' || interval_days || ' day(s))' AS text,
  confidence AS relevance_score, 2 AS branch FROM tr WHERE gap"""


def _flat_evidence(df: DataFrame) -> DataFrame:
    return df.select(
        *run_keys(df), "evidence_id", "source_type", "source_ref", "text",
        F.round("relevance_score", 4).alias("relevance_score"),
    )


@query("observation_evidence", f"WITH o AS ({_OBS_EV}), x AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('entity:' || document_id || ':' || temp_id)) AS h FROM o) "
       f"SELECT patient_id, evidence_id, source_type, source_ref, text, relevance_score, {_UUID} AS entity_ids FROM x")
def observation_evidence(i: Inputs) -> DataFrame:
    df = evidence.observation_evidence(i.entities())
    return _flat_evidence(df).join(
        df.select("patient_id", "evidence_id", F.array_join("entity_ids", ",").alias("entity_ids")),
        ["patient_id", "evidence_id"],
    )


@query("uncoded_evidence", f"SELECT patient_id, evidence_id, text FROM ({_OBS_EV}) o WHERE contains(text, '[uncoded]')")
def uncoded_evidence(i: Inputs) -> DataFrame:
    return evidence.observation_evidence(i.entities().filter("canonical_code IS NULL")).select(
        "patient_id", "evidence_id", "text"
    )


@query("trend_evidence", TREND_SQL + f"SELECT patient_id, evidence_id, source_type, source_ref, text, relevance_score FROM ({_TREND_EV}) t")
def trend_evidence(i: Inputs) -> DataFrame:
    return _flat_evidence(evidence.trend_evidence(trend_table(i)).filter("branch = 1"))


@query("gap_evidence", TREND_SQL + f"SELECT patient_id, evidence_id, source_type, source_ref, text, relevance_score FROM ({_GAP_EV}) t")
def gap_evidence(i: Inputs) -> DataFrame:
    return _flat_evidence(evidence.trend_evidence(trend_table(i)).filter("branch = 2"))


@query("trend_evidence_entities", TREND_SQL + """
SELECT tr.patient_id, 'trend-' || tr.code AS evidence_id, o.entity_id FROM tr JOIN obs o ON o.patient_id = tr.patient_id AND o.code = tr.code
UNION ALL SELECT tr.patient_id, 'gap-' || tr.code, o.entity_id FROM tr JOIN obs o ON o.patient_id = tr.patient_id AND o.code = tr.code WHERE gap""")
def trend_evidence_entities(i: Inputs) -> DataFrame:
    """The points behind every trend and gap."""
    items = evidence.trend_evidence(trend_table(i))
    return lineage.entities_behind(items, i.observations(), ["patient_id", "evidence_id"], "entity_ids")


@query("trend_query_entities", TREND_SQL + f"""
SELECT q.patient_id, q.category, q.text, o.entity_id FROM ({_TREND_Q}) q JOIN obs o ON o.patient_id = q.patient_id AND 'trend:' || o.code = q.source""")
def trend_query_entities(i: Inputs) -> DataFrame:
    """The points that monitoring and follow-up queries come from."""
    asked = retrieval.trend_queries(trend_table(i))
    return lineage.entities_behind(asked, i.observations(), ["patient_id", "category", "text"], "source_entity_ids")


@query("guideline_evidence", f"""WITH {_RANKED}
SELECT patient_id, run_id, 'guideline-' || guideline_id AS evidence_id, 'guideline' AS source_type, citation AS source_ref, text,
  greatest(0.0, least(1.0, relevance_score)) AS relevance_score FROM rk WHERE rank <= 10""")
def guideline_evidence(i: Inputs) -> DataFrame:
    items = retrieval.to_knowledge_items(retrieval.rank_candidates(candidates(i)))
    return _flat_evidence(evidence.guideline_evidence(items))


_POOL = f"""ev AS (SELECT t.*, x.run_id FROM ({_TREND_EV} UNION ALL {_GAP_EV}
  UNION ALL SELECT patient_id, 'trend-' || code, 'pso_entity', 'note:' || code, 'Noted again', 0.9, 3 FROM tr WHERE patient_id % 10 = 0) t, (VALUES (0), (1)) x(run_id)
  WHERE x.run_id = 0 OR relevance_score >= 0.75),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, run_id, evidence_id ORDER BY branch DESC) AS rn,
  min(branch) OVER (PARTITION BY patient_id, run_id, evidence_id) AS first_branch FROM ev WHERE relevance_score >= 0.7) z WHERE rn = 1)"""


def evidence_pool(i: Inputs) -> DataFrame:
    """Trend and gap items, and for some patients a later item of the same id."""
    items = evidence.trend_evidence(trend_table(i))
    repeated = (F.col("patient_id") % 10 == 0) & (F.col("branch") == 1)
    again = F.struct(
        F.regexp_replace("source_ref", "^trend:", "note:").alias("source_ref"),
        F.lit("Noted again").alias("text"), F.lit(0.9).alias("relevance_score"),
        F.lit(3).alias("branch"),
    )
    own = F.struct("source_ref", "text", "relevance_score", "branch")
    both = items.withColumn(
        "v", F.explode(F.array_compact(F.array(own, F.when(repeated, again))))
    ).select("patient_id", "evidence_id", "source_type", "v.*", "entity_ids")
    # the second run of a patient saw the surer items only
    runs = _both(both).filter("run_id = 0 OR relevance_score >= 0.75")
    return evidence.pool(runs, min_relevance=0.7)


@query("evidence_pool", TREND_SQL + f", {_POOL} SELECT patient_id, run_id, evidence_id, source_type, source_ref, text, round(relevance_score, 4) AS relevance_score FROM pool")
def evidence_pool_rows(i: Inputs) -> DataFrame:
    """Evidence above the floor; a later item of the same id replaces the earlier one."""
    return _flat_evidence(evidence_pool(i))


@query("evidence_blocks", TREND_SQL + f""", {_POOL} SELECT patient_id, run_id, string_agg(
  '- [' || evidence_id || '] (' || source_type || ', relevance=' || printf('%.2f', relevance_score) || ') ' || text, chr(10) ORDER BY first_branch, evidence_id) AS evidence_block
FROM pool GROUP BY patient_id, run_id""")
def evidence_blocks(i: Inputs) -> DataFrame:
    return evidence.evidence_block(evidence_pool(i))


# --------------------------------------------------------------------------- insights
_CODES = ["2160-0", "33914-3", "718-7", "4548-4", "6690-2", "9999-9", "8888-8"]
_CODE_CASE = lambda x: f"(CASE {x} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES)) + " END)"
_CANDIDATE = {
    "patient_id": "doc_id % 150",
    "run_id": "CAST(floor(doc_id / 150) AS bigint) % 2",
    "pos": "CAST(floor(doc_id / 150) AS int)",
    "insight_type": "'trend'",
    "severity": "CASE doc_id % 7 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'severe' "
                "ELSE 'informational' END",
    "confidence": "((doc_id * 37) % 101) / 101e0",
    "clinician_facing_text": "CASE WHEN doc_id % 17 = 0 THEN '  ' ELSE ' Insight ' || CAST(doc_id AS string) || ' ' END",
    "patient_facing_text": "CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'Plain ' || CAST(doc_id AS string) END",
    "e1": "'trend-' || " + _CODE_CASE("doc_id % 7"),
    "e2": "'gap-' || " + _CODE_CASE("doc_id % 5"),
    "e3": "'trend-' || " + _CODE_CASE("(doc_id + 2) % 7"),
}
_SCREEN = f"""{_POOL}, cd AS ({sql_select(_CANDIDATE, 'documents')}),
cr AS (SELECT *, row_number() OVER (PARTITION BY patient_id, run_id ORDER BY pos) AS rn FROM cd),
ck AS (SELECT *, trim(clinician_facing_text) AS ct, trim(patient_facing_text) AS pt FROM cr WHERE rn <= 8 AND confidence >= 0.55
  AND trim(clinician_facing_text) <> '' AND trim(patient_facing_text) <> ''),
ci AS (SELECT patient_id, run_id, pos, ct, unnest([e1, e2, e3]) AS evidence_id, unnest([1, 2, 3]) AS k FROM ck),
ok AS (SELECT ci.patient_id, ci.run_id, ci.pos, string_agg(ci.evidence_id, ',' ORDER BY k) AS ids FROM ci JOIN pool USING (patient_id, run_id, evidence_id) GROUP BY ALL),
dr AS (SELECT ck.*, ok.ids FROM ck JOIN ok USING (patient_id, run_id, pos))"""


def insight_candidates(i: Inputs) -> DataFrame:
    return i.derive("documents", _CANDIDATE).withColumn("evidence_ids", F.array("e1", "e2", "e3"))


@query("screened_insights", TREND_SQL + f""", {_SCREEN}
SELECT patient_id, run_id, pos, md5({framed('patient_id', 'run_id', 'pos', 'ct')}) AS draft_id, ct AS text, ids AS supporting_evidence_ids,
  CASE WHEN severity = 'severe' THEN 'informational' ELSE severity END AS severity, round(confidence, 4) AS confidence FROM dr""")
def screened_insights(i: Inputs) -> DataFrame:
    return insights.screen_candidates(insight_candidates(i), evidence_pool(i)).select(
        "patient_id", "run_id", "pos", "draft_id", "text",
        F.array_join("supporting_evidence_ids", ",").alias("supporting_evidence_ids"), "severity",
        "confidence",
    )


@query("supporting_entities", TREND_SQL + f""", {_SCREEN},
se AS (SELECT DISTINCT ci.patient_id, ci.run_id, ci.pos, regexp_replace(evidence_id, '^(gap|trend)-', 'trend:') AS entity
  FROM ci JOIN pool USING (patient_id, run_id, evidence_id))
SELECT dr.patient_id, dr.run_id, dr.pos, string_agg(entity, ',' ORDER BY entity) AS entities FROM dr JOIN se USING (patient_id, run_id, pos) GROUP BY ALL""")
def supporting_entities(i: Inputs) -> DataFrame:
    return insights.screen_candidates(insight_candidates(i), evidence_pool(i)).select(
        "patient_id", "run_id", "pos", F.array_join(F.sort_array("supporting_entity_ids"), ",").alias("entities")
    )


@query("supporting_entity_ids", TREND_SQL + f""", {_SCREEN}
SELECT DISTINCT dr.patient_id, dr.run_id, dr.pos, o.entity_id FROM dr JOIN ci USING (patient_id, run_id, pos) JOIN pool p USING (patient_id, run_id, evidence_id)
JOIN obs o ON o.patient_id = dr.patient_id AND o.code = regexp_replace(ci.evidence_id, '^(gap|trend)-', '')""")
def supporting_entity_ids(i: Inputs) -> DataFrame:
    """The entities behind every screened draft: the points of the series that it cites."""
    drafts = insights.screen_candidates(insight_candidates(i), evidence_pool(i))
    return lineage.entities_behind(drafts, i.observations(), ["patient_id", "run_id", "pos"], "supporting_entity_ids")


@query("dropped_citations", TREND_SQL + f""", {_SCREEN}
SELECT DISTINCT c.patient_id, c.run_id, c.pos, c.evidence_id FROM (SELECT patient_id, run_id, pos, unnest([e1, e2, e3]) AS evidence_id FROM cd) c
WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.patient_id = c.patient_id AND p.run_id = c.run_id AND p.evidence_id = c.evidence_id)""")
def dropped_citations(i: Inputs) -> DataFrame:
    return insights.dropped_citations(insight_candidates(i), evidence_pool(i))


@query("evidence_used", TREND_SQL + f""", {_SCREEN}
SELECT DISTINCT p.patient_id, p.run_id, p.evidence_id, p.text FROM pool p JOIN ci USING (patient_id, run_id, evidence_id) JOIN dr USING (patient_id, run_id, pos)""")
def evidence_used(i: Inputs) -> DataFrame:
    pool = evidence_pool(i)
    drafts = insights.screen_candidates(insight_candidates(i), pool)
    return insights.evidence_used(drafts, pool).select("patient_id", "run_id", "evidence_id", "text")


# --------------------------------------------------------------------------- verification
_DRAFT = {
    "patient_id": "doc_id % 150",
    "draft_id": "'dr' || CAST(doc_id AS string)",
    "text": "'Draft ' || CAST(doc_id AS string)",
    "patient_facing_text": "'Plain ' || CAST(doc_id AS string)",
    "clinician_facing_text": "'Draft ' || CAST(doc_id AS string)",
    "severity": "CASE doc_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 2 THEN 'low' ELSE 'moderate' END",
    # some drafts cite nothing that is known
    "e1": "CASE WHEN doc_id % 29 = 0 THEN 'unknown-1' ELSE 'trend-' || " + _CODE_CASE("doc_id % 7") + " END",
    "e2": "CASE WHEN doc_id % 29 = 0 THEN 'unknown-2' ELSE 'trend-' || " + _CODE_CASE("(doc_id + 5) % 7") + " END",
    "doc_id": "doc_id",
}
_CHECK = {
    "k": "k", "draft_id": "draft_id",
    "assertion_text": "'Claim ' || CAST(k AS string)",
    "supported": "(doc_id * 3 + k) % 5 <> 0 AND doc_id % 23 <> 0",
    "confidence": "(7008 + ((doc_id * 7 + k * 13) % 41) * 60) / 10000e0",
    "s1": "'trend-' || " + _CODE_CASE("(doc_id + k) % 7"),
    "c1": "CASE WHEN (doc_id + k) % 11 = 0 THEN 'trend-' || " + _CODE_CASE("(doc_id + k) % 7") + " END",
}


def _drafts(i: Inputs) -> DataFrame:
    return i.derive("documents", _DRAFT).withColumn("supporting_evidence_ids", F.array("e1", "e2")).withColumn(
        "supporting_entity_ids", F.array().cast("array<string>")
    )


def _assertions(i: Inputs) -> DataFrame:
    """One to four checked claims per draft; every ninth draft has none."""
    counted = _drafts(i).filter("doc_id % 9 <> 0").withColumn(
        "k", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")))
    )
    return counted.selectExpr(*[f"{v} AS {k}" for k, v in _CHECK.items()]).select(
        "draft_id", F.col("k").alias("pos"), "assertion_text", "supported", "confidence",
        F.array("s1").alias("supporting_evidence_ids"),
        F.array_compact(F.array("c1")).alias("contradicting_evidence_ids"),
    )


def _used(i: Inputs) -> DataFrame:
    return evidence.trend_evidence(trend_table(i)).filter("branch = 1").select(
        "patient_id", "evidence_id"
    )


_VERIFY = f"""used AS (SELECT patient_id, 'trend-' || code AS evidence_id FROM tr),
dr AS ({sql_select(_DRAFT, 'documents')}),
cited AS (SELECT DISTINCT dr.draft_id, u.evidence_id FROM dr JOIN used u ON u.patient_id = dr.patient_id AND u.evidence_id IN (dr.e1, dr.e2)),
rs AS (SELECT * FROM dr WHERE draft_id IN (SELECT draft_id FROM cited)),
ex AS (SELECT *, CAST(unnest(range(1, CAST(doc_id % 4 + 2 AS BIGINT))) AS INTEGER) AS k FROM rs WHERE doc_id % 9 <> 0),
chk AS (SELECT patient_id, {', '.join(f'{v} AS {n}' for n, v in _CHECK.items())} FROM ex),
sc AS (SELECT c.patient_id, c.draft_id, c.k AS pos, c.assertion_text, c.supported AS verified,
    CASE WHEN EXISTS (SELECT 1 FROM cited x WHERE x.draft_id = c.draft_id AND x.evidence_id = c.s1) THEN c.s1 ELSE '' END AS supporting,
    CASE WHEN EXISTS (SELECT 1 FROM used u WHERE u.patient_id = c.patient_id AND u.evidence_id = c.c1) THEN c.c1 ELSE '' END AS contradicting,
    round(c.confidence, 4) AS confidence FROM chk c),
agg AS (SELECT draft_id, count(*) AS total, count(*) FILTER (WHERE verified) AS ok, avg(confidence) FILTER (WHERE verified) AS mv,
    bool_or(contradicting <> '') AS contra FROM sc GROUP BY draft_id),
vf AS (SELECT rs.*, agg.*, round(ok / total * mv, 4) AS vc FROM rs JOIN agg USING (draft_id) WHERE ok > 0),
fin AS (SELECT *, CASE WHEN NOT contra AND ok = total AND vc >= 0.75 THEN 'auto_verified' ELSE 'flagged' END AS status FROM vf)"""


def _verified(i: Inputs) -> DataFrame:
    return verification.verify(_drafts(i), _assertions(i), _used(i))


@query("screened_assertions", TREND_SQL + f", {_VERIFY} SELECT draft_id, pos, assertion_text, verified, supporting, contradicting, confidence FROM sc")
def screened_assertions(i: Inputs) -> DataFrame:
    return verification.screen_assertions(_assertions(i), _drafts(i), _used(i)).select(
        "draft_id", "pos", "assertion_text", "verified",
        F.array_join("supporting", ",").alias("supporting"),
        F.array_join("contradicting", ",").alias("contradicting"), "confidence",
    )


@query("rejected_assertions", TREND_SQL + f", {_VERIFY} SELECT draft_id, pos, assertion_text FROM sc WHERE NOT verified")
def rejected_assertions(i: Inputs) -> DataFrame:
    screened = verification.screen_assertions(_assertions(i), _drafts(i), _used(i))
    return verification.rejected_assertions(screened).select("draft_id", "pos", "assertion_text")


@query("verified_insights", TREND_SQL + f""", {_VERIFY} SELECT draft_id, patient_id, status AS verification_status, vc AS verification_confidence,
  ok AS verified_count, total AS total_count, contra AS contradicted, severity, status <> 'auto_verified' OR severity IN ('high', 'critical') AS requires_clinician_review FROM fin""")
def verified_insights(i: Inputs) -> DataFrame:
    return _verified(i).select(
        "draft_id", "patient_id", "verification_status", "verification_confidence",
        "verified_count", "total_count", "contradicted", "severity", "requires_clinician_review",
    )


@query("verification_rationales", TREND_SQL + f""", {_VERIFY} SELECT draft_id, ok || ' of ' || total || ' assertion(s) hold against the cited evidence (coverage='
  || printf('%.2f', ok / total) || ', mean confidence=' || printf('%.2f', mv) || ').' || CASE WHEN contra THEN ' Some evidence conflicts with an assertion.' ELSE '' END AS rationale FROM fin""")
def verification_rationales(i: Inputs) -> DataFrame:
    return _verified(i).select("draft_id", F.col("verification_rationale").alias("rationale"))


@query("rejected_insights", TREND_SQL + f", {_VERIFY} SELECT draft_id FROM dr WHERE draft_id NOT IN (SELECT draft_id FROM fin)")
def rejected_insights(i: Inputs) -> DataFrame:
    return verification.rejected(_drafts(i), _verified(i)).select("draft_id")


@query("unresolvable_drafts", TREND_SQL + f", {_VERIFY} SELECT draft_id FROM dr WHERE draft_id NOT IN (SELECT draft_id FROM cited)")
def unresolvable_drafts(i: Inputs) -> DataFrame:
    known = verification.resolvable(_drafts(i), _used(i))
    return _drafts(i).join(known.select("draft_id"), "draft_id", "left_anti").select("draft_id")


@query("insight_rows", TREND_SQL + f", {_VERIFY} SELECT draft_id AS insight_id, CASE status WHEN 'auto_verified' THEN 'approved' ELSE 'pending' END AS verification_status, severity, text AS final_text FROM fin")
def insight_rows(i: Inputs) -> DataFrame:
    return tables.insight_rows(_verified(i)).select(
        "insight_id", "verification_status", "severity", "final_text"
    )


# --------------------------------------------------------------------------- evaluation
@query("extraction_scores", """
WITH p AS (SELECT doc_id, lang, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS v FROM documents WHERE n_chars > 500),
g AS (SELECT l.doc_id, d.lang, l.quality AS v FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
b AS (SELECT coalesce(p.lang, g.lang) AS entity_type, p.v AS pv, g.v AS gv FROM p FULL OUTER JOIN g ON p.doc_id = g.doc_id AND p.lang = g.lang),
c AS (SELECT entity_type, count(pv) AS predicted, count(gv) AS gold, count(*) FILTER (WHERE pv = gv) AS exact,
  count(*) FILTER (WHERE pv <> gv) AS partial FROM b GROUP BY entity_type),
s AS (SELECT *, coalesce(exact / nullif(predicted, 0), 0.0) AS pr, coalesce(exact / nullif(gold, 0), 0.0) AS rc,
  coalesce((exact + 0.5 * partial) / nullif(predicted, 0), 0.0) AS pp, coalesce((exact + 0.5 * partial) / nullif(gold, 0), 0.0) AS pc FROM c)
SELECT entity_type, predicted, gold, exact, partial, round(pr, 4) AS precision, round(rc, 4) AS recall,
  round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0), 4) AS f1, round(CAST(coalesce(2 * pp * pc / nullif(pp + pc, 0), 0.0) AS DOUBLE), 4) AS partial_f1 FROM s""")
def extraction_scores(i: Inputs) -> DataFrame:
    docs = i.table("documents")
    predicted = docs.filter("n_chars > 500").selectExpr(
        "doc_id AS document_id", "lang AS entity_type", "'quality' AS entity_key",
        "CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS value",
    )
    gold = i.table("labels").join(docs.select("doc_id", "lang"), "doc_id").selectExpr(
        "doc_id AS document_id", "lang AS entity_type", "'quality' AS entity_key", "quality AS value"
    )
    scores = evaluation.extraction_scores(predicted, gold)
    return scores.select(
        "entity_type", "predicted", "gold", "exact", "partial",
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "partial_f1")],
    )


_CHECKED = {
    "code": "CAST(l_partkey % 9 AS string)", "gold_code": "CAST((l_partkey + CAST(l_linenumber / 7 AS int)) % 9 AS string)",
    "converted": "l_quantity * 18.0182e0", "gold_converted": "l_quantity * 18.0182e0 * CASE WHEN l_suppkey % 10 = 0 THEN 1.01e0 ELSE 1.0001e0 END",
    "low": "CASE WHEN l_tax > 0.04e0 THEN l_tax END", "gold_low": "CASE WHEN l_tax > 0.05e0 THEN l_tax END",
    "high": "l_discount", "gold_high": "CASE WHEN l_discount > 0.01e0 THEN l_discount END",
}


@query("coding_accuracy", f"""
WITH c AS ({sql_select(_CHECKED, 'lineitem').replace('CAST(l_linenumber / 7 AS int)', 'CAST(floor(l_linenumber / 7) AS int)')})
SELECT count(*) AS samples, round(avg(CASE WHEN code = gold_code THEN 1.0::DOUBLE ELSE 0 END), 6) AS code_accuracy,
  round(avg(CASE WHEN abs(converted - gold_converted) <= 0.001 * abs(gold_converted) THEN 1.0::DOUBLE ELSE 0 END), 6) AS unit_conversion_accuracy,
  round(avg(CASE WHEN low IS NOT DISTINCT FROM gold_low AND high IS NOT DISTINCT FROM gold_high THEN 1.0::DOUBLE ELSE 0 END), 6) AS reference_range_correctness FROM c""")
def coding_accuracy(i: Inputs) -> DataFrame:
    scores = evaluation.coding_accuracy(i.derive("lineitem", _CHECKED))
    return scores.select(
        "samples", *[F.round(c, 6).alias(c) for c in
                     ("code_accuracy", "unit_conversion_accuracy", "reference_range_correctness")]
    )


@query("trend_accuracy", TREND_SQL + """, x AS (SELECT direction, CASE WHEN last_value > first_value * 1.5 THEN 'increasing'
  WHEN last_value < first_value * 0.5 THEN 'decreasing' ELSE 'stable' END AS gold FROM tr)
SELECT count(*) AS series, round(avg(CASE WHEN direction = gold THEN 1.0::DOUBLE ELSE 0 END), 6) AS trend_direction_accuracy,
  round(count(*) FILTER (WHERE gold = 'stable' AND direction IN ('increasing', 'decreasing')) / count(*) FILTER (WHERE gold = 'stable'), 6) AS false_positive_trend_rate FROM x""")
def trend_accuracy(i: Inputs) -> DataFrame:
    gold = (
        F.when(F.col("latest_value") > F.col("first_value") * 1.5, "increasing")
        .when(F.col("latest_value") < F.col("first_value") * 0.5, "decreasing")
        .otherwise("stable")
    )
    scores = evaluation.trend_accuracy(trend_table(i).withColumn("gold_direction", gold))
    return scores.select(
        "series", *[F.round(c, 6).alias(c) for c in
                    ("trend_direction_accuracy", "false_positive_trend_rate")]
    )


@query("verification_scores", """
WITH x AS (SELECT n_chars > 1200 AS kept, quality = 1 AS is_true, toxic = 1 AS danger FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS claims,
  round(count(*) FILTER (WHERE NOT is_true AND NOT kept) / count(*) FILTER (WHERE NOT is_true), 6) AS hallucination_reduction_rate,
  round(count(*) FILTER (WHERE is_true AND danger AND NOT kept) / count(*) FILTER (WHERE is_true AND danger), 6) AS dangerous_omission_rate,
  round(count(*) FILTER (WHERE NOT is_true AND NOT kept) / count(*) FILTER (WHERE NOT kept), 6) AS precision_of_stripped_claims FROM x""")
def verification_scores(i: Inputs) -> DataFrame:
    claims = i.table("labels").join(i.table("documents").select("doc_id", "n_chars"), "doc_id").selectExpr(
        "n_chars > 1200 AS kept", "quality = 1 AS is_true", "toxic = 1 AS is_dangerous"
    )
    scores = evaluation.verification_scores(claims)
    return scores.select(
        "claims", *[F.round(c, 6).alias(c) for c in (
            "hallucination_reduction_rate", "dangerous_omission_rate", "precision_of_stripped_claims")]
    )
