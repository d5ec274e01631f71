"""Guideline retrieval: query building, exact blocked vector search, ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.text import empty_to_null, exact_round, filled
from carefold.functions.runs import run_keys

# ---------------------------------------------------------------------------
# Query categories with their priorities, and the sentences that are asked: an encoder gives other hits for
# other wording, so they have to be these. ``{}`` stands for the columns named where they are used.
# ---------------------------------------------------------------------------
CATEGORIES = (
    "lab_interpretation", "reference_range", "disease_guideline", "diagnostic_criteria",
    "medication_guidance", "contraindication", "monitoring", "follow_up", "general",
)
GENERAL = "general"
DISEASE_TYPES = ("diagnosis", "procedure")
LAB_SENTENCE = "clinical interpretation of {}{} lab result"
RANGE_SENTENCE = "normal reference range for {}"
DISEASE_SENTENCE = "clinical practice guideline for {} management"
CRITERIA_SENTENCE = "diagnostic criteria for {}"
MEDICATION_SENTENCE = "dosing and monitoring guidance for {}"
CONTRAINDICATION_SENTENCE = "contraindications and precautions for {}"
MONITORING_SENTENCE = "monitoring frequency recommendations for {}"
FOLLOW_UP_SENTENCE = "follow-up recommendations for {} {}"

_QUERY_COLUMNS = ["patient_id", "text", "category", "source_entity_ids", "priority", "pos"]


# --------------------------------------------------------------------------- queries
def _usable(coded: DataFrame, *types: str) -> DataFrame:
    """Coded entities of the given types that are not negated, with the name to ask for.

    ``arrival`` orders the queries of a patient; without it the temp id does.
    """
    if "arrival" not in coded.columns:
        coded = coded.withColumn("arrival", F.col("temp_id"))
    return coded.filter(
        F.col("canonical_code").isNotNull()
        & ~F.col("is_negated")
        & F.col("entity_type").isin(*types)
    ).withColumn(
        "name", F.coalesce(empty_to_null(F.col("normalized_value")), F.col("raw_value"))
    )


def _queries(df: DataFrame, branch: int | Column, *specs: tuple[Column, Column, str, int]) -> DataFrame:
    """One row per spec whose condition holds, in spec order within the source row."""
    options = F.array(
        *[
            F.when(
                condition,
                F.struct(
                    text.alias("text"), F.lit(category).alias("category"),
                    F.lit(priority).alias("priority"), F.lit(i).alias("part"),
                ),
            )
            for i, (condition, text, category, priority) in enumerate(specs)
        ]
    )
    place = F.lit(branch) if isinstance(branch, int) else branch
    return df.select(
        *run_keys(df), "source_entity_ids", "arrival", place.alias("branch"),
        F.explode(F.array_compact(options)).alias("q"),
    ).select(
        *run_keys(df), F.col("q.text").alias("text"), F.col("q.category").alias("category"),
        "source_entity_ids", F.col("q.priority").alias("priority"),
        F.struct(
            F.col("branch"), F.col("arrival"), F.col("q.part").alias("part"),
        ).alias("pos"),
    )


def _lab_specs() -> list[tuple[Column, Column, str, int]]:
    is_lab = F.col("entity_type") == "lab_value"
    unit = F.coalesce(F.concat(F.lit(" "), empty_to_null(F.col("unit_canonical"))), F.lit(""))
    open_range = F.col("reference_range_low").isNull() | F.col("reference_range_high").isNull()
    return [
        (is_lab, filled(LAB_SENTENCE, "name", unit),
         "lab_interpretation", 2),
        (is_lab & open_range, filled(RANGE_SENTENCE, "name"),
         "reference_range", 1),
    ]


def _disease_specs() -> list[tuple[Column, Column, str, int]]:
    is_disease = F.col("entity_type").isin(*DISEASE_TYPES)
    return [
        (is_disease, filled(DISEASE_SENTENCE, "name"),
         "disease_guideline", 3),
        (is_disease, filled(CRITERIA_SENTENCE, "name"), "diagnostic_criteria", 1),
    ]


def _medication_specs() -> list[tuple[Column, Column, str, int]]:
    is_drug = F.col("entity_type") == "medication"
    return [
        (is_drug, filled(MEDICATION_SENTENCE, "name"),
         "medication_guidance", 2),
        (is_drug, filled(CONTRAINDICATION_SENTENCE, "name"),
         "contraindication", 1),
    ]


def _with_source(coded: DataFrame, *types: str) -> DataFrame:
    return _usable(coded, *types).withColumn("source_entity_ids", F.array("temp_id"))


def lab_queries(coded: DataFrame) -> DataFrame:
    """Interpretation of every lab; its range where a bound is missing."""
    return _queries(_with_source(coded, "lab_value"), 0, *_lab_specs())


def disease_queries(coded: DataFrame) -> DataFrame:
    """Guideline and criteria of every diagnosis and procedure."""
    return _queries(_with_source(coded, *DISEASE_TYPES), 1, *_disease_specs())


def medication_queries(coded: DataFrame) -> DataFrame:
    """Guidance and contraindications of every drug."""
    return _queries(_with_source(coded, "medication"), 2, *_medication_specs())


def entity_queries(coded: DataFrame) -> DataFrame:
    """Lab, disease and medication queries in one pass over the entities.

    An entity has one type, so its type gives the branch its queries belong to.
    """
    rows = _with_source(coded, "lab_value", *DISEASE_TYPES, "medication")
    branch = (
        F.when(F.col("entity_type") == "lab_value", 0)
        .when(F.col("entity_type").isin(*DISEASE_TYPES), 1)
        .otherwise(2)
    )
    return _queries(rows, branch, *_lab_specs(), *_disease_specs(), *_medication_specs())


def trend_queries(trends: DataFrame) -> DataFrame:
    """Monitoring for gaps, follow-up for significant or worsening metrics.

    The source is the series itself (``trend:code``): its points stay in the
    point table instead of travelling along as an unbounded list.
    """
    rows = trends.withColumn(
        "source_entity_ids", F.array(F.concat(F.lit("trend:"), "code"))
    ).withColumn("arrival", F.col("code"))
    follow = F.col("is_clinically_significant") | (F.col("clinical_trend") == "worsening")
    return _queries(
        rows, 3,
        (F.col("monitoring_gap_detected"),
         filled(MONITORING_SENTENCE, "metric_name"),
         "monitoring", 2),
        (follow,
         filled(FOLLOW_UP_SENTENCE, "clinical_trend", "metric_name"),
         "follow_up", 3),
    )


def context_queries(contexts: DataFrame) -> DataFrame:
    """``patient_id, clinical_context`` as one free query each."""
    rows = (
        contexts.withColumn("body", F.btrim("clinical_context", F.lit(" \t\n\r\x0b\x0c")))
        .withColumn("source_entity_ids", F.array().cast("array<string>"))
        .withColumn("arrival", F.lit("0"))
    )
    return _queries(rows, 4, (F.col("body") != "", F.col("body"), GENERAL, 1))


def plan_queries(*branches: DataFrame, max_queries: int = settings.MAX_QUERIES) -> DataFrame:
    """Deduplicated queries, at most ``max_queries`` per run by priority.

    Equal category and text count once, with the highest priority and the
    first position. The cut is a ranking per run, which Spark limits map-side.
    """
    union = branches[0]
    for branch in branches[1:]:
        union = union.unionByName(branch)
    key = F.concat_ws(":", "category", F.lower(F.trim("text")))
    # Higher priority first; among equals the query that arrived first.
    best = F.min_by(
        F.struct("text", "category", "source_entity_ids", "priority"),
        F.struct((-F.col("priority")).alias("p"), F.col("pos")),
    )
    run = run_keys(union)
    unique = union.groupBy(*run, key.alias("query_key")).agg(
        best.alias("q"), F.min("pos").alias("pos")
    )
    order = Window.partitionBy(*run).orderBy(F.col("q.priority").desc(), "pos")
    return (
        unique.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_queries)
        .select(*run, "rank", "q.text", "q.category", "q.source_entity_ids", "q.priority")
    )


# --------------------------------------------------------------------------- search
#: Queries of a cell that are scored at a time; 4 MB of scores for a block of 4,096 passages.
QUERY_SLICE = 128


def blocked_top_k(
    queries: DataFrame,
    passages: DataFrame,
    top_k: int = settings.SEARCH_TOP_K,
    min_score: float | None = None,
    by: str = "category",
    block_rows: int = settings.VECTOR_BLOCK_ROWS,
    few_groups: bool = False,
) -> DataFrame:
    """Exact cosine top-k of each query among the passages of its group ``by``.

    ``queries``: query_id, ``by``, vector; ``passages``: passage_id, ``by``,
    vector. Both sides are cut into blocks of about ``block_rows`` rows within a
    group, so a hot group becomes many cells. A cell multiplies two blocks and
    gives k rows per query; no pair leaves it. Ties go to the lower passage id.
    With ``few_groups`` the groups are a closed set and their block counts are
    broadcast; otherwise they are joined.
    """
    # Fresh attributes, as both sides may come from one table.
    queries = queries.select(*[F.col(c).alias(c) for c in ("query_id", by, "vector")])
    passages = passages.select(*[F.col(c).alias(c) for c in ("passage_id", by, "vector")])

    def blocks(side: DataFrame) -> DataFrame:
        return side.groupBy(by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))

    cells = blocks(queries).withColumnRenamed("n", "nq").join(
        blocks(passages).withColumnRenamed("n", "np"), by
    )
    if few_groups:
        cells = F.broadcast(cells)
    left = (
        queries.join(cells, by)
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")))
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
        .select(by, "qb", F.col("pb").cast("long").alias("pb"), "query_id", "vector")
    )
    right = (
        passages.join(cells, by)
        .withColumn("pb", F.pmod(F.xxhash64("passage_id"), F.col("np")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        .select(by, F.col("qb").cast("long").alias("qb"), "pb", "passage_id", "vector")
    )
    keys = [by, "qb", "pb"]
    q_type = queries.schema["query_id"].dataType.simpleString()
    p_type = passages.schema["passage_id"].dataType.simpleString()
    best = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(
            _cell_search(top_k), f"query_id {q_type}, passage_id {p_type}, score double"
        )
    )
    if min_score is not None:
        best = best.filter(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "passage_id")
    return best.withColumn("hit_rank", F.row_number().over(order)).filter(
        F.col("hit_rank") <= top_k
    )


def _cell_search(top_k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(queries: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or passages.empty:
            return pd.DataFrame({"query_id": [], "passage_id": [], "score": []})

        def unit_rows(vectors: pd.Series) -> np.ndarray:
            rows = np.stack(vectors.to_numpy()).astype(np.float64)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            length[length == 0] = 1.0
            return rows / length

        ordered = passages.sort_values("passage_id")
        against, asked = unit_rows(ordered["vector"]).T, unit_rows(queries["vector"])
        k = min(top_k, against.shape[1])
        ids, query_ids = ordered["passage_id"].to_numpy(), queries["query_id"].to_numpy()
        found = []
        # the scores of a whole cell and their order would be three arrays of 128 MB
        for first in range(0, len(asked), QUERY_SLICE):
            scores = asked[first : first + QUERY_SLICE] @ against
            # Stable sort over ascending ids: equal scores keep the lower id.
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows, columns = np.repeat(np.arange(len(scores)), k), best.ravel()
            found.append((query_ids[first + rows], ids[columns], scores[rows, columns]))
        query_id, passage_id, score = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame({"query_id": query_id, "passage_id": passage_id, "score": score})

    return search


def search_knowledge(
    queries: DataFrame, passages: DataFrame, top_k: int = settings.SEARCH_TOP_K
) -> DataFrame:
    """Hits of planned queries; ``general`` ones search every category.

    ``queries``: query_id, category, vector. Equal queries of many patients
    should be one row here: search distinct texts and join back.
    """
    filtered = queries.filter(F.col("category") != GENERAL)
    general = queries.filter(F.col("category") == GENERAL)
    everywhere = passages.withColumn("category", F.lit(GENERAL))
    return blocked_top_k(
        filtered.unionByName(general), passages.unionByName(everywhere), top_k, few_groups=True
    )


def search_history(
    queries: DataFrame,
    passages: DataFrame,
    top_k: int = settings.HISTORY_TOP_K,
    min_score: float = settings.HISTORY_MIN_SCORE,
) -> DataFrame:
    """Within the patient's own vectors, scores of at least ``min_score``."""
    return blocked_top_k(queries, passages, top_k, min_score, by="patient_id")


def embed_texts(
    df: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "text"
) -> DataFrame:
    """Adds ``vector`` by a caller-supplied batch encoder, run in Arrow batches."""
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + ["vector array<double>"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=list(encode(batch[text].tolist())))

    return df.mapInPandas(run, schema)


def hashed_weights(df: DataFrame, key: str, text: str = "text", features: int = 256) -> DataFrame:
    """TF-IDF over hashed words as rows ``key, bucket, weight``, each text of unit length; needs no model.

    A word's bucket comes from its MD5, the weight of a bucket in a text is its count times ln((N + 1) / (df + 1)), with N
    texts and df of them that hold the bucket. A text without a word, or with buckets of weight 0 only, has no row.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bucket = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), F.lit(features)).cast("int")
    counts = (
        df.select(key, F.explode(words).alias("word")).withColumn("bucket", bucket)
        .groupBy(key, "bucket").agg(F.count("*").alias("tf"))
    )
    total = df.agg(F.count("*").alias("n"))
    weights = counts.groupBy("bucket").agg(F.count("*").alias("df")).join(F.broadcast(total)).select(
        "bucket", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    # as many rows as there are features
    weighted = counts.join(F.broadcast(weights), "bucket").select(key, "bucket", (F.col("tf") * F.col("idf")).alias("raw"))
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length")).filter("length > 0")
    return weighted.join(length, key).select(key, "bucket", (F.col("raw") / F.col("length")).alias("weight"))


def hashed_vectors(df: DataFrame, key: str, text: str = "text", features: int = 256) -> DataFrame:
    """Adds ``vector``, the ``hashed_weights`` of each text as an array; all zero for a text without a row."""
    rows = hashed_weights(df, key, text, features).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_weights"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda b: F.coalesce(F.try_element_at("_weights", b), F.lit(0.0)))
    return df.join(rows, key, "left").withColumn("vector", vector).drop("_weights")


# --------------------------------------------------------------------------- candidates
def to_candidates(hits: DataFrame) -> DataFrame:
    """Ranked candidates from hits with payload columns; hits without text are dropped.

    Missing payload fields fall back along their chain; an unknown category
    becomes that of the query.
    """
    has = lambda name: empty_to_null(F.col(name))
    source = F.coalesce(has("source"), has("evidence_source"), F.lit("Clinical Guideline"))
    section = F.coalesce(has("section"), has("condition"))
    title = F.coalesce(
        has("title"), has("display_name"), has("metric_name"), has("condition"), source
    )
    category = F.when(has("category").isin(*CATEGORIES), F.col("category")).otherwise(
        F.col("query_category")
    )
    citation = F.coalesce(
        has("citation"),
        F.concat(source, F.lit(" -- "), section),
        source,
    )
    return hits.filter(has("text").isNotNull()).select(
        *run_keys(hits),
        F.coalesce(has("guideline_id"), F.col("passage_id").cast("string")).alias("guideline_id"),
        title.alias("title"), source.alias("source"), section.alias("section"), "text",
        category.alias("category"), exact_round(F.col("score"), 4).alias("relevance_score"),
        citation.alias("citation"),
        "reference_range_low", "reference_range_high", "reference_range_unit",
        F.col("query_text").alias("retrieval_query"), "arrival",
    )


def rank_candidates(
    candidates: DataFrame,
    min_relevance: float = settings.MIN_KNOWLEDGE_RELEVANCE,
    max_results: int = settings.MAX_KNOWLEDGE,
) -> DataFrame:
    """Best hit per passage, lifted by the number of queries that found it.

    Every query counts for the lift, also below the floor; the score given out
    stays plain. Ties keep the order of arrival.
    """
    run = run_keys(candidates)
    keys = [*run, "guideline_id"]
    eligible = (F.col("relevance_score") >= min_relevance) & F.col("text").rlike(r"\S")
    fields = [c for c in candidates.columns if c not in keys]
    by_passage = (
        candidates.groupBy(*keys)
        .agg(
            F.countDistinct("retrieval_query").alias("query_count"),
            F.min(F.when(eligible, F.col("arrival"))).alias("first_arrival"),
            F.min_by(
                F.struct(*fields),
                F.when(
                    eligible, F.struct((-F.col("relevance_score")).alias("s"), F.col("arrival"))
                ),
            ).alias("best"),
        )
        .filter(F.col("first_arrival").isNotNull())
    )
    lift = F.least(
        F.lit(settings.CORROBORATION_CAP),
        (F.col("query_count") - 1) * settings.CORROBORATION_STEP,
    )
    scored = by_passage.select(
        *keys, "best.*", "first_arrival", "query_count",
        (F.col("best.relevance_score") + lift).alias("boosted_score"),
    )
    order = Window.partitionBy(*run).orderBy(
        F.col("boosted_score").desc(), "first_arrival"
    )
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_results)
        .drop("first_arrival", "arrival")
    )


def to_knowledge_items(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        *run_keys(ranked), "rank", "guideline_id", "title", "source", "section", "text",
        "relevance_score", "category", "citation", "reference_range_low",
        "reference_range_high", "reference_range_unit", "retrieval_query",
    )


PAYLOAD = (
    "guideline_id", "source", "evidence_source", "section", "condition", "title", "display_name",
    "metric_name", "category", "citation", "text", "reference_range_low", "reference_range_high",
    "reference_range_unit",
)


def retrieve(
    planned: DataFrame,
    passages: DataFrame,
    encode: Callable[[list[str]], np.ndarray],
    top_k: int = settings.SEARCH_TOP_K,
) -> DataFrame:
    """Knowledge items of each run from planned queries and embedded passages.

    ``passages`` hold passage_id, category, vector and payload columns. Patients
    share many query texts, so each distinct text is embedded and searched once.
    """
    query_id = F.md5(F.concat_ws("|", "category", "text"))
    asked = planned.withColumn("query_id", query_id)
    distinct = asked.select("query_id", "category", "text").distinct()
    embedded = embed_texts(distinct, encode).select("query_id", "category", "vector")
    hits = search_knowledge(
        embedded, passages.select("passage_id", "category", "vector"), top_k
    )
    payload = passages.select(
        "passage_id",
        *[F.col(c) if c in passages.columns else F.lit(None).cast("string").alias(c)
          for c in PAYLOAD],
    )
    found = asked.select(
        *run_keys(asked), "query_id", "rank", F.col("category").alias("query_category"),
        F.col("text").alias("query_text"),
    ).join(hits, "query_id").withColumn("arrival", F.struct("rank", "hit_rank"))
    return to_knowledge_items(rank_candidates(to_candidates(attach_payload(found, payload))))


def attach_payload(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Payload columns of the passages for the few hits that survived the search."""
    return hits.join(passages, "passage_id")
