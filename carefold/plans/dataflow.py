"""Spans to evidence, and evidence to stored insights, for all documents at once.

With a ``folder`` each step is written there and read back: later steps start
from a stored table, lost executors repeat one step only, and no step runs twice
because two later ones need it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.functions.runs import in_runs
from carefold.operators import coding, evidence, insights, layout, lineage, masking, retrieval, trends, verification
from carefold.operators import entities as ent
from carefold.sources import tables


def _keeper(out: dict[str, DataFrame], folder: str | None) -> Callable[[str, DataFrame], DataFrame]:
    """Puts a table into ``out`` under its name; with a folder it is written there and read back."""

    def keep(name: str, df: DataFrame) -> DataFrame:
        if folder is not None:
            path = os.path.join(folder, name)
            df.write.mode("overwrite").parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        out[name] = df
        return df

    return keep


def conclude_runs(
    steps: dict[str, DataFrame],
    documents: DataFrame,
    generate: Callable[[pd.DataFrame], pd.DataFrame],
    check: Callable[[pd.DataFrame], pd.DataFrame],
    rationales: DataFrame | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """From the tables of :func:`process_spans` to verified insights, the entities behind them, stored rows and statuses.

    ``generate`` drafts insights from evidence blocks and ``check`` checks their claims, both in Arrow batches (see
    ``insights.draft_candidates`` and ``verification.draft_assertions``). ``documents`` names all documents of the run: one
    without entities, evidence or insights is complete too. ``generate`` is called once per block only with a ``folder``.
    """
    out: dict[str, DataFrame] = {}
    keep = _keeper(out, folder)
    pool = steps["evidence"]
    candidates = keep("candidates", insights.draft_candidates(steps["evidence_blocks"], generate))
    drafts = keep("drafts", insights.screen_candidates(candidates, pool))
    used = keep("evidence_used", insights.evidence_used(drafts, pool))
    assertions = keep("assertions", verification.draft_assertions(drafts, used, check))
    verified = keep("verified", verification.verify(drafts, assertions, used, rationales))
    keep("rejected", verification.rejected(drafts, verified))
    keep("insight_entities", lineage.entities_behind(
        verified, steps["observations"], ["patient_id", "draft_id"], "supporting_entity_ids"
    ))
    keep("insight_rows", tables.insight_rows(verified))
    keep("statuses", documents.select("document_id").distinct().withColumn("processing_status", F.lit("complete")))
    return out


def process_spans(
    spans: DataFrame,
    dictionary: ent.Dictionary,
    bands: DataFrame,
    metrics: DataFrame,
    as_of: Column,
    history: DataFrame | None = None,
    patients: DataFrame | None = None,
    contexts: DataFrame | None = None,
    passages: DataFrame | None = None,
    encode: Callable[[list[str]], np.ndarray] | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Tables of every step, by name.

    ``spans``: document_id, patient_id, span_pos, text, confidence. Without
    ``passages`` no guideline is retrieved.
    """
    out: dict[str, DataFrame] = {}
    keep = _keeper(out, folder)
    masked = keep("masked", masking.mask(spans))
    keep("token_map", masking.token_map(masked))
    clean = masked.drop("matches")
    found = keep("entities", ent.extract(clean, dictionary, layout.span_offsets(clean)))
    coded = keep("coded", coding.code_entities(found, dictionary, bands, patients, as_of))
    points = trends.build_points(found, coding.coded_only(coded), as_of)
    if history is not None:
        points = trends.merge_series(trends.history_points(history, points), points)
    points = keep("observations", points)
    trend = keep("trends", trends.analyse_trends(points, metrics, as_of))
    # One run per document: its entities, with the trends and context of its patient.
    coded = coded.withColumn("run_id", F.col("document_id"))
    runs = coded.select("patient_id", "run_id").distinct()
    trend = in_runs(trend, runs)
    branches = [retrieval.entity_queries(coded), retrieval.trend_queries(trend)]
    if contexts is not None:
        branches.append(retrieval.context_queries(in_runs(contexts, runs)))
    planned = keep("queries", retrieval.plan_queries(*branches))
    items = [evidence.observation_evidence(coded), evidence.trend_evidence(trend)]
    if passages is not None and encode is not None:
        knowledge = keep("knowledge", retrieval.retrieve(planned, passages, encode))
        items.append(evidence.guideline_evidence(knowledge))
    pool = keep("evidence", evidence.pool(*items))
    keep("evidence_blocks", evidence.evidence_block(pool))
    return out


def hashed_encoder(features: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A model-free encoder: hashed word counts, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        rows = np.zeros((len(texts), features))
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                rows[k, zlib.crc32(word.encode()) % features] += 1.0
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        length[length == 0] = 1.0
        return rows / length

    return encode


def embedded_passages(
    passages: DataFrame, encode: Callable[[list[str]], np.ndarray]
) -> DataFrame:
    return retrieval.embed_texts(passages, encode).withColumn(
        "passage_id", F.col("passage_id").cast("long")
    )
