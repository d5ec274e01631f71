"""Screening of drafted insights against the evidence pool."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.ids import stable_key
from carefold.functions.runs import run_keys
from carefold.functions.text import exact_round

# Severities, lowest first.
SEVERITIES = ("informational", "low", "moderate", "high", "critical")

#: What a generator gives beside the columns that name its run.
CANDIDATE_SCHEMA = (
    "pos int, insight_type string, severity string, confidence double, "
    "evidence_ids array<string>, clinician_facing_text string, patient_facing_text string"
)


def draft_candidates(
    blocks: DataFrame,
    generate: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """Candidates from a caller-supplied generator over evidence blocks, in Arrow batches.

    The generator gets ``evidence_block`` and the columns that name the run, which it gives back with each candidate.
    """
    named = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in run_keys(blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield generate(batch)

    return blocks.mapInPandas(run, f"{named}, {CANDIDATE_SCHEMA}")


def screen_candidates(
    candidates: DataFrame,
    evidence: DataFrame,
    max_insights: int = settings.MAX_INSIGHTS,
    min_confidence: float = settings.MIN_INSIGHT_CONFIDENCE,
) -> DataFrame:
    """Drafts that cite known evidence, are confident enough and carry both texts.

    Only the first ``max_insights`` candidates of a run count. Cited ids
    outside the run's pool are dropped, keeping the order of the rest.
    """
    run = run_keys(candidates)
    first = Window.partitionBy(*run).orderBy("pos")
    blank = F.lit(" \t\n\r\x0b\x0c")
    kept = (
        candidates.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= max_insights)
        .withColumn("clinician_facing_text", F.btrim("clinician_facing_text", blank))
        .withColumn("patient_facing_text", F.btrim("patient_facing_text", blank))
        .filter(
            (F.col("confidence") >= min_confidence)
            & (F.col("clinician_facing_text") != "")
            & (F.col("patient_facing_text") != "")
        )
    )
    cited = kept.select(
        *run, "pos", F.posexplode("evidence_ids").alias("cite_pos", "evidence_id")
    )
    found = (
        cited.join(
            evidence.select(*run, "evidence_id", "entity_ids"),
            [*run, "evidence_id"],
        )
        .groupBy(*run, "pos")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("cite_pos", "evidence_id", "entity_ids"))
            ).alias("f")
        )
        .select(
            *run, "pos",
            F.col("f.evidence_id").alias("supporting_evidence_ids"),
            F.array_distinct(F.flatten("f.entity_ids")).alias("supporting_entity_ids"),
        )
    )
    return kept.join(found, [*run, "pos"]).select(
        *run,
        stable_key(*[F.col(k) for k in run], F.col("pos"), F.col("clinician_facing_text")).alias(
            "draft_id"
        ),
        "pos",
        F.col("clinician_facing_text").alias("text"),
        "supporting_entity_ids", "supporting_evidence_ids",
        F.lit(True).alias("model_inference_flag"),
        F.when(F.col("severity").isin(*SEVERITIES), F.col("severity"))
        .otherwise("informational")
        .alias("severity"),
        exact_round(F.col("confidence"), 4).alias("confidence"),
        "patient_facing_text", "clinician_facing_text", "insight_type",
    )


def dropped_citations(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that are not in the run's pool."""
    run = run_keys(candidates)
    cited = candidates.select(*run, "pos", F.explode("evidence_ids").alias("evidence_id"))
    return cited.join(
        evidence.select(*run, "evidence_id"), [*run, "evidence_id"], "left_anti"
    ).distinct()


def evidence_used(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The part of the pool that a surviving draft cites."""
    run = run_keys(drafts)
    cited = drafts.select(*run, F.explode("supporting_evidence_ids").alias("evidence_id"))
    return evidence.join(cited.distinct(), [*run, "evidence_id"], "left_semi")
