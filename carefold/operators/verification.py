"""Verification of drafted insights by their checked assertions.

``drafts``: patient_id, draft_id, supporting_evidence_ids, severity, texts.
``assertions``: draft_id, pos, assertion_text, supported, confidence,
supporting_evidence_ids, contradicting_evidence_ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.text import exact_round, fixed_point, literal_map
from carefold.functions.runs import run_keys

# Verdict to stored status.
STORED_STATUS = {
    "auto_verified": "approved",
    "flagged": "pending",
    "unverified": "unverified_informational",
    "human_corrected": "modified",
}


def stored_status(status: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(STORED_STATUS), status), F.lit("pending"))


ASSERTION_SCHEMA = (
    "draft_id string, pos int, assertion_text string, supported boolean, confidence double, "
    "supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>"
)


def draft_assertions(
    drafts: DataFrame, used: DataFrame, check: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """Checked claims of each draft from a caller-supplied checker, in Arrow batches.

    The checker gets ``draft_id``, ``text`` and ``evidence``, the cited items as an array of ``evidence_id, text`` in the
    order of their ids, and gives rows of ``ASSERTION_SCHEMA``. A draft without resolvable evidence is not checked.
    """
    run = run_keys(drafts)
    cited = drafts.select(*run, "draft_id", F.explode(F.array_distinct("supporting_evidence_ids")).alias("evidence_id"))
    items = (
        cited.join(used.select(*run, "evidence_id", "text"), [*run, "evidence_id"])
        .groupBy("draft_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", "text"))).alias("evidence"))
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield check(batch)

    return drafts.select("draft_id", "text").join(items, "draft_id").mapInPandas(work, ASSERTION_SCHEMA)


def resolvable(drafts: DataFrame, used: DataFrame) -> DataFrame:
    """Drafts with ``cited_ids``: their citations that exist in the evidence used."""
    run = run_keys(drafts)
    cited = drafts.select(
        *run, "draft_id", F.explode("supporting_evidence_ids").alias("evidence_id")
    )
    found = (
        cited.join(used.select(*run, "evidence_id"), [*run, "evidence_id"])
        .groupBy("draft_id")
        .agg(F.sort_array(F.collect_set("evidence_id")).alias("cited_ids"))
    )
    return drafts.join(found, "draft_id")


def screen_assertions(assertions: DataFrame, drafts: DataFrame, used: DataFrame) -> DataFrame:
    """Assertions with the evidence ids that may count.

    Support must be cited by the insight itself; a contradiction may come from
    any evidence of the patient. The checker's verdict decides ``verified``.
    """
    # Citations (at position -1) and contradictions meet the evidence in one join.
    run = run_keys(drafts)
    owners = drafts.select("draft_id", *run, "supporting_evidence_ids")
    cites = owners.select(
        *run, "draft_id", F.lit(-1).alias("pos"),
        F.posexplode("supporting_evidence_ids").alias("cite_pos", "evidence_id"),
    )
    conflicts = assertions.select("draft_id", "pos", "contradicting_evidence_ids").join(
        owners.select("draft_id", *run), "draft_id"
    ).select(
        *run, "draft_id", "pos",
        F.posexplode("contradicting_evidence_ids").alias("cite_pos", "evidence_id"),
    )
    known = (
        cites.unionByName(conflicts)
        .join(used.select(*run, "evidence_id"), [*run, "evidence_id"])
        .groupBy(*run, "draft_id")
        .agg(
            F.collect_set(F.when(F.col("pos") < 0, F.col("evidence_id"))).alias("cited_ids"),
            F.array_sort(
                F.collect_list(
                    F.when(F.col("pos") >= 0, F.struct("pos", "cite_pos", "evidence_id"))
                )
            ).alias("conflicts"),
        )
        .filter(F.size("cited_ids") > 0)
    )
    return assertions.join(known, "draft_id").select(
        *run, "draft_id", "pos", "assertion_text",
        F.coalesce(F.col("supported"), F.lit(False)).alias("verified"),
        F.filter(
            "supporting_evidence_ids", lambda e: F.array_contains(F.col("cited_ids"), e)
        ).alias("supporting"),
        F.transform(
            F.filter("conflicts", lambda c: c["pos"] == F.col("pos")), lambda c: c["evidence_id"]
        ).alias("contradicting"),
        exact_round(F.col("confidence"), 4).alias("confidence"),
    )


def score_drafts(screened: DataFrame) -> DataFrame:
    """Coverage, mean confidence of the verified and the resulting confidence per draft."""
    fields = F.struct("pos", "assertion_text", "verified", "supporting", "contradicting", "confidence")
    scored = screened.groupBy("draft_id").agg(
        F.array_sort(F.collect_list(fields)).alias("assertions"),
        F.count("*").alias("total_count"),
        F.count_if("verified").alias("verified_count"),
        F.avg(F.when(F.col("verified"), F.col("confidence"))).alias("mean_verified"),
        F.bool_or(F.size("contradicting") > 0).alias("contradicted"),
    )
    coverage = F.col("verified_count") / F.col("total_count")
    return scored.withColumn("coverage", coverage).withColumn(
        "verification_confidence", exact_round(coverage * F.col("mean_verified"), 4)
    )


def verify(
    drafts: DataFrame,
    assertions: DataFrame,
    used: DataFrame,
    rationales: DataFrame | None = None,
    threshold: float = settings.AUTO_VERIFY_MIN_CONFIDENCE,
) -> DataFrame:
    """Verified insights with their screened assertions in order; drafts that fall out are given by :func:`rejected`."""
    screened = screen_assertions(assertions, drafts, used)
    scored = score_drafts(screened).filter(
        F.col("verified_count") > 0
    )
    if rationales is not None:
        scored = scored.join(rationales.select("draft_id", "overall_rationale"), "draft_id", "left")
    else:
        scored = scored.withColumn("overall_rationale", F.lit(None).cast("string"))
    automatic = (
        ~F.col("contradicted")
        & (F.col("verified_count") == F.col("total_count"))
        & (F.col("verification_confidence") >= threshold)
    )
    status = F.when(automatic, "auto_verified").otherwise("flagged")
    rationale = F.concat_ws(
        " ",
        F.format_string(
            "%d of %d assertion(s) hold against the cited evidence "
            "(coverage=%s, mean confidence=%s).",
            "verified_count", "total_count",
            fixed_point(F.col("coverage"), 2), fixed_point(F.col("mean_verified"), 2),
        ),
        F.when(F.col("contradicted"), "Some evidence conflicts with an assertion."),
        F.when(F.trim("overall_rationale") != "", F.trim("overall_rationale")),
    )
    return (
        drafts.join(scored, "draft_id")
        .withColumn("verification_status", status)
        .withColumn("verification_rationale", rationale)
        .withColumn("stored_status", stored_status(F.col("verification_status")))
        .withColumn(
            "requires_clinician_review",
            (F.col("verification_status") != "auto_verified")
            | F.col("severity").isin(*settings.ALWAYS_REVIEW_SEVERITIES),
        )
        .select(
            *run_keys(drafts), "draft_id", F.col("text").alias("final_text"), "patient_facing_text",
            "clinician_facing_text", "verification_status", "stored_status",
            "verification_confidence", "verification_rationale", "verified_count", "total_count",
            "contradicted", "severity", "requires_clinician_review", "supporting_entity_ids", "assertions",
        )
    )


def rejected(drafts: DataFrame, verified: DataFrame) -> DataFrame:
    """Drafts without resolvable evidence, assertions or any verified assertion."""
    return drafts.join(verified.select("draft_id"), "draft_id", "left_anti")


def rejected_assertions(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("verified"))
