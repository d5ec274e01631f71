"""Guideline monitoring, unit conversion, critical values and interpretation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.functions.text import days_between


def convert_units(values: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds ``converted_value`` for ``analyte, unit, target_unit, value``.

    Equal units keep the value; a pair without a factor gives null.
    """
    known = (
        factors.select(
            "analyte", F.col("from_unit").alias("unit"), F.col("to_unit").alias("target_unit"),
            "slope", "offset",
        )
    )
    return (
        values.join(known, ["analyte", "unit", "target_unit"], "left")
        .withColumn(
            "converted_value",
            F.when(F.col("unit") == F.col("target_unit"), F.col("value")).otherwise(
                F.col("value") * F.col("slope") + F.col("offset")
            ),
        )
        .drop("slope", "offset")
    )


def critical_values(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Observations that break a critical rule of their code, one row per rule broken."""
    limits = (
        rules.select(
            F.col("metric_code").alias("code"), "condition", "threshold", "action", "reason"
        )
    )
    broken = F.when(F.col("condition") == "low", F.col("value") < F.col("threshold")).otherwise(
        F.col("value") > F.col("threshold")
    )
    return observations.join(limits, "code").filter(broken)


def flag_critical(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Every observation with ``is_critical`` and the review it needs.

    The rules of a code fold into one low and one high limit, so no observation
    is repeated.
    """
    limits = (
        rules.groupBy(F.col("metric_code").alias("code")).agg(
            F.max(F.when(F.col("condition") == "low", F.col("threshold"))).alias("_low"),
            F.min(F.when(F.col("condition") == "high", F.col("threshold"))).alias("_high"),
        )
    )
    critical = F.coalesce(
        (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high")), F.lit(False)
    )
    return (
        observations.join(limits, "code", "left")
        .withColumn("is_critical", critical)
        .withColumn("requires_clinician_review", F.col("is_critical"))
        .drop("_low", "_high")
    )


def interpretation(observations: DataFrame, bands: DataFrame) -> DataFrame:
    """The first band of the code, sex and age that holds the value itself.

    ``observations`` carry ``code, sex, age, value``; a null sex or age matches
    every band. The bands come as one array per code, so a row stays one row.
    """
    arrays = (
        bands.groupBy("code").agg(
            F.array_sort(
                F.collect_list(
                    F.struct("band_pos", "sex", "age_min", "age_max", "low", "high", "interpretation")
                )
            ).alias("_bands")
        )
    )
    holds = F.filter(
        "_bands",
        lambda b: (F.col("sex").isNull() | (b["sex"] == "any") | (b["sex"] == F.col("sex")))
        & (F.col("age").isNull() | F.col("age").between(b["age_min"], b["age_max"]))
        & F.col("value").between(b["low"], b["high"]),
    )
    hit = F.try_element_at(F.col("_hit"), F.lit(1))
    return (
        observations.join(arrays, "code", "left")
        .withColumn("_hit", holds)
        .withColumn("band_pos", hit["band_pos"])
        .withColumn("interpretation", hit["interpretation"])
        .drop("_bands", "_hit")
    )


def overdue_monitoring(
    conditions: DataFrame,
    last_measured: DataFrame,
    guidelines: DataFrame,
    as_of: Column,
    stage_intervals: DataFrame | None = None,
) -> DataFrame:
    """Required measurements per patient and condition and how late they are.

    ``conditions``: patient_id, icd10_code and, where stages matter, stage.
    ``last_measured``: patient_id, code, last_ts. A guideline applies when the
    code equals one of its codes or refines it behind a dot.
    """
    # A code meets the guideline under itself or under its part before the dot.
    coded = conditions.withColumn(
        "icd", F.explode(F.array_distinct(F.array("icd10_code", F.split("icd10_code", r"\.")[0])))
    )
    if "stage" not in conditions.columns:
        coded = coded.withColumn("stage", F.lit(None).cast("string"))
    wanted = (
        guidelines.select(
            F.explode("icd10_codes").alias("icd"), "condition", "metric_code", "metric_name",
            "interval_days",
        )
    )
    due = (
        coded.join(wanted, "icd")
        .select("patient_id", "condition", "metric_code", "metric_name", "interval_days", "stage")
        .distinct()
    )
    if stage_intervals is not None:
        stages = (
            stage_intervals.select(
                "condition", "metric_code", "stage", F.col("interval_days").alias("_stage_days")
            )
        )
        due = (
            due.join(stages, ["condition", "metric_code", "stage"], "left")
            .withColumn("interval_days", F.coalesce("_stage_days", "interval_days"))
            .drop("_stage_days")
        )
    last = last_measured.select("patient_id", F.col("code").alias("metric_code"), "last_ts")
    late = (
        due.join(last, ["patient_id", "metric_code"], "left")
        .withColumn("days_since_last", F.floor(days_between(as_of, F.col("last_ts"))).cast("int"))
        .withColumn("days_overdue", F.col("days_since_last") - F.col("interval_days"))
    )
    ratio = F.col("days_since_last") / F.col("interval_days")
    severity = (
        F.when(F.col("last_ts").isNull() | (ratio > 3.0), "critical")
        .when(ratio > 2.0, "high")
        .when(ratio > 1.5, "moderate")
        .when(ratio > 1.0, "low")
    )
    return late.withColumn("severity", severity).withColumn(
        "is_overdue", F.col("severity").isNotNull()
    )
