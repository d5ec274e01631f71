"""Quality metrics against gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def extraction_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall, F1 and partial F1 per entity type.

    Both sides: document_id, entity_type, entity_key, value, one row per key. A
    key on both sides with another value counts half for the partial score.
    """
    keys = ["document_id", "entity_type", "entity_key"]
    both = predicted.select(*keys, F.col("value").alias("p"), F.lit(1).alias("in_p")).join(
        gold.select(*keys, F.col("value").alias("g"), F.lit(1).alias("in_g")), keys, "full_outer"
    )
    matched = F.col("in_p").isNotNull() & F.col("in_g").isNotNull()
    exact = matched & F.col("p").eqNullSafe(F.col("g"))
    counts = both.groupBy("entity_type").agg(
        F.count("in_p").alias("predicted"),
        F.count("in_g").alias("gold"),
        F.count_if(exact).alias("exact"),
        F.count_if(matched & ~exact).alias("partial"),
    )
    precision = _share(F.col("exact").cast("double"), F.col("predicted"))
    recall = _share(F.col("exact").cast("double"), F.col("gold"))
    credit = F.col("exact") + 0.5 * F.col("partial")
    return counts.select(
        "entity_type", "predicted", "gold", "exact", "partial",
        precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"),
        _f1(_share(credit, F.col("predicted")), _share(credit, F.col("gold"))).alias("partial_f1"),
    )


def coding_accuracy(checked: DataFrame) -> DataFrame:
    """Shares of right codes, conversions and ranges.

    ``checked``: code, gold_code, converted, gold_converted, low, high, gold_low,
    gold_high. Conversions may differ by one thousandth of the gold value.
    """
    right = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    close = F.abs(F.col("converted") - F.col("gold_converted")) <= 0.001 * F.abs(
        F.col("gold_converted")
    )
    return checked.agg(
        F.count("*").alias("samples"),
        right(F.col("code") == F.col("gold_code")).alias("code_accuracy"),
        right(close).alias("unit_conversion_accuracy"),
        right(
            F.col("low").eqNullSafe(F.col("gold_low")) & F.col("high").eqNullSafe(F.col("gold_high"))
        ).alias("reference_range_correctness"),
    )


def trend_accuracy(checked: DataFrame) -> DataFrame:
    """``direction, gold_direction`` per series: accuracy and false trends among stable ones."""
    moving = F.col("direction").isin("increasing", "decreasing")
    truly_stable = ~F.col("gold_direction").isin("increasing", "decreasing")
    return checked.agg(
        F.count("*").alias("series"),
        F.avg(F.when(F.col("direction") == F.col("gold_direction"), 1.0).otherwise(0.0)).alias(
            "trend_direction_accuracy"
        ),
        _share(
            F.count_if(moving & truly_stable).cast("double"), F.count_if(truly_stable)
        ).alias("false_positive_trend_rate"),
    )


def verification_scores(checked: DataFrame) -> DataFrame:
    """``kept, is_true, is_dangerous`` per claim: what verification removed and missed.

    Hallucination reduction is the share of false claims that were removed,
    dangerous omission the share of dangerous true claims that were removed.
    """
    removed = ~F.col("kept")
    false, danger = ~F.col("is_true"), F.col("is_true") & F.col("is_dangerous")
    return checked.agg(
        F.count("*").alias("claims"),
        _share(F.count_if(false & removed).cast("double"), F.count_if(false)).alias(
            "hallucination_reduction_rate"
        ),
        _share(F.count_if(danger & removed).cast("double"), F.count_if(danger)).alias(
            "dangerous_omission_rate"
        ),
        _share(F.count_if(false & removed).cast("double"), F.count_if(removed)).alias(
            "precision_of_stripped_claims"
        ),
    )
