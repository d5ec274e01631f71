"""Longitudinal trends per patient and code.

``observations``: patient_id, code, entity_id, document_id, value, unit, ts,
confidence, low, high, ord (arrival ordinal: history 0, current 1).

A trend is built in two steps. Step one runs windows inside a slice of a series
(see :mod:`carefold.operators.series`) and aggregates the slice to one row.
Step two orders the slice rows of a series and stitches them. Only slice rows
reach step two, so a series with billions of points costs no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.ids import entity_uuid
from carefold.functions.text import days_between, exact_round, first_number
from carefold.operators import series

KEYS = ["patient_id", "code"]
ORDER = ["ts", "ord", "entity_id"]


# --------------------------------------------------------------------------- points
def build_points(entities: DataFrame, coded: DataFrame, as_of: Column, undated: str = "now") -> DataFrame:
    """Current observations: entities joined to their codes by ``temp_id``.

    The first number in the value counts. A missing date becomes ``as_of``
    (``undated="now"``) or drops the row (``"skip"``).
    """
    codes = coded.filter(F.coalesce(F.col("canonical_code"), F.lit("")) != "").select(
        "document_id", "temp_id", "canonical_code", "normalized_value", "unit_canonical",
        "coding_confidence", "reference_range_low", "reference_range_high",
    )
    base = entities.select("document_id", "patient_id", "temp_id", "raw_value", "entity_date")
    dated = F.coalesce("entity_date", as_of) if undated == "now" else F.col("entity_date")
    text = F.coalesce(F.when(F.col("normalized_value") != "", F.col("normalized_value")), "raw_value")
    return (
        base.join(codes, ["document_id", "temp_id"])
        .select(
            "patient_id",
            F.col("canonical_code").alias("code"),
            entity_uuid(F.col("document_id"), F.col("temp_id")).alias("entity_id"),
            "document_id",
            first_number(text).alias("value"),
            F.col("unit_canonical").alias("unit"),
            dated.alias("ts"),
            F.col("coding_confidence").alias("confidence"),
            F.col("reference_range_low").alias("low"),
            F.col("reference_range_high").alias("high"),
            F.lit(1).alias("ord"),
        )
        .filter(F.col("value").isNotNull() & F.col("ts").isNotNull())
    )


def history_points(clinical_entities: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Persisted observations, for the series that ``current`` touches or for all."""
    stored = clinical_entities.filter(
        F.col("entity_date").isNotNull() & F.col("canonical_code").isNotNull()
    ).select(
        "patient_id", F.col("canonical_code").alias("code"), F.col("id").alias("entity_id"),
        "document_id", first_number(F.col("normalized_value")).alias("value"),
        F.col("unit_canonical").alias("unit"), F.col("entity_date").alias("ts"),
        "confidence", F.col("reference_range_low").alias("low"),
        F.col("reference_range_high").alias("high"), F.lit(0).alias("ord"),
    ).filter(F.col("value").isNotNull())
    if current is None:
        return stored
    return stored.join(current.select(*KEYS).distinct(), KEYS, "left_semi")


def merge_series(history: DataFrame, current: DataFrame) -> DataFrame:
    return history.unionByName(current)


# --------------------------------------------------------------------------- rules
def side(value: Column, low: Column, high: Column) -> Column:
    """1 above the range, -1 below it, 0 inside; a missing bound is no bound."""
    return F.when(value > high, 1).when(value < low, -1).otherwise(0)


def is_crossing(previous: Column, value: Column, low: Column, high: Column) -> Column:
    """The pair changes between inside and outside of the current point's range.

    Without a range both sides are inside, so such pairs never cross.
    """
    return previous.isNotNull() & (
        (side(previous, low, high) == 0) != (side(value, low, high) == 0)
    )


def crossing_type(value: Column, low: Column, high: Column) -> Column:
    return (
        F.when(value > high, "above_high").when(value < low, "below_low").otherwise("within_range")
    )


def is_abnormal(value: Column, low: Column, high: Column) -> Column:
    """Outside its range; a point without a range is not."""
    return side(value, low, high) != 0


def direction(first: Column, last: Column, count: Column, band: float = settings.STABLE_BAND_PCT) -> Column:
    moved = F.when(
        first == 0, F.when(last != 0, 100.0).otherwise(0.0)
    ).otherwise(F.try_divide(F.abs(last - first), F.abs(first)) * 100.0)
    return (
        F.when(count < 2, "insufficient_data")
        .when(moved < band, "stable")
        .when(last > first, "increasing")
        .otherwise("decreasing")
    )


def clinical_label(direction_: Column, higher_is_better: Column) -> Column:
    moving = direction_.isin("increasing", "decreasing")
    return (
        F.when(~moving | higher_is_better.isNull(), "stable")
        .when((direction_ == "increasing") == higher_is_better, "improving")
        .otherwise("worsening")
    )


def percent_change(value: Column, previous: Column) -> Column:
    return F.try_divide(value - previous, F.abs(F.nullif(previous, F.lit(0.0)))) * 100.0


def significance_reason(
    name: Column, persistent: Column, crossings: Column, label: Column
) -> Column:
    """Null when nothing is significant."""
    text = F.concat_ws(
        "; ",
        F.when(
            persistent,
            F.format_string(
                f"%s was outside its reference range in each of the last "
                f"{settings.PERSISTENCE_COUNT} readings", name
            ),
        ),
        F.when(
            crossings > 0, F.format_string("%s crossed its reference range %d time(s)", name, crossings)
        ),
        F.when(label == "worsening", F.format_string("%s trend is worsening", name)),
    )
    return F.when(text != "", text)


# --------------------------------------------------------------------------- step one
_POINT = ["ts", "ord", "entity_id", "value", "low", "high", "unit"]


def summarise_slices(sliced: DataFrame) -> DataFrame:
    """One row per (series, slice). Window and aggregate share one shuffle."""
    w = series.slice_window(KEYS, ORDER)
    point = F.struct(*_POINT)
    paired = (
        sliced.withColumn("point", point)
        .withColumn("p1", F.lag("point", 1).over(w))
        .withColumn("p2", F.lag("point", 2).over(w))
    )
    tail = F.array_compact(F.array("p2", "p1", "point"))
    return paired.groupBy(*KEYS, "slice").agg(
        F.count("*").alias("points"),
        F.sum("confidence").alias("confidence_sum"),
        F.min("point").alias("first_point"),
        F.max_by(tail, "point").alias("tail"),
        F.max(days_between(F.col("ts"), F.col("p1.ts"))).alias("max_gap"),
        F.count_if(
            is_crossing(F.col("p1.value"), F.col("value"), F.col("low"), F.col("high"))
        ).alias("crossings"),
    )


# --------------------------------------------------------------------------- step two
def stitch_slices(slices: DataFrame) -> DataFrame:
    """One row per series from its slice rows; needs no point again."""
    w = series.between_slices(KEYS)
    prev_last = F.try_element_at(F.lag("tail", 1).over(w), F.lit(-1))
    linked = (
        slices.withColumn("before", prev_last)
        .withColumn(
            "long_tail",
            F.concat(
                F.coalesce(F.lag("tail", 2).over(w), F.slice("tail", 1, 0)),
                F.coalesce(F.lag("tail", 1).over(w), F.slice("tail", 1, 0)),
                F.col("tail"),
            ),
        )
        .withColumn("edge_gap", days_between(F.col("first_point.ts"), F.col("before.ts")))
        .withColumn(
            "edge_crossing",
            F.when(
                is_crossing(
                    F.col("before.value"), F.col("first_point.value"),
                    F.col("first_point.low"), F.col("first_point.high"),
                ),
                1,
            ).otherwise(0),
        )
    )
    return linked.groupBy(*KEYS).agg(
        F.sum("points").alias("data_point_count"),
        F.sum("confidence_sum").alias("confidence_sum"),
        F.min("first_point").alias("first_point"),
        F.max_by("long_tail", "slice").alias("long_tail"),
        F.greatest(F.max("max_gap"), F.max("edge_gap")).alias("max_gap_days"),
        F.sum(F.col("crossings") + F.col("edge_crossing")).alias("crossing_count"),
    ).withColumn(
        "tail",
        F.slice(
            "long_tail",
            F.greatest(F.size("long_tail") - (settings.PERSISTENCE_COUNT - 1), F.lit(1)),
            F.lit(settings.PERSISTENCE_COUNT),
        ),
    ).drop("long_tail")


def finish_trends(
    stitched: DataFrame, metrics: DataFrame, as_of: Column, tolerance: float = settings.GAP_TOLERANCE
) -> DataFrame:
    """Rates, labels, flags and reasons of each stitched series."""
    named = stitched.join(metrics, "code", "left").select(
        stitched["*"],
        F.coalesce("metric_name", "code").alias("metric_name"),
        "higher_is_better",
        F.coalesce("interval_days", F.lit(settings.DEFAULT_INTERVAL_DAYS)).alias(
            "expected_interval_days"
        ),
    )
    last, previous = F.try_element_at("tail", F.lit(-1)), F.try_element_at("tail", F.lit(-2))
    flat = named.select(
        "*",
        F.col("first_point.value").alias("first_value"),
        F.col("first_point.ts").alias("first_ts"),
        last["value"].alias("latest_value"),
        last["ts"].alias("last_ts"),
        last["unit"].alias("unit"),
        previous["value"].alias("previous_value"),
    )
    elapsed = days_between(F.col("last_ts"), F.col("first_ts"))
    persistent = (F.size("tail") == settings.PERSISTENCE_COUNT) & F.forall(
        "tail", lambda p: is_abnormal(p["value"], p["low"], p["high"])
    )
    allowed = F.col("expected_interval_days") * tolerance
    measured = (
        flat.withColumn(
            "direction",
            direction(F.col("first_value"), F.col("latest_value"), F.col("data_point_count")),
        )
        .withColumn(
            "clinical_trend", clinical_label(F.col("direction"), F.col("higher_is_better"))
        )
        .withColumn("absolute_change", F.col("latest_value") - F.col("previous_value"))
        .withColumn(
            "percentage_change", percent_change(F.col("latest_value"), F.col("previous_value"))
        )
        .withColumn(
            "rate_of_change",
            F.when(elapsed > 0, (F.col("latest_value") - F.col("first_value")) / elapsed),
        )
        .withColumn("abnormal_persistence", persistent)
        .withColumn("days_since_last", days_between(as_of, F.col("last_ts")))
        .withColumn(
            "monitoring_gap_detected",
            (F.col("days_since_last") > allowed)
            | F.coalesce(F.col("max_gap_days") > allowed, F.lit(False)),
        )
        .withColumn(
            "statistical_confidence",
            exact_round(F.col("confidence_sum") / F.col("data_point_count"), 4),
        )
        .withColumn(
            "clinical_significance_reason",
            significance_reason(
                F.col("metric_name"), F.col("abnormal_persistence"), F.col("crossing_count"),
                F.col("clinical_trend"),
            ),
        )
    )
    return measured.select(
        *KEYS, "metric_name", "data_point_count", "direction", "clinical_trend",
        "absolute_change", "percentage_change", "rate_of_change", "statistical_confidence",
        F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("timestamp").alias("change_point_date"),
        F.col("clinical_significance_reason").isNotNull().alias("is_clinically_significant"),
        "clinical_significance_reason", "crossing_count", "abnormal_persistence",
        "monitoring_gap_detected", "expected_interval_days",
        "first_ts", "last_ts", "first_value", "latest_value", "previous_value", "unit",
        "days_since_last", "max_gap_days",
    )


def analyse_trends(
    observations: DataFrame,
    metrics: DataFrame,
    as_of: Column,
    hot_rows: int = settings.HOT_GROUP_ROWS,
) -> DataFrame:
    """The trend of every (patient, code) series."""
    sliced = series.cut_series(observations, KEYS, ORDER, hot_rows)
    return finish_trends(stitch_slices(summarise_slices(sliced)), metrics, as_of)


# --------------------------------------------------------------------------- long forms
def linked_points(
    observations: DataFrame, hot_rows: int = settings.HOT_GROUP_ROWS
) -> DataFrame:
    """Every point with the value and time before it in its series."""
    sliced = series.cut_series(observations, KEYS, ORDER, hot_rows)
    w = series.slice_window(KEYS, ORDER)
    previous = F.struct("value", "ts")
    inner = sliced.withColumn("_prev", F.lag(previous).over(w))
    # The last point of a slice precedes the first one of the next.
    ends = sliced.groupBy(*KEYS, "slice").agg(
        F.max_by(previous, F.struct(*ORDER)).alias("_last")
    )
    bridge = ends.select(
        *KEYS, "slice", F.lag("_last").over(series.between_slices(KEYS)).alias("_bridge")
    ).filter(F.col("_bridge").isNotNull())
    return (
        inner.join(bridge, [*KEYS, "slice"], "left")
        .withColumn("_prev", F.coalesce("_prev", "_bridge"))
        .select(
            *observations.columns,
            F.col("_prev.value").alias("previous_value"), F.col("_prev.ts").alias("previous_ts"),
        )
    )


def threshold_crossings(
    observations: DataFrame, hot_rows: int = settings.HOT_GROUP_ROWS
) -> DataFrame:
    """One row per consecutive pair that enters or leaves the reference range."""
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    previous = F.col("previous_value")
    return (
        linked_points(observations, hot_rows)
        .filter(is_crossing(previous, value, low, high))
        .select(
            *KEYS, "entity_id", "ts",
            previous.alias("from_value"), value.alias("to_value"),
            # The pair crosses, so the current side alone tells the direction.
            F.when(is_abnormal(value, low, high), "exited_range")
            .otherwise("entered_range")
            .alias("direction"),
            crossing_type(value, low, high).alias("crossing_type"),
        )
    )


def trend_points(
    observations: DataFrame, hot_rows: int = settings.HOT_GROUP_ROWS
) -> DataFrame:
    """Chronological points of every series, numbered from 1."""
    return series.number_rows(observations, KEYS, ORDER, hot_rows).select(
        *KEYS, "seq", "entity_id", "document_id", "value",
        F.coalesce("unit", F.lit("")).alias("unit"), "ts", "confidence",
    )


def nested_points(
    observations: DataFrame,
    page_rows: int = settings.PAGE_ROWS,
    hot_rows: int = settings.HOT_GROUP_ROWS,
) -> DataFrame:
    """Points as arrays of at most ``page_rows`` per row."""
    points = trend_points(observations, hot_rows)
    fields = ["entity_id", "document_id", "value", "unit", "ts", "confidence"]
    return series.paged_nest(points, KEYS, fields, "seq", page_rows, "data_points")


def monitoring_gaps(trends: DataFrame) -> DataFrame:
    return trends.filter("monitoring_gap_detected").select(
        "patient_id", "metric_name", F.col("code").alias("metric_canonical_code"),
        F.col("last_ts").alias("last_measurement_date"), "expected_interval_days",
    )


def insufficient_metrics(trends: DataFrame) -> DataFrame:
    return trends.filter(F.col("direction") == "insufficient_data").select(
        "patient_id", "metric_name"
    )


def trend_sets(trends: DataFrame) -> DataFrame:
    """Per patient: trends, gaps and metrics without enough data.

    A patient has at most one trend per code of the ontology.
    """
    gap = F.struct("metric_name", "code", "last_ts", "expected_interval_days")
    return trends.groupBy("patient_id").agg(
        F.array_sort(
            F.collect_list(F.struct("code", "metric_name", "direction", "clinical_trend"))
        ).alias("trends"),
        F.array_sort(F.collect_list(F.when(F.col("monitoring_gap_detected"), gap))).alias("gaps"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("direction") == "insufficient_data", F.col("metric_name"))
            )
        ).alias("insufficient_data_metrics"),
    )


def latest_two(observations: DataFrame) -> DataFrame:
    """Latest and previous value per series by a map-side top two."""
    w = Window.partitionBy(*KEYS).orderBy(*[F.col(c).desc() for c in ORDER])
    top = observations.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    return top.groupBy(*KEYS).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("value"))).alias("latest_value"),
        F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("previous_value"),
        F.max("ts").alias("last_ts"),
    )
