"""Trend, monitoring and critical-value queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.operators import monitoring, series, trends
from carefold.plans.inputs import AS_OF, ENTITIES, OBSERVATIONS, Inputs, sql_select
from carefold.plans.registry import query, values_sql
from carefold.sources import knowledge
from carefold.sources import knowledge_values as kv
from carefold.sources import tables

_OBS = sql_select(OBSERVATIONS, "events")
_METRICS = values_sql(list(kv.METRICS), "code, metric_name, higher_is_better, interval_days")

# The trend of each series in one pass of windows over its points.
TREND_SQL = f"""
WITH obs AS ({_OBS}),
metrics AS (SELECT * FROM {_METRICS}),
pts AS (
  SELECT *,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY patient_id, code) AS n,
    lag(value) OVER w AS pv, lag(ts) OVER w AS pts,
    (low IS NOT NULL OR high IS NOT NULL) AS has_range,
    NOT (coalesce(value < low, FALSE) OR coalesce(value > high, FALSE)) AS is_in,
    NOT (coalesce(lag(value) OVER w < low, FALSE) OR coalesce(lag(value) OVER w > high, FALSE)) AS was_in
  FROM obs WINDOW w AS (PARTITION BY patient_id, code ORDER BY ts, ord, entity_id)
),
ser AS (
  SELECT patient_id, code, max(n) AS n,
    max(CASE WHEN rn = 1 THEN value END) AS first_value, max(CASE WHEN rn = n THEN value END) AS last_value,
    max(CASE WHEN rn = n - 1 THEN value END) AS prev_value,
    min(ts) AS first_ts, max(ts) AS last_ts,
    max(date_diff('microsecond', pts, ts)) / 86400000000.0 AS max_gap,
    CAST(sum(CASE WHEN pv IS NOT NULL AND has_range AND was_in <> is_in THEN 1 ELSE 0 END) AS BIGINT) AS crossings,
    count(*) FILTER (WHERE rn > n - 3) = 3
      AND bool_and(CASE WHEN rn > n - 3 THEN has_range AND NOT is_in ELSE TRUE END) AS persistent,
    round(avg(confidence), 4) AS confidence,
    max(CASE WHEN rn = n THEN unit END) AS unit
  FROM pts GROUP BY patient_id, code
),
moved AS (
  SELECT s.*, coalesce(m.metric_name, s.code) AS metric_name, m.higher_is_better,
    coalesce(m.interval_days, 180) AS interval_days,
    CASE WHEN first_value = 0 THEN CASE WHEN last_value <> 0 THEN 100.0 ELSE 0.0 END
         ELSE abs(last_value - first_value) / abs(first_value) * 100.0 END AS pct_move,
    date_diff('microsecond', last_ts, TIMESTAMP '{AS_OF}') / 86400000000.0 AS since_last,
    date_diff('microsecond', first_ts, last_ts) / 86400000000.0 AS elapsed
  FROM ser s LEFT JOIN metrics m ON s.code = m.code
),
dir AS (
  SELECT *, CASE WHEN n < 2 THEN 'insufficient_data' WHEN pct_move < 5.0 THEN 'stable'
    WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS direction
  FROM moved
),
lab AS (
  SELECT *, CASE WHEN direction IN ('stable', 'insufficient_data') OR higher_is_better IS NULL THEN 'stable'
    WHEN (direction = 'increasing') = higher_is_better THEN 'improving' ELSE 'worsening' END AS clinical_trend,
    (since_last > interval_days * 1.5 OR coalesce(max_gap > interval_days * 1.5, FALSE)) AS gap
  FROM dir
),
tr AS (
  SELECT *, nullif(concat_ws('; ',
    CASE WHEN persistent THEN metric_name || ' was outside its reference range in each of the last 3 readings' END,
    CASE WHEN crossings > 0 THEN metric_name || ' crossed its reference range ' || crossings || ' time(s)' END,
    CASE WHEN clinical_trend = 'worsening' THEN metric_name || ' trend is worsening' END), '') AS reason
  FROM lab
)
"""


def trend_table(i: Inputs) -> DataFrame:
    return trends.analyse_trends(
        i.observations(), knowledge.builtin_metrics(i.spark), i.as_of()
    )


def _r(name: str):
    return F.round(name, 4).alias(name)


SUMMARY_SQL = TREND_SQL + """
SELECT patient_id, code, metric_name, n AS data_point_count, direction, clinical_trend,
  round(last_value - prev_value, 4) AS absolute_change,
  round((last_value - prev_value) / nullif(abs(prev_value), 0) * 100.0, 4) AS percentage_change,
  round(CASE WHEN elapsed > 0 THEN (last_value - first_value) / elapsed END, 4) AS rate_of_change,
  confidence AS statistical_confidence, reason IS NOT NULL AS is_clinically_significant,
  reason AS clinical_significance_reason, crossings AS crossing_count,
  persistent AS abnormal_persistence, gap AS monitoring_gap_detected, interval_days AS expected_interval_days
FROM tr"""


def summary_columns(trend: DataFrame) -> DataFrame:
    return trend.select(
        "patient_id", "code", "metric_name", "data_point_count", "direction", "clinical_trend",
        _r("absolute_change"), _r("percentage_change"), _r("rate_of_change"),
        "statistical_confidence", "is_clinically_significant", "clinical_significance_reason",
        "crossing_count", "abnormal_persistence", "monitoring_gap_detected",
        "expected_interval_days",
    )


@query("trend_summary", SUMMARY_SQL)
def trend_summary(i: Inputs) -> DataFrame:
    return summary_columns(trend_table(i))


@query("trend_points", f"""
SELECT patient_id, code, row_number() OVER (PARTITION BY patient_id, code ORDER BY ts, ord, entity_id) AS seq,
  entity_id, round(value, 4) AS value, unit, round(confidence, 4) AS confidence FROM ({_OBS}) o""")
def trend_points(i: Inputs) -> DataFrame:
    return trends.trend_points(i.observations()).select(
        "patient_id", "code", "seq", "entity_id", _r("value"), "unit", _r("confidence")
    )


@query("trend_points_nested", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY patient_id, code ORDER BY ts, ord, entity_id) AS seq
           FROM ({_OBS}) o)
SELECT patient_id, code, CAST((seq - 1) // 8 AS INTEGER) AS page_no, count(*) AS points,
  string_agg(entity_id, ',' ORDER BY seq) AS entity_ids
FROM p GROUP BY ALL""")
def trend_points_nested(i: Inputs) -> DataFrame:
    return trends.nested_points(i.observations(), page_rows=8).select(
        "patient_id", "code", "page_no", F.size("data_points").cast("long").alias("points"),
        F.array_join("data_points.entity_id", ",").alias("entity_ids"),
    )


@query("series_build", f"""
WITH e AS ({sql_select(ENTITIES, 'lineitem')})
SELECT patient_id, canonical_code AS code, count(*) AS points,
  round(sum(CAST(regexp_extract(coalesce(nullif(normalized_value, ''), raw_value), '[-+]?\\d+(?:\\.\\d+)?') AS DOUBLE)), 4) AS value_sum,
  CAST(sum(CASE WHEN entity_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undated
FROM e WHERE canonical_code IS NOT NULL GROUP BY ALL""")
def series_build(i: Inputs) -> DataFrame:
    """Points from entities and codes, undated ones at the as-of time."""
    e = i.entities()
    points = trends.build_points(e, e, i.as_of())
    return points.groupBy("patient_id", "code").agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("value_sum"),
        F.count_if(F.col("ts") == i.as_of()).alias("undated"),
    )


@query("series_history", f"""
WITH e AS ({sql_select(ENTITIES, 'lineitem')}),
cur AS (SELECT DISTINCT patient_id, code FROM ({_OBS}) o WHERE code = '2160-0')
SELECT patient_id, canonical_code AS code, count(*) AS points,
  round(sum(CAST(regexp_extract(normalized_value, '[-+]?\\d+(?:\\.\\d+)?') AS DOUBLE)), 4) AS value_sum
FROM e WHERE canonical_code IS NOT NULL AND entity_date IS NOT NULL
  AND EXISTS (SELECT 1 FROM cur WHERE cur.patient_id = e.patient_id)
GROUP BY ALL""")
def series_history(i: Inputs) -> DataFrame:
    """Stored history of the series the current points touch, in one join."""
    stored = i.entities().withColumnRenamed("temp_id", "id").withColumn("confidence", F.lit(0.9))
    current = (
        i.observations().filter("code = '2160-0'").select("patient_id").distinct()
        .join(stored.select("patient_id", F.col("canonical_code").alias("code")).distinct(), "patient_id")
    )
    points = trends.history_points(stored, current)
    return points.groupBy("patient_id", "code").agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 4).alias("value_sum")
    )


for _name, _column, _expression in (
    ("absolute_change", "absolute_change", "round(last_value - prev_value, 4)"),
    ("percentage_change", "percentage_change",
     "round((last_value - prev_value) / nullif(abs(prev_value), 0) * 100.0, 4)"),
    ("rate_of_change", "rate_of_change",
     "round(CASE WHEN elapsed > 0 THEN (last_value - first_value) / elapsed END, 4)"),
    ("mean_series_confidence", "statistical_confidence", "confidence"),
):
    def _numeric(i: Inputs, column: str = _column) -> DataFrame:
        return trend_table(i).select("patient_id", "code", _r(column))

    query(_name, TREND_SQL + f"SELECT patient_id, code, {_expression} AS {_column} FROM tr")(_numeric)

for _name, _columns, _expressions in (
    ("trend_direction", ["direction"], "direction"),
    ("clinical_label", ["metric_name", "clinical_trend"], "metric_name, clinical_trend"),
    ("abnormal_persistence", ["abnormal_persistence"], "persistent AS abnormal_persistence"),
    ("metric_configuration", ["metric_name", "expected_interval_days"],
     "metric_name, interval_days AS expected_interval_days"),
    ("significance", ["is_clinically_significant", "clinical_significance_reason"],
     "reason IS NOT NULL AS is_clinically_significant, reason AS clinical_significance_reason"),
):
    def _plain(i: Inputs, columns: list[str] = _columns) -> DataFrame:
        return trend_table(i).select("patient_id", "code", *columns)

    query(_name, TREND_SQL + f"SELECT patient_id, code, {_expressions} FROM tr")(_plain)


@query("threshold_crossings", TREND_SQL + """
SELECT patient_id, code, entity_id, pv AS from_value, value AS to_value,
  CASE WHEN was_in THEN 'exited_range' ELSE 'entered_range' END AS direction,
  CASE WHEN value > high THEN 'above_high' WHEN value < low THEN 'below_low' ELSE 'within_range' END AS crossing_type
FROM pts WHERE pv IS NOT NULL AND has_range AND was_in <> is_in""")
def threshold_crossings(i: Inputs) -> DataFrame:
    return trends.threshold_crossings(i.observations()).drop("ts")


@query("monitoring_gaps", TREND_SQL + """
SELECT patient_id, metric_name, code AS metric_canonical_code,
  strftime(last_ts, '%Y-%m-%d') AS last_measurement_date, interval_days AS expected_interval_days
FROM tr WHERE gap""")
def monitoring_gaps(i: Inputs) -> DataFrame:
    return trends.monitoring_gaps(trend_table(i)).withColumn(
        "last_measurement_date", F.date_format("last_measurement_date", "yyyy-MM-dd")
    )


@query("insufficient_metrics", TREND_SQL + """
SELECT patient_id, metric_name FROM tr WHERE n < 2
UNION ALL SELECT CAST(document_id AS BIGINT), code FROM (
  SELECT document_id, code, count(*) AS c FROM obs GROUP BY ALL) d WHERE c < 2""")
def insufficient_metrics(i: Inputs) -> DataFrame:
    """Series of patients and, as a finer cut, of documents with a single point."""
    per_document = i.observations().withColumn("patient_id", F.col("document_id").cast("long"))
    bare = knowledge.builtin_metrics(i.spark).filter("false")
    fine = trends.analyse_trends(per_document, bare, i.as_of())
    return trends.insufficient_metrics(trend_table(i)).unionByName(trends.insufficient_metrics(fine))


@query("trend_rows", TREND_SQL + """
SELECT patient_id, metric_name, code AS metric_canonical_code, n AS data_point_count,
  strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS trend_start, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS trend_end
FROM tr""")
def trend_rows(i: Inputs) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    return tables.trend_rows(trend_table(i)).select(
        "patient_id", "metric_name", "metric_canonical_code", "data_point_count",
        F.date_format("trend_start_date", stamp).alias("trend_start"),
        F.date_format("trend_end_date", stamp).alias("trend_end"),
    )


@query("trend_sets", TREND_SQL + """
SELECT patient_id, count(*) AS trend_count, string_agg(code, ',' ORDER BY code) AS codes,
  coalesce(string_agg(CASE WHEN gap THEN code END, ',' ORDER BY metric_name, code), '') AS gap_codes
FROM tr GROUP BY patient_id""")
def trend_sets(i: Inputs) -> DataFrame:
    return trends.trend_sets(trend_table(i)).select(
        "patient_id", F.size("trends").cast("long").alias("trend_count"),
        F.array_join("trends.code", ",").alias("codes"),
        F.array_join("gaps.code", ",").alias("gap_codes"),
    )


@query("latest_and_previous", TREND_SQL + f"""
SELECT patient_id, code, last_value AS latest_value, prev_value AS previous_value,
  strftime(first_ts, '%Y-%m-%d') AS first_date, strftime(last_ts, '%Y-%m-%d') AS last_date,
  greatest(0, CAST(floor(since_last) AS INTEGER) - interval_days) AS days_overdue FROM tr""")
def latest_and_previous(i: Inputs) -> DataFrame:
    return trend_table(i).select(
        "patient_id", "code", "latest_value", "previous_value",
        F.date_format("first_ts", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_ts", "yyyy-MM-dd").alias("last_date"),
        F.greatest(
            F.lit(0), F.floor("days_since_last").cast("int") - F.col("expected_interval_days")
        ).alias("days_overdue"),
    )


@query("latest_two_readings", TREND_SQL + """
SELECT patient_id, code, last_value AS latest_value, prev_value AS previous_value FROM tr""")
def latest_two_readings(i: Inputs) -> DataFrame:
    return trends.latest_two(i.observations()).drop("last_ts")


@query("series_numbering", f"""
SELECT patient_id, event_day, row_number() OVER (PARTITION BY patient_id ORDER BY ts, entity_id) AS seq, entity_id
FROM (SELECT *, CAST(strftime(ts, '%d') AS INTEGER) AS event_day FROM ({_OBS}) o) x""")
def series_numbering(i: Inputs) -> DataFrame:
    """Positions within a patient with every series of over 32 rows cut into slices."""
    rows = i.observations().withColumn("event_day", F.dayofmonth("ts"))
    return series.number_rows(rows, ["patient_id"], ["ts", "entity_id"], hot_rows=32).select(
        "patient_id", "event_day", "seq", "entity_id"
    )


_ICD = values_sql(
    [(c, icd, m, name, days) for c, _, codes, metrics in kv.GUIDELINES
     for m, name, days, _, _ in metrics for icd in codes],
    "condition, icd, metric_code, metric_name, interval_days",
)
_STAGES = values_sql(list(kv.STAGE_INTERVALS), "condition, metric_code, stage, interval_days")
_CONDITION = ("CASE user_id % 6 WHEN 0 THEN 'E11.9' WHEN 1 THEN 'I10' WHEN 2 THEN 'N18.3' "
              "WHEN 3 THEN 'E03.9' WHEN 4 THEN 'E78.5' ELSE 'E11.65' END")
_STAGE = "CASE WHEN user_id % 12 = 2 THEN 'G3a' WHEN user_id % 12 = 8 THEN 'G3b' END"


@query("overdue_monitoring", f"""
WITH cond AS (SELECT DISTINCT user_id AS patient_id, {_CONDITION} AS icd10_code, {_STAGE} AS stage FROM events),
g AS (SELECT * FROM {_ICD}), st AS (SELECT * FROM {_STAGES}),
due AS (
  SELECT DISTINCT c.patient_id, g.condition, g.metric_code, g.metric_name,
    coalesce(st.interval_days, g.interval_days) AS interval_days
  FROM cond c JOIN g ON g.icd IN (c.icd10_code, split_part(c.icd10_code, '.', 1))
  LEFT JOIN st ON st.condition = g.condition AND st.metric_code = g.metric_code AND st.stage = c.stage),
lm AS (SELECT patient_id, code, max(ts) AS last_ts FROM ({_OBS}) o GROUP BY ALL),
j AS (
  SELECT d.*, lm.last_ts,
    CAST(floor(date_diff('microsecond', lm.last_ts, TIMESTAMP '{AS_OF}') / 86400000000.0) AS INTEGER) AS days_since_last
  FROM due d LEFT JOIN lm ON lm.patient_id = d.patient_id AND lm.code = d.metric_code)
SELECT patient_id, condition, metric_code, metric_name, interval_days, days_since_last,
  days_since_last - interval_days AS days_overdue,
  CASE WHEN last_ts IS NULL OR days_since_last / interval_days > 3.0 THEN 'critical'
    WHEN days_since_last / interval_days > 2.0 THEN 'high' WHEN days_since_last / interval_days > 1.5 THEN 'moderate'
    WHEN days_since_last / interval_days > 1.0 THEN 'low' END AS severity
FROM j""")
def overdue_monitoring(i: Inputs) -> DataFrame:
    events = i.table("events")
    conditions = events.selectExpr(
        "user_id AS patient_id", f"{_CONDITION} AS icd10_code", f"{_STAGE} AS stage"
    ).distinct()
    last = i.observations().groupBy("patient_id", "code").agg(F.max("ts").alias("last_ts"))
    return monitoring.overdue_monitoring(
        conditions, last, knowledge.builtin_guidelines(i.spark), i.as_of(),
        knowledge.builtin_stage_intervals(i.spark),
    ).select(
        "patient_id", "condition", "metric_code", "metric_name", "interval_days",
        "days_since_last", "days_overdue", "severity",
    )


_RULES = values_sql(
    [(r[0], r[1], r[2], r[4], r[5]) for r in kv.CRITICAL_RULES],
    "code, condition, threshold, action, reason",
)
_RULE_OBS = f"SELECT *, CASE WHEN code = '6690-2' THEN '2823-3' ELSE code END AS rc FROM ({_OBS}) o"


def _rule_observations(i: Inputs) -> DataFrame:
    return i.observations().withColumn(
        "code", F.when(F.col("code") == "6690-2", "2823-3").otherwise(F.col("code"))
    )


@query("critical_values", f"""
SELECT o.entity_id, o.rc AS code, o.value, r.condition, r.action, r.reason
FROM ({_RULE_OBS}) o JOIN {_RULES.replace(' AS v(', ' AS r(')} ON r.code = o.rc
WHERE CASE WHEN r.condition = 'low' THEN o.value < r.threshold ELSE o.value > r.threshold END""")
def critical_values(i: Inputs) -> DataFrame:
    return monitoring.critical_values(
        _rule_observations(i), knowledge.builtin_critical_rules(i.spark)
    ).select("entity_id", "code", "value", "condition", "action", "reason")


@query("critical_flag", f"""
WITH lim AS (SELECT code, max(CASE WHEN condition = 'low' THEN threshold END) AS lo,
  min(CASE WHEN condition = 'high' THEN threshold END) AS hi FROM {_RULES} GROUP BY code)
SELECT o.entity_id, o.rc AS code, coalesce(o.value < lo OR o.value > hi, FALSE) AS requires_clinician_review
FROM ({_RULE_OBS}) o LEFT JOIN lim ON lim.code = o.rc""")
def critical_flag(i: Inputs) -> DataFrame:
    return monitoring.flag_critical(
        _rule_observations(i), knowledge.builtin_critical_rules(i.spark)
    ).select("entity_id", "code", "requires_clinician_review")


_BANDS = values_sql(
    [(c, u, p, *b) for c, u, _, _, bands in kv.BANDS for p, b in enumerate(bands)],
    "code, unit, band_pos, sex, age_min, age_max, low, high, interpretation",
)
_LADDER_CODE = ("CASE event_type WHEN 'click' THEN '33914-3' WHEN 'view' THEN '8480-6' WHEN 'error' THEN '2093-3' "
                "WHEN 'signup' THEN '2085-9' ELSE '4548-4' END")
_SEX = "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END"
_AGE = "CASE WHEN user_id % 4 <> 0 THEN CAST(user_id % 90 AS int) END"


@query("interpretation_ladder", f"""
WITH o AS (SELECT event_id, {_LADDER_CODE} AS code, {_SEX} AS sex, {_AGE} AS age, value FROM events),
b AS (SELECT * FROM {_BANDS}),
hit AS (SELECT o.event_id, min(b.band_pos) AS band_pos FROM o JOIN b ON b.code = o.code
  AND (o.sex IS NULL OR b.sex = 'any' OR b.sex = o.sex) AND (o.age IS NULL OR o.age BETWEEN b.age_min AND b.age_max)
  AND o.value BETWEEN b.low AND b.high GROUP BY o.event_id)
SELECT o.event_id, o.code, hit.band_pos, b.interpretation
FROM o LEFT JOIN hit ON hit.event_id = o.event_id LEFT JOIN b ON b.code = o.code AND b.band_pos = hit.band_pos""")
def interpretation_ladder(i: Inputs) -> DataFrame:
    readings = i.table("events").selectExpr(
        "event_id", f"{_LADDER_CODE} AS code", f"{_SEX} AS sex", f"{_AGE} AS age", "value"
    )
    return monitoring.interpretation(readings, knowledge.builtin_bands(i.spark)).select(
        "event_id", "code", "band_pos", "interpretation"
    )


_FACTORS = values_sql(
    [tuple(eval_row) for eval_row in kv.UNIT_FACTORS], "analyte, from_unit, to_unit, slope, offs"
)
_CONVERT = {
    "row_id": "CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string)",
    "analyte": "CASE l_linenumber % 4 WHEN 0 THEN 'glucose' WHEN 1 THEN 'temperature' WHEN 2 THEN 'weight' "
               "ELSE 'hemoglobin' END",
    "unit": "CASE l_linenumber % 4 WHEN 0 THEN 'mmol/L' WHEN 1 THEN 'F' WHEN 2 THEN 'lbs' ELSE 'g/dL' END",
    "target_unit": "CASE l_linenumber % 4 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'C' WHEN 2 THEN 'stone' ELSE 'g/dL' END",
    "value": "l_quantity",
}


@query("unit_conversion", f"""
WITH x AS ({sql_select(_CONVERT, 'lineitem')})
SELECT x.row_id, x.analyte, x.value,
  round(CASE WHEN x.unit = x.target_unit THEN x.value ELSE x.value * v.slope + v.offs END, 4) AS converted_value
FROM x LEFT JOIN {_FACTORS} ON v.analyte = x.analyte AND v.from_unit = x.unit AND v.to_unit = x.target_unit""")
def unit_conversion(i: Inputs) -> DataFrame:
    return monitoring.convert_units(
        i.derive("lineitem", _CONVERT), knowledge.builtin_unit_factors(i.spark)
    ).select("row_id", "analyte", "value", _r("converted_value"))


_ONE_TIME = f"SELECT * REPLACE (date_trunc('month', ts) AS ts) FROM ({_OBS}) o"


@query("equal_time_trends", TREND_SQL.replace(f"obs AS ({_OBS})", f"obs AS ({_ONE_TIME})") + """
SELECT patient_id, code, n AS data_point_count, direction, crossings AS crossing_count, persistent AS abnormal_persistence,
  round(last_value - prev_value, 4) AS absolute_change FROM tr""")
def equal_time_trends(i: Inputs) -> DataFrame:
    """Trends of series whose points all carry one time, each of over 8 points cut into slices by what comes after the time."""
    points = i.observations().withColumn("ts", F.date_trunc("month", "ts"))
    found = trends.analyse_trends(points, knowledge.builtin_metrics(i.spark), i.as_of(), hot_rows=8)
    return found.select(
        "patient_id", "code", "data_point_count", "direction", "crossing_count", "abnormal_persistence", _r("absolute_change")
    )
