"""Trends against a plain reading of the rules, sliced and unsliced."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carefold.operators import series, trends
from carefold.sources import knowledge

SCHEMA = ("patient_id long, code string, entity_id string, document_id string, value double, unit string, "
          "ts timestamp, confidence double, low double, high double, ord int")
AS_OF = datetime(2024, 12, 31)
METRICS = {"2160-0": ("Creatinine", False, 90), "33914-3": ("eGFR", True, 90)}


def make_rows():
    rng = random.Random(11)
    rows, k = [], 0
    for patient in range(60):
        for code in ("2160-0", "33914-3", "other"):
            ts = datetime(2023, 1, 1)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                ts += timedelta(days=rng.choice([0, 1, 30, 100, 200]), hours=rng.randint(0, 5))
                low, high = rng.choice([(None, None), (4.0, None), (None, 6.0), (4.0, 6.0)])
                value = rng.choice([0.0, 5.0, 5.2, 3.0, 7.0, rng.uniform(0, 10)])
                rows.append((patient, code, f"e{k:05d}", "d", value, "u", ts, rng.random(), low, high, rng.randint(0, 1)))
                k += 1
    return rows


def outside(value, low, high):
    return (low is not None and value < low) or (high is not None and value > high)


def expected(points):
    points = sorted(points, key=lambda p: (p[6], p[10], p[2]))
    code = points[0][1]
    name, good_up, interval = METRICS.get(code, (code, None, 180))
    v = [p[4] for p in points]
    days = lambda a, b: (b - a).total_seconds() / 86400.0
    if len(v) < 2:
        direction = "insufficient_data"
    else:
        moved = (100.0 if v[-1] else 0.0) if v[0] == 0 else abs(v[-1] - v[0]) / abs(v[0]) * 100
        direction = "stable" if moved < 5 else "increasing" if v[-1] > v[0] else "decreasing"
    label = "stable"
    if direction in ("increasing", "decreasing") and good_up is not None:
        label = "improving" if (direction == "increasing") == good_up else "worsening"
    crossings = sum(
        outside(a[4], b[8], b[9]) != outside(b[4], b[8], b[9]) for a, b in zip(points, points[1:])
    )
    persistent = len(points) >= 3 and all(outside(p[4], p[8], p[9]) for p in points[-3:])
    gap = days(points[-1][6], AS_OF) > interval * 1.5 or any(
        days(a[6], b[6]) > interval * 1.5 for a, b in zip(points, points[1:]))
    elapsed = days(points[0][6], points[-1][6])
    return dict(
        metric_name=name, data_point_count=len(points), direction=direction, clinical_trend=label,
        absolute_change=v[-1] - v[-2] if len(v) > 1 else None,
        percentage_change=(v[-1] - v[-2]) / abs(v[-2]) * 100 if len(v) > 1 and v[-2] else None,
        rate_of_change=(v[-1] - v[0]) / elapsed if len(v) > 1 and elapsed > 0 else None,
        crossing_count=crossings, abnormal_persistence=persistent, monitoring_gap_detected=gap,
        is_clinically_significant=bool(persistent or crossings or label == "worsening"),
    )


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_every_series(spark, rows, hot_rows):
    observations = spark.createDataFrame(rows, SCHEMA)
    got = trends.analyse_trends(
        observations, knowledge.builtin_metrics(spark), F.lit(AS_OF), hot_rows).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    assert len(got) == len(groups)
    for r in got:
        for field, value in expected(groups[(r.patient_id, r.code)]).items():
            assert r[field] == (pytest.approx(value) if isinstance(value, float) else value), (r, field)


def test_long_forms_do_not_depend_on_slices(spark, rows):
    observations = spark.createDataFrame(rows, SCHEMA)
    for form in (trends.threshold_crossings, trends.trend_points):
        whole = {tuple(r) for r in form(observations, 1_000_000).collect()}
        assert whole == {tuple(r) for r in form(observations, 2).collect()}
    pages = trends.nested_points(observations, page_rows=2, hot_rows=3).collect()
    assert sum(len(p.data_points) for p in pages) == len(rows)
    assert max(len(p.data_points) for p in pages) == 2


def test_a_hot_series_is_cut(spark):
    start = datetime(2024, 1, 1)
    hot = [(1, "c", f"e{k}", "d", 1.0, "u", start + timedelta(hours=k), 1.0, None, None, 0) for k in range(500)]
    cold = [(2, "c", "x", "d", 1.0, "u", start, 1.0, None, None, 0)]
    cut = series.cut_series(spark.createDataFrame(hot + cold, SCHEMA), ["patient_id", "code"], ["ts", "ord", "entity_id"], 50)
    sizes = {(r.patient_id, r.slice): r["count"] for r in cut.groupBy("patient_id", "slice").count().collect()}
    assert max(sizes.values()) <= 50 and len(sizes) >= 11 and sizes[(2, 0)] == 1


def test_points_of_one_time_are_cut_too(spark):
    start, draw = datetime(2024, 1, 1), random.Random(2)
    rows = [(1, "718-7", f"e{k:03}", "d", draw.uniform(0, 20), "u", start, 1.0, 5.0, 12.0, k % 2) for k in range(400)]
    points = spark.createDataFrame(rows, SCHEMA)
    cut = series.cut_series(points, ["patient_id", "code"], ["ts", "ord", "entity_id"], 40)
    parts = cut.groupBy("slice").agg(F.min(F.struct("ord", "entity_id")).alias("a"), F.max(F.struct("ord", "entity_id")).alias("b"), F.count("*").alias("n"))
    found = sorted(parts.collect(), key=lambda r: r["slice"])
    assert len(found) > 8 and max(r.n for r in found) <= 60
    assert all(x.b < y.a for x, y in zip(found, found[1:]))
    as_of, metrics = F.lit("2024-05-01").cast("timestamp"), knowledge.builtin_metrics(spark)
    whole, sliced = (trends.analyse_trends(points, metrics, as_of, n).collect() for n in (1_000_000, 40))
    assert [r.asDict() for r in whole] == [r.asDict() for r in sliced] and whole[0].crossing_count > 50
    for form in (trends.threshold_crossings, trends.trend_points):
        assert {tuple(r) for r in form(points, 1_000_000).collect()} == {tuple(r) for r in form(points, 40).collect()}


def test_undated_points(spark):
    e = spark.createDataFrame(
        [("d", 1, "t1", "5.5 mg", None), ("d", 1, "t2", "none", None), ("d", 1, "t3", "7", "2024-01-01 00:00:00")],
        "document_id string, patient_id long, temp_id string, raw_value string, dt string",
    ).withColumn("entity_date", F.col("dt").cast("timestamp"))
    coded = spark.createDataFrame(
        [("d", t, "c", None, "u", 0.9, None, None) for t in ("t1", "t2", "t3")],
        "document_id string, temp_id string, canonical_code string, normalized_value string, unit_canonical string, "
        "coding_confidence double, reference_range_low double, reference_range_high double")
    as_of = F.lit("2024-05-01").cast("timestamp")
    assert {r.value for r in trends.build_points(e, coded, as_of).collect()} == {5.5, 7.0}
    assert {r.value for r in trends.build_points(e, coded, as_of, undated="skip").collect()} == {7.0}
