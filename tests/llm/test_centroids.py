"""Centroid clustering against a plain version that measures every distance."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import centroids


def by_hand(rows, clusters=40, rounds=5):
    kept = [(k, tuple(int(np.floor(256 * float(x))) for x in v)) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in kept)
    centres = [list(v) for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for n, members in groups.items():
            centres[n] = [sum(column) // len(members) for column in zip(*members)]
    found = [(k, *nearest(v)) for k, v in kept]
    inertia = defaultdict(int)
    for _, distance, n in found:
        inertia[n] += distance
    return sorted(
        (str(k), n, distance, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for k, distance, n in found
    )


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 20), st.sampled_from([1, 3, 1000, 1 << 27]), st.integers(1, 9))
def test_bounds_never_rule_out_a_nearest_centroid(seed, dimensions, count, reach, pivots):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-reach, reach + 1, (60, dimensions))
    simplex = centroids.Simplex(draw.integers(-reach, reach + 1, (10, dimensions)), pivots)
    centres = np.concatenate([vectors[:count], vectors[:1], draw.integers(-reach, reach + 1, (count, dimensions))])
    exact = centroids.squared(vectors, centres)
    low, high = simplex.bounds(simplex.apexes(vectors), simplex.apexes(centres))
    assert (low <= exact).all() and (high >= exact).all()
    number, distance, _ = centroids.nearest(vectors, simplex.apexes(vectors), centres, simplex)
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_bounds_rule_out_most_centroids_of_grouped_vectors():
    draw = np.random.default_rng(4)
    centres = draw.integers(-200, 200, (40, 64))
    vectors = centres[draw.integers(0, 40, 2000)] + draw.integers(-20, 20, (2000, 64))
    simplex = centroids.Simplex(centres, 12)
    _, _, measured = centroids.nearest(vectors, simplex.apexes(vectors), centres, simplex)
    assert measured < 5 * len(vectors)


def test_equal_points_span_nothing():
    same = np.full((5, 4), 7)
    simplex = centroids.Simplex(same)
    assert len(simplex.pivots) == 1
    number, distance, _ = centroids.nearest(same, simplex.apexes(same), same, simplex)
    assert number.tolist() == [0] * 5 and distance.tolist() == [0] * 5


def test_rows_against_the_plain_version(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in draw.normal(size=64) / 8]) for i in range(300)]
    rows += [(int(i), rows[7][1]) for i in range(1000, 1100)] + [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1])]
    odd = [
        (1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.5] * 63 + [None]), (6, [float("nan")] + [0.5] * 63), (7, [float("-inf")] + [0.5] * 63),
    ]
    df = spark.createDataFrame(
        [(k, v, "clash", 1) for k, v in rows + odd], "vec_id long, embedding array<double>, v string, cluster int"
    ).repartition(5)
    assert result(centroids.classify(df)) == by_hand(rows)
    few = df.filter("vec_id IN (10, 11, 12)")
    assert result(centroids.classify(few)) == by_hand([r for r in rows if r[0] in (10, 11, 12)])
    assert centroids.classify(df.limit(0)).collect() == []


def test_floats_are_widened_before_the_floor(spark):
    rows = [(i, [float(np.float32(0.1 * i + 0.01 * k)) for k in range(64)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(centroids.classify(df)) == by_hand(rows)


def test_components_beyond_the_exact_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e300] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2\\^27"):
        centroids.classify(df).collect()
