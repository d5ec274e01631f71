"""Merges by key that rewrite only the buckets they touch."""

import re

import pytest
from pyspark.sql import functions as F

from carefold.sources import rank_index, snapshots, tables

SCHEMA = "id long, version int, name string, vector array<double>"


def _rows(spark, ids, version):
    return spark.createDataFrame([(k, version, f"n{k}.{version}", [float(version)]) for k in ids], SCHEMA)


def _content(df):
    return sorted((str(r.id), r.version, r.name) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return snapshots.SnapshotTable.create(spark, str(tmp_path / "t"), _rows(spark, [], 0).schema, ["id"], 16)


def test_only_touched_buckets_are_rewritten(spark, table):
    first = table.upsert(_rows(spark, range(200), 1))
    assert len(first.folders) == 16
    second = table.upsert(_rows(spark, [3, 500], 2))
    changed = {b for b in second.folders if second.folders[b] != first.folders[b]}
    assert 1 <= len(changed) <= 2
    third = table.delete(spark.createDataFrame([(7,), (9_999,)], "id long"))
    assert len({b for b in third.folders if third.folders[b] != second.folders.get(b)}) <= 2
    assert table.read().count() == 200 and table.read(1).count() == 200 and table.read(2).count() == 201
    assert _content(table.read_key(3)) == [("3", 2, "n3.2")] and table.read_key(7).count() == 0
    plan = table.read_key(3)._jdf.queryExecution().toString()
    assert plan.count("_bucket=") == 1 or "1 paths" in plan


def test_the_same_rows_in_other_merges_give_the_same_table(spark, tmp_path):
    versions = [_rows(spark, range(60), 1), _rows(spark, range(0, 60, 3), 2), _rows(spark, range(0, 60, 7), 3)]
    found = []
    for k, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 2, 0])):
        t = snapshots.SnapshotTable.create(spark, str(tmp_path / f"o{k}"), versions[0].schema, ["id"], 4)
        for n in order:
            t.upsert(versions[n], order="version")
        found.append(_content(t.read()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_a_mark_makes_a_batch_count_once(spark, table):
    table.upsert(_rows(spark, range(10), 1), mark=("s", 0))
    version = max(table.versions())
    table.upsert(_rows(spark, range(10), 2), mark=("s", 0))
    assert max(table.versions()) == version and {r.version for r in table.read().collect()} == {1}
    table.upsert(_rows(spark, range(10), 3), mark=("s", 1))
    assert {r.version for r in table.read().collect()} == {3}


def test_null_keys_ties_and_empty_batches(spark, table):
    rows = spark.createDataFrame([(None, 1, "a", None), (None, 1, "b", None), (1, 1, "x", None), (1, 1, "y", None)], SCHEMA)
    table.upsert(rows)
    assert _content(table.read()) == [("1", 1, "y"), ("None", 1, "b")]
    table.upsert(_rows(spark, [], 1))
    table.delete(spark.createDataFrame([(None,)], "id long"))
    assert _content(table.read()) == [("1", 1, "y")]
    table.delete(spark.createDataFrame([(1,)], "id long"))
    assert table.read().count() == 0 and table.manifest().folders == {}


def test_of_two_merges_at_once_one_fails(spark, table):
    stale = table.manifest()
    table.upsert(_rows(spark, [1], 1))
    with pytest.raises(snapshots.ConcurrentMerge):
        table._commit(snapshots.Manifest(stale.version + 1, stale.schema, stale.keys, stale.buckets))
    assert table.read().count() == 1


def test_a_patient_is_read_from_one_bucket(spark, tmp_path):
    vectors = spark.range(300).select(
        F.col("id").alias("passage_id"), F.concat(F.lit("p"), F.col("id") % 7).alias("patient_id"), F.array(F.col("id").cast("double")).alias("embedding")
    )
    path = str(tmp_path / "v")
    tables.write_patient_vectors(vectors, path, buckets=8, shards=2)
    one = tables.read_patient_vectors(spark, path, "p3", buckets=8)
    assert {r.passage_id for r in one.collect()} == {k for k in range(300) if k % 7 == 3}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(patient_bucket" in plan
    scanned = {r[0] for r in one.select(F.col("_metadata.file_path")).distinct().collect()}
    assert len({p.split("patient_bucket=")[1].split("/")[0] for p in scanned}) == 1


def test_a_page_is_read_from_the_ranges_it_lies_in(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("group"), F.lit("x").alias("rank"))
    order = [F.col("group").desc_nulls_last(), F.col("id")]
    index = rank_index.RankIndex.build(df.drop("rank"), str(tmp_path / "i"), order, range_rows=100)
    want = [r.id for r in df.orderBy(*order).collect()]
    for number in (1, 2, 37, 40, 41):
        page = index.page(number, 25)
        rows = sorted(page.collect(), key=lambda r: r.rank)
        assert [r.id for r in rows] == want[(number - 1) * 25 : number * 25]
        assert all((r.total, r.pages, r.page) == (1000, 40, number) for r in rows)
    plan = index.page(37, 25)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(_range#\d+\), \(_range#\d+ = 9\)\]", plan)
    empty = rank_index.RankIndex.build(df.limit(0).drop("rank"), str(tmp_path / "e"), order)
    assert empty.page(1, 25).collect() == []


def test_a_large_table_has_few_ranges_however_small_they_were_asked_for(spark, tmp_path):
    df = spark.range(2000).select("id")
    index = rank_index.RankIndex.build(df, str(tmp_path / "i"), [F.col("id").desc()], range_rows=2)
    folders = [p for p in (tmp_path / "i" / "rows").iterdir() if p.name.startswith("_range=")]
    assert 200 <= len(folders) <= rank_index.MANY_RANGES
    assert [r.id for r in sorted(index.page(79, 25).collect(), key=lambda r: r.rank)] == list(range(49, 24, -1))
