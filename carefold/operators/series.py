"""Per-key ordered series that stay balanced when one key is huge.

A window over ``(key) ORDER BY ts`` puts a key into one task. Here a series
with more than ``hot_rows`` rows is cut into consecutive slices of its whole
order; the window runs per slice, and slices are stitched through their first
and last rows, of which there is one set per slice. Other series have a single
slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from carefold import settings

#: Sampled rows per slice: the more, the more even the slices.
SAMPLES = 8
#: Cut points are searched in groups of so many.
GROUP = 64


def cut_series(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = settings.HOT_GROUP_ROWS) -> DataFrame:
    """Adds ``slice``, increasing with ``order`` within a key.

    Cut points of a hot series are quantiles of its own rows by all of ``order``, so rows of one time are cut by what comes
    after the time. They come from a sample by a hash of the order, about ``2 * SAMPLES`` rows in ``hot_rows``. The counting
    and the sampling pass read keys and order only. At most ``rows / hot_rows`` keys are hot, and they have two cut points in
    ``hot_rows`` rows on average, so the list of cut points is broadcast. Rows that are equal in ``order`` share a slice.
    """
    place = F.struct(*order)
    every = max(1, hot_rows // (2 * SAMPLES))
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    sampled = (
        df.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        .groupBy(*keys).agg(F.array_sort(F.collect_set(place)).alias("_points"))
    )
    cuts = F.filter("_points", lambda p, i: i % SAMPLES == SAMPLES - 1)
    found = hot.join(sampled, keys).select(*keys, cuts.alias("_cuts")).filter(F.size("_cuts") > 0)
    grouped = found.select(
        *keys, F.transform(F.sequence(F.lit(1), F.size("_cuts"), F.lit(GROUP)), lambda k: F.slice("_cuts", k, F.lit(GROUP))).alias("_groups")
    )
    return (
        df.join(F.broadcast(grouped), keys, "left")
        .withColumn("slice", F.coalesce(_cuts_up_to(F.col("_groups"), place), F.lit(0)))
        .drop("_groups")
    )


def _cuts_up_to(groups: Column, place: Column) -> Column:
    """How many cut points are not above ``place``: first by the heads of their groups, then within one group."""
    before = F.size(F.filter(groups, lambda g: g[0] <= place))
    last = F.try_element_at(groups, before)
    return F.when(groups.isNull() | (before == 0), 0).otherwise((before - 1) * GROUP + F.size(F.filter(last, lambda c: c <= place)))


def slice_window(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "slice").orderBy(*order)


def between_slices(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("slice")


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    hot_rows: int = settings.HOT_GROUP_ROWS,
    name: str = "seq",
) -> DataFrame:
    """Position of every row in its series, from 1."""
    sliced = cut_series(df, keys, order, hot_rows)
    counts = sliced.groupBy(*keys, "slice").agg(F.count("*").alias("_c"))
    before = between_slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *keys, "slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base")
    )
    return (
        sliced.withColumn("_rn", F.row_number().over(slice_window(keys, order)))
        .join(bases, [*keys, "slice"])
        .withColumn(name, (F.col("_base") + F.col("_rn")).cast("long"))
        .drop("_base", "_rn", "slice")
    )


def paged_nest(
    df: DataFrame, keys: list[str], fields: list[str], seq: str = "seq",
    page_rows: int = settings.PAGE_ROWS, name: str = "items",
) -> DataFrame:
    """Rows nested into arrays of at most ``page_rows``, page after page.

    The nested form of an unbounded series; no page outgrows its bound and no
    row is left out.
    """
    page = F.floor((F.col(seq) - 1) / page_rows).cast("int")
    return (
        df.withColumn("page_no", page)
        .groupBy(*keys, "page_no")
        .agg(F.array_sort(F.collect_list(F.struct(seq, *fields))).alias(name))
    )


