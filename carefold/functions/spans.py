"""Character-span expressions: match offsets, overlap resolution and splicing.

All of it is row-local: a span's text never leaves its row, so masking and
extraction need no shuffle. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_TYPE = "array<struct<start:int,end:int,value:string>>"
# Items per block where an array is worked on in two levels.
BLOCK = 256
# Stands for a match while a text is split; a text that holds it is split by the pattern itself.
MARK = "\u0001"


def empty_array(ddl: str) -> Column:
    return F.array().cast(ddl)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """``items`` cut into arrays of ``BLOCK``; none for an empty array."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _scan(items: Column, begin: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``add`` over a short array of ints, the first one ``begin`` with the first item."""
    start = F.struct(begin.cast("int").alias("total"), empty_array("array<int>").alias("list"))

    def step(acc: Column, item: Column) -> Column:
        total = add(acc["total"], item)
        return F.struct(total.alias("total"), F.concat(acc["list"], F.array(total)).alias("list"))

    return F.aggregate(items, start, step, lambda acc: acc["list"])


def running(values: Column, begin: int, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array of ints.

    The lists that grow hold ints and at most ``BLOCK`` of them, or one per block, so the work stays about linear in the
    number of values.
    """

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(begin).cast("int"), add))
        before = F.concat(F.array(F.lit(begin).cast("int")), _scan(totals, F.lit(begin), add))
        return F.flatten(F.filter(
            F.zip_with(blocks, before, lambda block, first: F.when(block.isNotNull(), _scan(block, first, add))),
            lambda part: part.isNotNull(),
        ))

    return bound(values, lambda v: bound(_blocks(v), whole))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def split_at(text: Column, pattern: str) -> Column:
    """The texts around the matches of ``pattern``, as ``split`` with all empty ones; a match must not be empty.

    ``split`` compiles its pattern anew for every row, ``regexp_replace`` once.
    """
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(marked)


def cut(text: Column, pattern: str) -> Column:
    """The gaps around the matches of ``pattern`` and the matches, or null without a match.

    Two regex passes where there is a match, one where there is none.
    """
    return F.when(
        text.rlike(pattern),
        F.struct(
            split_at(text, pattern).alias("gaps"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        ),
    )


def placed(pieces: Column) -> Column:
    """Structs of every gap of a ``cut``, the match after it (null after the last), and where the match ends."""

    def ends(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        return F.zip_with(
            p, running(lengths, 0, _add),
            lambda x, end: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), end.alias("end")),
        )

    return bound(
        F.zip_with(pieces["gaps"], pieces["hits"], lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))), ends)


def matches_of(pieces: Column) -> Column:
    """The matches of a ``cut`` with their offsets; null for a null."""
    return F.transform(
        F.filter(placed(pieces), lambda x: x["hit"].isNotNull()),
        lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("value")),
    )


def find_matches(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` with its offsets, left to right.

    Running sums of the lengths of matches and gaps give the offsets. A text without a match costs one pass.
    """
    return F.coalesce(matches_of(cut(text, pattern)), empty_array(MATCH_TYPE))


def pieces_between(text: Column, pattern: str) -> Column:
    """The texts between the matches of ``pattern`` with their offsets.

    The pieces come out of the split as they are, so a long text is not cut
    again piece by piece.
    """

    def piece(x: Column) -> Column:
        end = x["end"] - F.coalesce(F.length(x["hit"]), F.lit(0))
        return F.struct((end - F.length(x["gap"])).alias("start"), end.alias("end"), x["gap"].alias("value"))

    pieces = F.struct(
        split_at(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.transform(placed(pieces), piece)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def drop_claimed(later: Column, claimed: Column) -> Column:
    """The spans of ``later`` that touch none of ``claimed``."""
    return F.filter(later, lambda x: ~F.exists(claimed, lambda c: overlaps(x, c)))


def resolve_overlaps(candidates: Column, item_type: str) -> Column:
    """Greedy choice among overlapping spans, returned by start.

    ``candidates`` is an array of structs that begin with ``start, end`` and
    hold ``priority`` and ``ordinal``. Lower priority wins, then the longer
    span, then the earlier start, then the lower ordinal. Spans are first cut
    into runs that touch one another, so that the pairwise test only ever runs
    within such a run and stays linear in the length of the text.
    """
    list_type = f"array<{item_type}>"

    def runs_of(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda x: x["end"].cast("int")), -1, _larger)
        # a run begins where no earlier span reaches; the size closes the last run
        begins = bound(reach, lambda r: F.filter(
            F.transform(ordered, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(r, i - 1)), i)), lambda i: i.isNotNull()))
        return bound(
            F.concat(begins, F.array(F.size(ordered))),
            lambda edges: F.transform(
                F.slice(edges, 1, F.size(edges) - 1),
                lambda first, k: F.slice(ordered, first + 1, F.get(edges, k + 1) - first)),
        )

    runs = bound(F.array_sort(candidates), runs_of)

    def pick(run: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                run,
                lambda c: F.struct(
                    c["priority"].alias("p"),
                    (c["start"] - c["end"]).alias("neg_len"),
                    c["start"].alias("s"),
                    c["ordinal"].alias("o"),
                    c.alias("item"),
                ),
            )
        )
        kept = F.aggregate(
            ranked,
            empty_array(list_type),
            lambda acc, c: F.when(
                F.exists(acc, lambda a: overlaps(a, c["item"])), acc
            ).otherwise(F.concat(acc, F.array(c["item"]))),
        )
        return F.array_sort(kept)

    return F.flatten(
        F.transform(runs, lambda run: F.when(F.size(run) > 1, pick(run)).otherwise(run))
    )


def splice(text: Column, matches: Column, replacement: str) -> Column:
    """Replace each (sorted, disjoint) match by its field ``replacement``.

    A substring is counted off from the begin of its text, so the text is cut once per block of matches and the pieces
    are taken from that part.
    """

    def block(ms: Column, first: Column) -> Column:
        size = F.least(F.lit(BLOCK), F.size(ms) - first)
        begin = F.when(first == 0, F.lit(0)).otherwise(F.get(ms, first - 1)["end"])
        end = F.get(ms, first + size - 1)["end"]
        part = F.struct(
            F.substring(text, begin + 1, end - begin).alias("text"), begin.alias("begin"),
            F.slice(ms, first + 1, size).alias("matches"),
        )

        def piece(p: Column, m: Column, k: Column) -> Column:
            before = F.when(k == 0, p["begin"]).otherwise(F.get(p["matches"], k - 1)["end"])
            return F.concat(F.substring(p["text"], before - p["begin"] + 1, m["start"] - before), m[replacement])

        return bound(part, lambda p: F.array_join(F.transform(p["matches"], lambda m, k: piece(p, m, k)), ""))

    def whole(ms: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.size(ms) - 1, F.lit(BLOCK))
        tail = F.substring(text, F.try_element_at(ms, F.lit(-1))["end"] + 1, F.length(text))
        return F.when(
            F.size(ms) > 0, F.concat(F.array_join(F.transform(firsts, lambda first: block(ms, first)), ""), tail)
        ).otherwise(text)

    return F.when(matches.isNull(), text).otherwise(bound(matches, whole))


def explode_found(df: DataFrame, keep: list[str], found: Column, name: str) -> DataFrame:
    """One row per array element, as ``explode``.

    A plain ``explode`` makes the optimizer filter by the array's size first,
    which computes an expensive array twice. Here the filter follows the
    explode and stays there.
    """
    rows = df.select(*keep, F.explode_outer(found).alias(name))
    return rows.filter(F.col(name).isNotNull())
