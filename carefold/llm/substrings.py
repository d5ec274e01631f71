"""Removal of passages that an earlier document holds already, by hashes of normalised units.

A unit is a sentence of a line: it ends at a line break, or at ``.``, ``!`` or ``?`` before white space. It is normalised to
its words (letters and digits, ASCII letters in lower case) and digested to 128 bits. All digests of the table are grouped;
the occurrence of the smallest (doc_id, row, unit number) stays. Consecutive units of a document that are all repeats form
a passage; passages of at least ``LEAST_WORDS`` words are removed. Offsets are code points of the original text.

``repeated_lines`` has whole lines by the same digests, of ``LEAST_LINE_WORDS`` words or more: each but the first goes, however
short. ``all_repeats`` has both, joined where they overlap, and the pipeline cuts those; its sentences also end where marks or
symbols stand between the stop and the white space, and its runs have ``LEAST_RUN_WORDS`` words. What goes has its words in a place
before it, and the first such place stays.

Null texts count as empty and hold no unit. A null doc_id ranks after all others. Rows with the same doc_id are told apart by
a hash of their text; rows alike in both are one document and are treated alike. Repeats within a document count too. An
empty table gives an empty result; other columns are ignored, or kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carefold.llm import common
from carefold.llm.words import ALNUM, LOWER, Words, digest_groups, digest_spans

LEAST_WORDS, LEAST_LINE_WORDS, LEAST_RUN_WORDS = 25, 3, 8
_STOPS = np.isin(np.arange(256), list(b".!?"))
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_UNITS = "doc_id long, `row` int, unit int, begin int, end int, n_words int, h1 long, h2 long"


def row_tags(words: Words) -> np.ndarray:
    """32 bits of a hash of each whole text."""
    return (digest_spans(words.bytes, words.offsets[:-1], words.offsets[1:], 99) >> np.uint64(33)).astype(np.int32)


def units_of(texts: pa.Array, lines: bool = False, marks: bool = False) -> dict[str, np.ndarray]:
    """All units, or whole lines, with a word: row of the slice, number, code point offsets, words, digest.

    With ``marks`` a unit also ends at white space after a stop and ASCII marks.
    """
    words = Words(texts, ALNUM)
    data = words.bytes
    if not len(words):
        return {k: np.zeros(0, np.int64) for k in ("at", "unit", "begin", "end", "n_words", "h1", "h2")}
    stop = data == 10
    if not lines:
        ends = _STOPS[data]
        if marks:
            place = np.arange(len(data))
            other = np.maximum.accumulate(np.where(ALNUM[data] | _WHITE[data], place, -1))
            ends = np.maximum.accumulate(np.where(ends, place, -1)) > other
        stop[:-1] |= ends[:-1] & _WHITE[data[1:]]
    stops = np.flatnonzero(stop)
    unit = np.searchsorted(stops, words.starts)
    new = np.flatnonzero(np.diff(unit, prepend=-1))
    after = np.append(new[1:], len(words))
    lowered = LOWER[data]
    h1, h2 = (digest_groups(digest_spans(lowered, words.starts, words.ends, salt), new, after, salt).view(np.int64) for salt in (1, 2))
    at = words.doc[new]
    first = np.searchsorted(at, np.arange(words.rows))
    # a unit runs from its first word to its stop, a line break not included
    last = stops[unit[new]]
    last = last + (data[last] != 10)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[words.offsets[:-1]][at]
    return {
        "at": at, "unit": np.arange(len(new)) - first[at], "begin": points[words.starts[new]] - base, "end": points[last] - base,
        "n_words": after - new, "h1": h1, "h2": h2,
    }


def units(docs: DataFrame, lines: bool = False, marks: bool = False) -> DataFrame:
    """One row for each unit (or line) of each text; the text does not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = common.text_column(batch)
            found = units_of(texts, lines, marks)
            at = pa.array(found.pop("at"))
            tags = pa.array(row_tags(Words(texts, ALNUM)))
            whole = pa.table({"doc_id": batch.column(0).take(at), "row": tags.take(at)} | {k: pa.array(v if k[0] == "h" else v.astype(np.int32)) for k, v in found.items()})
            yield from whole.to_batches(100_000)

    return common.map_arrow(common.plain(docs, "doc_id", "text"), run, _UNITS)


def repeats(found: DataFrame, name: str) -> DataFrame:
    """The stored units that are not the first of their digest, each once, and first_doc_id, where that one stays.

    Grouping combines on the map side, so a unit of a third of all rows is one row per task; in the join back such a unit
    is on the large side of a join that adaptive execution splits.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "unit")
    # stored, so that the join below has a shuffle of its own on both sides, which adaptive execution can split
    firsts = common.store(
        found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("h1", "h2", "first"), name)
    # the rows of one document may be alike: each unit once
    return (
        found.join(firsts, ["h1", "h2"]).filter(rank != F.col("first"))
        .select("doc_id", "row", "unit", "begin", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"))
        .dropDuplicates(["doc_id", "row", "unit"])
    )


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, marks: bool = False) -> DataFrame:
    """doc_id, row, begin, end and n_words of every removed passage, and first_doc_id, where its first unit stays.

    Only repeated units go on to the windows, one document each.
    """
    order = Window.partitionBy("doc_id", "row").orderBy("unit")
    chained = repeats(common.store(units(docs, marks=marks), "units", "zstd"), "repeated-units").withColumn("run", F.col("unit") - F.row_number().over(order))
    return (
        chained.groupBy("doc_id", "row", "run")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.min_by("first_doc_id", "unit").alias("first_doc_id"))
        .filter(F.col("n_words") >= least_words).drop("run")
    )


def repeated_lines(docs: DataFrame, least_words: int = LEAST_LINE_WORDS) -> DataFrame:
    """doc_id, row, begin and end of every whole line that an earlier place holds already."""
    lines = common.store(units(docs, lines=True).filter(F.col("n_words") >= least_words), "lines", "zstd")
    return repeats(lines, "repeated-lines").select("doc_id", "row", "begin", "end")


def all_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row, begin and end of what repeated passages and repeated lines cover together, without overlaps."""
    both = repeated_passages(docs, LEAST_RUN_WORDS, marks=True).select("doc_id", "row", "begin", "end").unionByName(repeated_lines(docs))
    order = Window.partitionBy("doc_id", "row").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce((F.col("begin") > reached).cast("int"), F.lit(1))
    grouped = both.withColumn("opened", opened).withColumn("part", F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "row", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def tagged(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and the tag of the row's text, under a name of its own."""
    place = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, docs_text):
            tags = row_tags(Words(common.text_column(batch, docs_text), ALNUM))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags)], [*batch.schema.names, name])

    docs_text = docs.columns[place]
    return common.map_arrow(docs, run, schema)


def remove(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages cut out of ``text``, every column and row kept; ``n_chars``, if present, follows a cut text."""
    cut_doc, cut_row, cuts, row_tag = common.fresh(docs, "_cut_doc", "_cut_row", "_cuts", "_row_tag")
    listed = passages.groupBy(F.col("doc_id").alias(cut_doc), F.col("row").alias(cut_row)).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(cuts))
    names = docs.columns
    joined = tagged(docs, row_tag).join(
        listed, F.col("doc_id").eqNullSafe(F.col(cut_doc)) & (F.col(row_tag) == F.col(cut_row)), "left").select(*[F.col(f"`{n}`") for n in names], cuts)
    # the kept stretches lie between the end of one passage and the begin of the next
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["begin"]), F.array(F.char_length("text")))
    kept = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda s: F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"]))
    whole = F.col(cuts).isNull()
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(kept, "")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(cuts)
