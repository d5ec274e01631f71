"""Text assembly: line rebuilding, recogniser blocks, full text and span offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.text import exact_round

BLOCK_SPANS = 4096


def rebuild_lines(words: DataFrame, min_words: int = 10) -> DataFrame:
    """Page text from word boxes ``(document_id, page, word_pos, x0, y0, x1, y1, text)``.

    Words share a line when their vertical centre rounds (half to even) to the
    same multiple of five; lines are read top to bottom, words left to right.
    Pages with no more than ``min_words`` words are left to recognition.

    Words are dealt out by page once, as one list per column: lists of plain values shuffle in little more than the text.
    Nulls, which lists leave out, are filled and marked in ``blank``. Lines are cut where the bucket changes in the sorted
    words of a page. A word without a text adds nothing to its line; ``line_count`` counts lines, as words may hold line
    breaks of their own.
    """
    fields = {
        "bucket": F.bround((F.col("y0") + F.col("y1")) / 2 / 5) * 5,
        "x": (F.col("x0") + F.col("x1")) / 2,
        "word_pos": F.col("word_pos"),
        "text": F.col("text"),
    }
    marks = [F.when(F.col(f).isNull(), 1 << k).otherwise(0) for k, f in enumerate(fields)]
    placed = words.select("document_id", "page", *[c.alias(f) for f, c in fields.items()])
    filled = [
        F.coalesce(f.name, F.lit("" if f.name == "text" else "0").cast(f.dataType)).alias(f.name) for f in placed.schema if f.name in fields
    ]
    pages = (
        placed.select("document_id", "page", *filled, sum(marks, F.lit(0)).cast("byte").alias("blank"))
        .groupBy("document_id", "page").agg(*[F.collect_list(f).alias(f) for f in (*fields, "blank")])
        .filter(F.size("blank") > min_words)
    )

    def present(w: Column, name: str) -> Column:
        return F.when(w["blank"].bitwiseAND(F.lit(1 << list(fields).index(name)).cast("byte")) == 0, w[name])

    ordered = F.array_sort(F.transform(F.arrays_zip(*fields, "blank"), lambda w: F.struct(
        present(w, "bucket").alias("bucket"), present(w, "text").isNull().alias("silent"),
        present(w, "x").alias("x"), present(w, "word_pos").alias("word_pos"), w["text"].alias("text"),
    )))

    def starts(w: Column, k: Column) -> Column:
        return (k == 0) | ~w["bucket"].eqNullSafe(F.get("words", k - 1)["bucket"])

    parts = F.transform("words", lambda w, k: F.concat(
        F.when(k == 0, "").when(starts(w, k), "\n").when(w["silent"], "").otherwise(" "), w["text"]
    ))
    return pages.select("document_id", "page", ordered.alias("words")).select(
        "document_id", "page",
        F.array_join(parts, "").alias("text"),
        F.size(F.filter("words", starts)).cast("long").alias("line_count"),
        F.lit(1.0).alias("confidence"),
        F.lit("text").alias("span_type"),
    )


def polygon_box(polygon: Column, page: Column) -> Column:
    """Bounding box of an array of ``[x, y]`` points."""
    xs = F.transform(polygon, lambda p: p[0])
    ys = F.transform(polygon, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("x"), F.array_min(ys).alias("y"),
        (F.array_max(xs) - F.array_min(xs)).alias("width"),
        (F.array_max(ys) - F.array_min(ys)).alias("height"),
        page.alias("page"),
    )


def recogniser_spans(blocks: DataFrame) -> DataFrame:
    """Spans from ``(document_id, page, texts, scores, polygons)`` blocks.

    The three arrays are read in step up to the shortest; blank texts are dropped.
    """
    shortest = F.least(F.size("texts"), F.size("scores"), F.size("polygons"))
    zipped = F.slice(
        F.arrays_zip("texts", "scores", "polygons"), F.lit(1), F.greatest(shortest, F.lit(0))
    )
    return (
        blocks.select("document_id", "page", F.posexplode(zipped).alias("span_pos", "s"))
        .filter(F.col("s.texts").rlike(r"\S"))
        .select(
            "document_id", "page", "span_pos", F.col("s.texts").alias("text"),
            F.col("s.scores").cast("double").alias("confidence"),
            polygon_box(F.col("s.polygons"), F.col("page")).alias("bounding_box"),
            F.lit("text").alias("span_type"),
        )
    )


def full_text(spans: DataFrame, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """Spans of each document joined by newlines.

    Blocks of spans are joined first and then the few blocks of a document,
    whose text the intake limit bounds.
    """
    def joined(order: str, text: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.struct(order, text)))[text], "\n")

    blocks = (
        spans.withColumn("block", F.floor(F.col("span_pos") / block_spans))
        .groupBy("document_id", "block")
        .agg(joined("span_pos", "text").alias("block_text"))
    )
    return blocks.groupBy("document_id").agg(joined("block", "block_text").alias("full_text"))


def span_offsets(spans: DataFrame, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """Each span's ``[start, end)`` in the full text, without building that text.

    A running sum within blocks of ``block_spans`` spans plus the running sum
    of the block totals, so that one huge document spreads over many tasks.
    Only lengths enter the sums: a caller that selects no text shuffles none.
    """
    blocked = spans.withColumn("_len", F.length("text")).withColumn(
        "_block", F.floor(F.col("span_pos") / block_spans)
    )
    width = F.col("_len") + 1
    before_block = Window.partitionBy("document_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        blocked.groupBy("document_id", "_block")
        .agg(F.sum(width).alias("_width"))
        .select(
            "document_id", "_block",
            F.coalesce(F.sum("_width").over(before_block), F.lit(0)).alias("_base"),
        )
    )
    before_span = Window.partitionBy("document_id", "_block").orderBy("span_pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        blocked.withColumn("_inner", F.coalesce(F.sum(width).over(before_span), F.lit(0)))
        .join(bases, ["document_id", "_block"])
        .withColumn("start", (F.col("_base") + F.col("_inner")).cast("int"))
        .withColumn("end", F.col("start") + F.col("_len"))
        .drop("_block", "_inner", "_base", "_len")
    )


def mean_confidence(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean span confidence per document, 0.0 where there is no span."""
    means = spans.groupBy("document_id").agg(
        F.avg("confidence").alias("m"), F.count("*").alias("span_count")
    )
    return documents.select("document_id").join(means, "document_id", "left").select(
        "document_id",
        exact_round(F.coalesce("m", F.lit(0.0)), 4).alias("avg_confidence"),
        F.coalesce("span_count", F.lit(0)).alias("span_count"),
    )


def low_confidence_spans(
    spans: DataFrame, threshold: float = settings.OCR_CONFIDENCE_THRESHOLD
) -> DataFrame:
    return spans.filter(F.col("confidence") < threshold)
