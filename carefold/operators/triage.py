"""Intake triage: size, type, quality score, routing and rejection reasons.

All rules are column expressions over measured signals, so a whole intake is
triaged in one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold import settings
from carefold.functions.text import exact_round, fixed_point, literal_map

# ---------------------------------------------------------------------------
# Accepted types, their leading bytes, name hints.
# ---------------------------------------------------------------------------
ACCEPTED_TYPES = (
    "application/pdf", "image/jpeg", "image/png", "image/tiff", "image/bmp", "image/webp",
)
LEADING_BYTES = (
    ("application/pdf", "^25504446"),
    ("image/jpeg", "^FFD8FF"),
    ("image/png", "^89504E470D0A1A0A"),
    ("image/tiff", "^(?:49492A00|4D4D002A)"),
    ("image/bmp", "^424D"),
    ("image/webp", "^52494646.{8}57454250"),
)
HANDWRITING_HINTS = "handwritten|handwriting|note|script|scribble"

REASONS = {
    "unsupported_mime_type": "This kind of file cannot be processed.",
    "corrupt_or_too_small": "The file holds too little data to be a readable document.",
    "file_too_large": f"The file is larger than {settings.MAX_FILE_SIZE_BYTES // (1024 * 1024)} MB.",
    "undecodable_image": "The image could not be read.",
    "corrupt_pdf": "The PDF could not be read.",
    "encrypted_undecryptable": "The PDF needs a password.",
    "unrenderable_pdf": "The PDF pages could not be drawn for checking.",
    "empty_pdf": "The PDF has no pages.",
    "low_resolution": "The picture is too small to read reliably.",
    "blurry": "The picture is out of focus.",
    "too_dark": "The picture is too dark.",
    "overexposed": "The picture is too bright.",
    "skewed": "The page is turned.",
}


def size_flag(length: Column) -> Column:
    return F.when(length < settings.MIN_FILE_SIZE_BYTES, "corrupt_or_too_small").when(
        length > settings.MAX_FILE_SIZE_BYTES, "file_too_large"
    )


def mime_type(content: Column) -> Column:
    """Type by leading bytes; only the first twelve are looked at."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.lit("application/octet-stream")
    for mime, pattern in reversed(LEADING_BYTES):
        kind = F.when(head.rlike(pattern), mime).otherwise(kind)
    return kind


def text_layer(pages: DataFrame, first: int = 3) -> DataFrame:
    """Mean trimmed characters over the first pages of each PDF and the typed verdict."""
    return (
        pages.filter(F.col("page") <= first)
        .groupBy("document_id")
        .agg(F.avg(F.length(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")))).alias("mean_chars"))
        .withColumn("is_typed", F.col("mean_chars") >= settings.MIN_TEXT_CHARS_PER_PAGE)
    )


def quality(
    height: Column, width: Column, blur: Column, brightness: Column, skew: Column
) -> Column:
    """Score in 0..1 and the flags that lowered it, in checking order."""
    small = F.least(height, width) < settings.MIN_DIMENSION_PX
    blurred = blur < settings.BLUR_VARIANCE_THRESHOLD
    severity = F.least(
        F.lit(1.0),
        (settings.BLUR_VARIANCE_THRESHOLD - blur) / settings.BLUR_VARIANCE_THRESHOLD,
    )
    dark = brightness < settings.MIN_BRIGHTNESS
    bright = brightness > settings.MAX_BRIGHTNESS
    turned = F.abs(skew) > settings.MAX_SKEW_DEGREES
    score = (
        F.lit(1.0)
        - F.when(small, 0.45).otherwise(0.0)
        - F.when(blurred, 0.4 * severity).otherwise(0.0)
        - F.when(dark, 0.25).when(bright, 0.15).otherwise(0.0)
        - F.when(turned, 0.1).otherwise(0.0)
    )
    flags = F.array_compact(
        F.array(
            F.when(small, "low_resolution"),
            F.when(blurred, "blurry"),
            F.when(dark, "too_dark").when(bright, "overexposed"),
            F.when(turned, "skewed"),
        )
    )
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), flags.alias("flags")
    )


def looks_handwritten(filename: Column, declared_type: Column) -> Column:
    declared = F.coalesce(F.lower(declared_type) == "handwritten", F.lit(False))
    return declared | F.lower(filename).rlike(HANDWRITING_HINTS)


def routing(document_type: Column, score: Column) -> Column:
    return (
        F.when((score < settings.REJECT_QUALITY_THRESHOLD) | (document_type == "unknown"), "reject")
        .when(document_type == "handwritten", "handwriting_ocr")
        .otherwise("ocr")
    )


def rejection_reason(flags: Column, score: Column) -> Column:
    """The sentence of every known flag; the score itself when there is none."""
    sentences = F.array_compact(
        F.transform(flags, lambda f: F.element_at(literal_map(REASONS), f))
    )
    by_score = F.format_string(
        f"The quality score %s is below {settings.REJECT_QUALITY_THRESHOLD}.",
        fixed_point(score, 2),
    )
    return F.when(F.size(sentences) > 0, F.array_join(sentences, " ")).otherwise(by_score)


def page_quality_label(height: Column, width: Column, blur: Column, brightness: Column) -> Column:
    """Per-page label before recognition; the first failing check names it."""
    return (
        F.when(F.least(height, width) < 600, "too_small")
        .when(blur < 100.0, "blurry")
        .when(brightness < 60.0, "too_dark")
        .otherwise("ok")
    )


def _verdict(kind: str, score: float, *flags: str) -> Column:
    names = F.array(*[F.lit(f) for f in flags]) if flags else F.array().cast("array<string>")
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(score).alias("score"), names.alias("flags")
    )


def pdf_verdict(measured: Column, image_kind: Column) -> Column:
    """Failure classes of a PDF in checking order, then typed or scanned."""
    scanned = F.struct(
        image_kind.alias("kind"), measured["score"].alias("score"),
        measured["flags"].alias("flags"),
    )
    status = F.col("pdf_status")
    return (
        F.when(status == "corrupt", _verdict("unknown", 0.0, "corrupt_pdf"))
        .when(status == "encrypted", _verdict("unknown", 0.0, "encrypted_undecryptable"))
        .when(F.col("page_count") == 0, _verdict("unknown", 0.0, "empty_pdf"))
        .when(F.col("mean_chars") >= settings.MIN_TEXT_CHARS_PER_PAGE, _verdict("typed_pdf", 0.98))
        .when(status == "unrenderable", _verdict("unknown", 0.2, "unrenderable_pdf"))
        .otherwise(scanned)
    )


def triage(documents: DataFrame) -> DataFrame:
    """Envelope per document.

    Needs ``document_id, patient_id, filename, storage_path, declared_type,
    content, length, pdf_status, page_count, mean_chars, height, width,
    blur_variance, brightness, skew_degrees``; a null height on an image means
    that it could not be decoded.
    """
    measured = quality(
        F.col("height"), F.col("width"), F.col("blur_variance"),
        F.col("brightness"), F.col("skew_degrees"),
    )
    image_kind = F.when(
        looks_handwritten(F.col("filename"), F.col("declared_type")), "handwritten"
    ).otherwise("scanned_image")
    image = F.when(
        F.col("height").isNull(), _verdict("unknown", 0.0, "undecodable_image")
    ).otherwise(
        F.struct(
            image_kind.alias("kind"), F.col("measured.score").alias("score"),
            F.col("measured.flags").alias("flags"),
        )
    )
    rejected_size = F.struct(
        F.lit("unknown").alias("kind"), F.lit(0.0).alias("score"),
        F.array("size_flag").alias("flags"),
    )
    judged = (
        documents.withColumn("size_flag", size_flag(F.col("length")))
        .withColumn(
            "mime",
            F.when(F.col("size_flag").isNotNull(), "unknown").otherwise(
                mime_type(F.col("content"))
            ),
        )
        .withColumn("measured", measured)
        .withColumn(
            "verdict",
            F.when(F.col("size_flag").isNotNull(), rejected_size)
            .when(
                ~F.col("mime").isin(*ACCEPTED_TYPES),
                _verdict("unknown", 0.0, "unsupported_mime_type"),
            )
            .when(F.col("mime") == "application/pdf", pdf_verdict(F.col("measured"), image_kind))
            .otherwise(image),
        )
    )
    route = routing(F.col("verdict.kind"), F.col("verdict.score"))
    return judged.select(
        "document_id", "patient_id", "storage_path",
        F.col("verdict.kind").alias("document_type"),
        exact_round(F.col("verdict.score"), 4).alias("quality_score"),
        F.col("verdict.flags").alias("quality_flags"),
        route.alias("routing"),
        F.when(
            route == "reject", rejection_reason(F.col("verdict.flags"), F.col("verdict.score"))
        ).alias("rejection_reason"),
        F.map_from_arrays(
            F.array(F.lit("original_filename"), F.lit("detected_mime_type"), F.lit("declared_type")),
            F.array(F.col("filename"), F.col("mime"), F.col("declared_type")),
        ).alias("metadata"),
    )
