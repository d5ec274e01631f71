"""Streams run to their end over a given table, against the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.operators import containment, masking, trends
from carefold.plans.inputs import Inputs
from carefold.plans.registry import query
from carefold.plans.trend_queries import SUMMARY_SQL, summary_columns
from carefold.session import shared_folder, stateful_session
from carefold.sources import knowledge
from carefold.streaming import expiring_tokens, intake, running_trends

PARTS = 5
DAY_SECONDS = 86_400


def _folder(i: Inputs, name: str) -> str:
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def replay(i: Inputs, rows: DataFrame, arrival: Column, again: Column, extra: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``rows`` as a stream of files in ``PARTS`` parts of equal time by ``arrival``, and the seconds of one part.

    Rows for which ``again`` holds come once more with the part after theirs; ``extra`` comes after all. The files of a part are
    written after those of the part before, and a stream takes up files in this order.
    """
    folder = _folder(i, "replay")
    timed = rows.withColumn("_at", F.unix_seconds(arrival))
    low, high = timed.agg(F.min("_at"), F.max("_at")).first()
    width = (0 if low is None else high - low) // PARTS + 1
    part = F.when(F.col("_at").isNull(), 0).otherwise(F.floor((F.col("_at") - F.lit(low or 0)) / width))
    files = max(1, timed.rdd.getNumPartitions())
    for k in range(PARTS + 1):
        now = timed.filter((part == k) | ((part == k - 1) & again)).drop("_at")
        now.write.mode("append").parquet(folder)
    if extra is not None:
        extra.select(*rows.columns).write.mode("append").parquet(folder)
    return i.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), width


def _late(ts: str, number: str) -> Column:
    """The time at which a row arrives: every seventh two days late."""
    return F.col(ts) + F.when(F.col(number).cast("long") % 7 == 0, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))


@query("running_trend_summary", SUMMARY_SQL)
def running_trend_summary(i: Inputs) -> DataFrame:
    """The trends of a stream of observations, late and repeated ones among them, at its end."""
    own = i
    i = Inputs(stateful_session(own.spark), own.folder)
    points, width = replay(i, i.observations(), _late("ts", "entity_id"), F.col("entity_id").cast("long") % 50 == 0)
    updates = _folder(i, "slices")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch_id={batch_id}")

    # a part may be taken up in any order, so a row lags by the part and its own delay at most
    running_trends.slice_updates(points, days=10, lateness=f"{width + 2 * DAY_SECONDS + 1} seconds").writeStream.outputMode("update").foreachBatch(
        save
    ).option("checkpointLocation", _folder(i, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    slices = running_trends.latest_slices(own.spark.read.schema(f"{running_trends.SLICE_ROW}, batch_id long").parquet(updates))
    return summary_columns(trends.finish_trends(trends.stitch_slices(slices), knowledge.builtin_metrics(own.spark), own.as_of()))


TOKEN_TTL = DAY_SECONDS


@query("streamed_token_values", f"""
WITH saved AS (SELECT user_id, ts, max(event_id) AS saved_id FROM events WHERE event_type IN ('signup', 'click') GROUP BY ALL),
asked AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('signup', 'click'))
SELECT event_id, 'u' || asked.user_id AS token,
  CASE WHEN epoch_us(asked.ts) - epoch_us(saved.ts) < {TOKEN_TTL * 1_000_000} THEN 'v' || saved_id END AS value
FROM asked ASOF LEFT JOIN saved ON asked.user_id = saved.user_id AND asked.ts >= saved.ts""")
def streamed_token_values(i: Inputs) -> DataFrame:
    """What each lookup of a token finds at its own time, while saves and lookups arrive late and out of order."""
    own = i
    i = Inputs(stateful_session(own.spark), own.folder)
    rows = i.table("events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("token"), "event_id", "ts",
        F.when(F.col("event_type").isin("signup", "click"), F.concat(F.lit("v"), F.col("event_id"))).alias("value"),
    )
    # the end of the stream: a time so late that every lookup is due
    beat = rows.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(
        F.lit("").alias("token"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("end").alias("value")
    )
    events, width = replay(i, rows, _late("ts", "event_id"), F.lit(False), beat)
    out = _folder(i, "token-values")
    answers = expiring_tokens.values_as_of(events, f"{width + 2 * DAY_SECONDS + 1} seconds", TOKEN_TTL)
    answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(i, "checkpoint")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return own.spark.read.schema(answers.schema).parquet(out)


def _lengths(rows):
    """Raises on some texts, as an extractor does that meets what it does not know."""
    if (rows["document_id"].astype("int64") % 29 == 3).any():
        raise ValueError("odd layout")
    return rows.assign(value=rows["text"].fillna("").str.len())


def _digits(rows):
    if (rows["document_id"].astype("int64") % 31 == 4).any():
        raise KeyError("unknown code")
    return rows.assign(value=rows["text"].fillna("").str.count("[0-9]"))


def _lines(rows):
    return rows.assign(value=rows["text"].fillna("").str.count("\n") + 1)


@query("contained_extractors", """
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS text FROM documents)
SELECT document_id, 'lengths' AS extractor, CASE WHEN doc_id % 29 <> 3 THEN length(text) END AS value,
  CASE WHEN doc_id % 29 = 3 THEN 'ValueError' END AS error_type, CASE WHEN doc_id % 29 = 3 THEN 'odd layout' END AS message FROM d
UNION ALL SELECT document_id, 'digits', CASE WHEN doc_id % 31 <> 4 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) END,
  CASE WHEN doc_id % 31 = 4 THEN 'KeyError' END, CASE WHEN doc_id % 31 = 4 THEN 'unknown code' END FROM d
UNION ALL SELECT document_id, 'lines', length(text) - length(replace(text, chr(10), '')) + 1, NULL, NULL FROM d""")
def contained_extractors(i: Inputs) -> DataFrame:
    """Three extractors in one pass over all documents; one that raises on a document loses that result only."""
    found = containment.run_extractors(i.texts(), {"lengths": _lengths, "digits": _digits, "lines": _lines}, "value long")
    return found.select("document_id", "extractor", "value", "error.error_type", "error.message")


@query("contained_steps", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(text, '') AS text,
  CASE WHEN doc_id % 37 = 0 THEN 'ocr' WHEN doc_id % 29 = 3 THEN 'ner' WHEN doc_id % 499 = 5 THEN 'normalizing' END AS step FROM documents)
SELECT document_id, CASE WHEN step IS NULL THEN 'complete' ELSE 'failed' END AS processing_status, step,
  CASE step WHEN 'ocr' THEN 'InvalidInput' WHEN 'ner' THEN 'ValueError' WHEN 'normalizing' THEN 'USER_RAISED_EXCEPTION' END AS error_type,
  CASE step WHEN 'ocr' THEN 'unreadable' WHEN 'ner' THEN 'odd layout' WHEN 'normalizing' THEN 'no such unit' END AS message,
  CASE WHEN step IS NULL OR step = 'normalizing' THEN length(text) END AS text_length,
  CASE WHEN step IS NULL THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines
FROM d""")
def contained_steps(i: Inputs) -> DataFrame:
    """Documents as a stream through steps that fail on some of them: before the step, in a row, and as a whole job."""
    folder = _folder(i, "contained")
    path = f"{i.folder}/documents.parquet"
    arriving = i.spark.readStream.schema(i.spark.read.parquet(path).schema).parquet(f"{path}*").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("span_pos"), "text", F.lit(0.9).alias("confidence")
    )
    number = F.col("document_id").cast("long")

    def normalise(good: DataFrame) -> dict[str, DataFrame]:
        lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
        return {"lines": good.select("document_id", F.when(number % 499 == 5, F.raise_error(F.lit("no such unit"))).otherwise(lines).alias("n_lines"))}

    intake.run_intake(
        arriving, f"{folder}/tables", f"{folder}/checkpoint",
        {"ner": lambda good: {"lengths": containment.contained(good, "ner", _lengths, "value long")}, "normalizing": normalise},
        F.when(number % 37 == 0, "unreadable"),
    ).awaitTermination()
    tables = f"{folder}/tables"
    status = intake.current_status(i.spark.read.parquet(f"{tables}/status"))
    failed = intake.read_table(i.spark, tables, "quarantine", ["document_id"])
    lengths = intake.read_table(i.spark, tables, "lengths", ["document_id"]).withColumnRenamed("value", "text_length")
    lines = intake.read_table(i.spark, tables, "lines", ["document_id"])
    return status.join(failed, "document_id", "left").join(lengths, "document_id", "left").join(lines, "document_id", "left")


@query("streamed_documents", """
SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 37 = 0 THEN 'failed' ELSE 'complete' END AS processing_status,
  CASE WHEN doc_id % 37 = 0 THEN 'unreadable' END AS message, CASE WHEN doc_id % 37 <> 0 THEN length(text) END AS text_length
FROM documents""")
def streamed_documents(i: Inputs) -> DataFrame:
    """Documents arrive as a stream in two steps; unreadable ones are set aside, and each has its last status."""
    folder = _folder(i, "intake")
    path = f"{i.folder}/documents.parquet"
    # a pattern, as a stream reads folders and the table may be one file
    arriving = i.spark.readStream.schema(i.spark.read.parquet(path).schema).parquet(f"{path}*").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("span_pos"), "text", F.lit(0.9).alias("confidence")
    )
    problem = F.when(F.col("document_id").cast("long") % 37 == 0, "unreadable")
    intake.run_intake(
        arriving, f"{folder}/tables", f"{folder}/checkpoint",
        {
            "ocr": lambda good: {"lengths": good.select("document_id", F.char_length("text").cast("long").alias("text_length"))},
            "ner": lambda good: {"token_map": masking.token_map(masking.mask(good))},
        },
        problem,
    ).awaitTermination()
    tables = f"{folder}/tables"
    status = intake.current_status(i.spark.read.parquet(f"{tables}/status"))
    failed = intake.read_table(i.spark, tables, "quarantine", ["document_id"]).select("document_id", "message")
    lengths = intake.read_table(i.spark, tables, "lengths", ["document_id"])
    return status.join(failed, "document_id", "left").join(lengths, "document_id", "left")
