"""Continuous intake: documents arrive as files, batch operators run per micro-batch.

Every write is keyed by content or by batch id, so a batch that runs again after
a failure leaves the tables as one run would.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carefold.functions.ids import stable_key
from carefold.operators import containment
from carefold.session import local_table

# Steps of a document in order.
STEPS = ("queued", "ocr", "ner", "normalizing", "trend_analysis", "complete")


Work = Callable[[DataFrame], dict[str, DataFrame]]


def read_spans(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Span files as a stream; ``max_files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def split_failures(
    df: DataFrame, step: str, problem, staged: Callable[[DataFrame, str], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one quarantine row per failed document.

    ``problem`` is a column that holds a message where a row cannot be
    processed. A document with any failed row is failed as a whole; the other
    documents go on. With ``staged`` the failures are stored first: joins then know how few they are and need not shuffle the texts.
    """
    marked = df.withColumn("_problem", problem)
    failed = (
        marked.filter(F.col("_problem").isNotNull())
        .groupBy("document_id")
        .agg(F.min("_problem").alias("message"))
        .select(
            "document_id", F.lit(step).alias("step"), F.lit("InvalidInput").alias("error_type"),
            "message",
        )
    )
    if staged is not None:
        failed = staged(failed, f"{step}-failed")
    good = marked.drop("_problem").join(failed.select("document_id"), "document_id", "left_anti")
    return good, failed


def status_rows(documents: DataFrame, status: str, batch_id: int) -> DataFrame:
    """Log rows for a status; the order of the steps breaks ties within a batch."""
    position = STEPS.index(status) if status in STEPS else len(STEPS)
    return documents.select("document_id").distinct().select(
        "document_id", F.lit(status).alias("status"),
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.lit(position).alias("step_pos"),
        stable_key(F.col("document_id"), F.lit(status)).alias("log_id"),
    )


def current_status(log: DataFrame) -> DataFrame:
    """The last status of each document: of the rows that came last, the furthest step."""
    order = [c for c in ("arrived_at", "batch_id", "step_pos") if c in log.columns]
    return log.groupBy("document_id").agg(
        F.max_by("status", F.struct(*order)).alias("processing_status")
    )


def _write_batch(df: DataFrame, folder: str, name: str, run: str, batch_id: int) -> None:
    """A batch of a stream owns its directory and overwrites it when it runs again.

    ``run`` is the id that the stream's checkpoint keeps, so a stream with a new checkpoint, whose batches count from 0
    again, writes beside what is there. The time of arrival orders rows of different streams.
    """
    stamped = df.withColumn("arrived_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(os.path.join(folder, name, f"run={run}", f"batch_id={batch_id}"))


FAILURE = "document_id string, step string, error_type string, message string"


def run_step(
    good: DataFrame, step: str, work: Work, write: Callable[[DataFrame, str], None], staged: Callable[[DataFrame, str], DataFrame],
    scratch: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Writes the step's tables for the documents it does not fail on; gives these documents' rows and the failures.

    Tables with an ``error`` column are staged first, so that each row is worked on once. If the step raises, the documents
    that make it raise are found by parts, or by halves of buckets below ``scratch``, and the step runs again without them.
    """
    try:
        return _written(good, step, work, write, staged)
    except AnalysisException:
        raise
    except Exception:
        bad = containment.poisoned_parts(good, work, step)
        if bad is None:
            bad = containment.poisoned(good, lambda part: _tried(work(part)), step, folder=scratch)
        if not bad:
            # none of the documents raises by itself: what failed was the run, which is tried once more
            return _written(good, step, work, write, staged)
    lost = local_table(good.sparkSession, bad, FAILURE)
    rest = _without(good, lost)
    left, more = _written(rest, step, work, write, staged)
    return left, lost.unionByName(more)


def _tried(tables: Mapping[str, DataFrame]) -> None:
    for table in tables.values():
        table.write.format("noop").mode("overwrite").save()


def _without(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of other documents; a null id is an id like others."""
    gone = failed.select(F.col("document_id").alias("_failed"))
    return rows.join(gone, F.col("document_id").eqNullSafe(F.col("_failed")), "left_anti")


def _written(
    good: DataFrame, step: str, work: Work, write: Callable[[DataFrame, str], None], staged: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    tables = {name: staged(t, f"{step}-{name}") if "error" in t.columns else t for name, t in work(good).items()}
    lost = good.sparkSession.createDataFrame([], FAILURE)
    for table in tables.values():
        if "error" in table.columns:
            lost = lost.unionByName(containment.failures(table).select("document_id", F.lit(step).alias("step"), "error_type", "message"))
    if any("error" in t.columns for t in tables.values()):
        # a document that two tables fail on is one failure
        lost = lost.groupBy("document_id").agg(F.min(F.struct("step", "error_type", "message")).alias("e")).select("document_id", "e.*")
        lost = staged(lost, f"{step}-lost")
        tables = {name: _without(t.drop("error"), lost) for name, t in tables.items()}
        good = _without(good, lost)
    for name, table in tables.items():
        write(table, name)
    return good, lost


def run_intake(
    spans: DataFrame,
    folder: str,
    checkpoint: str,
    process: Work | Mapping[str, Work],
    problem,
    **trigger,
) -> StreamingQuery:
    """Runs ``process`` over the good spans of each micro-batch and writes its tables.

    ``process`` is one function or one for each step of ``STEPS``; the steps that ran are logged in ``status`` with the
    outcome. A document that a step fails on goes to ``quarantine`` with step, type and message, and later steps do not
    see it; the others go on. A step fails on a document if one of its tables has a row of that document with an
    ``error`` (see :mod:`carefold.operators.containment`), or if it raises while that document is in the batch.
    """
    steps = process if isinstance(process, Mapping) else {"ocr": process}

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()

        def write(table: DataFrame, name: str) -> None:
            _write_batch(table, folder, name, run, batch_id)

        def staged(table: DataFrame, name: str) -> DataFrame:
            path = os.path.join(folder, "_staged", f"run={run}", f"batch_id={batch_id}", name)
            table.write.mode("overwrite").parquet(path)
            return table.sparkSession.read.schema(table.schema).parquet(path)

        try:
            good, failed = split_failures(batch, "ocr", problem, staged)
            log = status_rows(batch, "queued", batch_id)
            for step, work in steps.items():
                good, lost = run_step(good, step, work, write, staged, os.path.join(folder, "_staged", f"run={run}", f"batch_id={batch_id}"))
                failed = failed.unionByName(lost)
                log = log.unionByName(status_rows(good, step, batch_id))
            write(failed, "quarantine")
            log = log.unionByName(status_rows(failed, "failed", batch_id)).unionByName(status_rows(good, "complete", batch_id))
            write(log, "status")
        finally:
            batch.unpersist()

    return (
        spans.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_table(spark: SparkSession, folder: str, name: str, keys: list[str]) -> DataFrame:
    """An intake table; of rows that arrived again those that came last count."""
    rows = spark.read.parquet(os.path.join(folder, name))
    fields = [c for c in rows.columns if c not in (*keys, "run", "batch_id", "arrived_at")]
    if not fields:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("arrived_at", "batch_id")).alias("r")
    ).select(*keys, "r.*")
