"""A corpus pipeline of the operators in carefold.llm: each stage takes what the stage before it kept.

Stages keep every column of ``documents``; only the last one returns ids instead of texts. A stage's result is stored before
the next stage starts, which then deletes what the stage before had stored on its way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm import bpe, common, decontaminate, neardup, substrings, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders that the stages of this process have stored and that may still be read.
_STORED: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage that takes stored ``docs`` and first deletes what earlier stages stored, but for what ``docs`` reads."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _STORED[:] = common.delete_unread(_STORED, docs)
        with common.recorded() as folders:
            kept = function(spark, docs, sf_dir)
        _STORED.extend(folders)
        return kept

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, by a classifier fitted on these documents and ``labels``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every near-duplicate class."""
    return neardup.keep_one(docs)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages and lines that an earlier one holds; a text may become empty, the document stays."""
    return substrings.remove(docs, substrings.all_repeats(docs))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verified item of ``benchmark``."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the byte-level BPE ids of the text that is left, and their number."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Learned scores and token ids have no form in SQL; tests/llm hold the stages against plain versions of them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored as Parquet and read again by the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
