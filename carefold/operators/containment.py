"""Errors of single rows inside a step: captured with the row, so that the others go on.

Two ways lead to the same ``error`` column (step, type, message; null where all went well):

* ``contained`` and ``run_extractors`` run Python functions over Arrow batches. A batch that raises is cut in halves until the
  row that raises is alone; it becomes an error row. A row costs at most twice the logarithm of its batch in repeats.
* ``checked`` takes a column that holds a message where a row cannot be processed, such as one built on ``try_*`` functions.

``poisoned`` is for steps that are plans of their own and fail as a whole job: it stores the documents in buckets and halves
those that raise until the documents that raise are alone. ``poisoned_parts`` gives the same for tables that work on each
partition of the documents by itself: one plan for all parts of a size, and a job of one task for each part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from carefold.session import local_table, shared_folder

#: Runs of a failing step at a time while its documents are looked for.
PARALLEL_RUNS = 8
#: Documents of a bucket, about.
BUCKET_DOCS = 512
#: Parts into which a part that raises is cut. A run that raises is tried again by the cluster, so few levels cost least.
FAN_OUT = 8
#: A sampled fraction that leaves no row; the sampler reads all of them.
NO_ROWS = 1e-12

#: Takes rows, gives rows; what it gives for a row must not depend on the other rows.
Rows = Callable[[pd.DataFrame], pd.DataFrame]


def _halved(rows: pd.DataFrame, work: Rows) -> Iterator[tuple[pd.DataFrame, Exception | None]]:
    """What ``work`` gives, in the order of the rows, or single rows with what they raised."""
    try:
        yield work(rows), None
    except Exception as error:  # noqa: BLE001  any error of a row is that row's alone
        if len(rows) <= 1:
            yield rows, error
            return
        half = len(rows) // 2
        yield from _halved(rows.iloc[:half], work)
        yield from _halved(rows.iloc[half:], work)


def run_extractors(df: DataFrame, extractors: Mapping[str, Rows], schema: str, key: str = "document_id") -> DataFrame:
    """One pass that runs every extractor over every row: ``key``, ``extractor``, the columns of ``schema``, ``error``.

    An extractor that raises on a row loses that row's results of its own and nothing else; its error is one row in
    which the columns of ``schema`` are null. ``schema`` names columns that the extractors give beside ``key``. Empty
    tables give no rows; an extractor may give no row or many for a row of input.
    """
    kind = df.schema[key].dataType.simpleString()
    given = [f.name for f in StructType.fromDDL(schema)]
    names = [key, "extractor", *given, "_type", "_message"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, work in extractors.items():
                if not len(batch):
                    continue
                # one table for a batch, as each given table is a message of its own
                parts = []
                for part, error in _halved(batch, work):
                    out = {key: part[key], **{column: part[column] if error is None else None for column in given}}
                    parts.append(pd.DataFrame({
                        **out, "_type": None if error is None else type(error).__name__, "_message": None if error is None else _text(error),
                    }, index=part.index))
                whole = pd.concat(parts, ignore_index=True)
                whole["extractor"] = name
                yield whole[names]

    found = df.mapInPandas(run, f"`{key}` {kind}, extractor string, {schema}, _type string, _message string")
    error = F.struct(F.col("extractor").alias("step"), F.col("_type").alias("error_type"), F.col("_message").alias("message"))
    return found.withColumn("error", F.when(F.col("_type").isNotNull(), error)).drop("_type", "_message")


def contained(df: DataFrame, step: str, work: Rows, schema: str, key: str = "document_id") -> DataFrame:
    """``key``, the columns of ``schema`` and ``error`` of one Python step over every row."""
    return run_extractors(df, {step: work}, schema, key).drop("extractor")


def checked(df: DataFrame, step: str, problem: Column, error_type: str = "InvalidInput") -> DataFrame:
    """``df`` with an ``error`` where ``problem`` is not null; no Python, no shuffle."""
    return df.withColumn("error", F.when(problem.isNotNull(), F.struct(F.lit(step).alias("step"), F.lit(error_type).alias("error_type"), problem.alias("message"))))


def failures(df: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per document with an error: key, step, error_type and message, the first by these in order."""
    return (
        df.filter(F.col("error").isNotNull())
        .groupBy(key).agg(F.min(F.struct("error.step", "error.error_type", "error.message")).alias("e")).select(key, "e.*")
    )


def quarantine(df: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Rows of documents without an error, and the failures. A document with any failed row is failed as a whole."""
    failed = failures(df, key)
    # a null key is a document like others: it must not slip through the anti-join
    return df.drop("error").join(failed.select(F.col(key).alias("_failed")), F.col(key).eqNullSafe(F.col("_failed")), "left_anti"), failed


def poisoned(
    docs: DataFrame, run: Callable[[DataFrame], None], step: str, key: str = "document_id", folder: str | None = None, bucket: int = BUCKET_DOCS,
) -> list[tuple]:
    """(key, step, error_type, message) of the documents on which ``run`` raises.

    The documents are stored once, below ``folder`` or the shared folder, in buckets of about ``bucket`` by a hash of the key. A
    run over a part of a bucket reads that bucket alone, so a run costs the same however many documents there are. Buckets
    that raise are halved by the bits of another hash; of two halves of a part that raises, the second one is not run as a whole
    where the first one passes. Each document found was run by itself; it costs about the logarithm of its bucket in runs. An error
    that also arises without any document, or while a plan is built, is none of the documents': it is raised again.
    """
    run(docs.limit(0))
    spark = docs.sparkSession
    path = f"{folder or shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    n_buckets = docs.count() // bucket + 1
    stored = docs.withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(n_buckets)).cast("int"))
    stored.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    # the buckets' folders are listed once; a filter by their number leaves one
    schema = StructType(docs.schema.fields).add("_bucket", IntegerType())
    stored = spark.read.schema(schema).parquet(path)
    place = F.xxhash64(key)

    def raised(part: DataFrame) -> Exception | None:
        try:
            run(part)
        except AnalysisException:
            raise
        except Exception as error:  # noqa: BLE001  the documents that raise it are looked for
            return error
        return None

    def searched(number: int) -> list[tuple]:
        whole = stored.filter(F.col("_bucket") == number).drop("_bucket")
        if (error := raised(whole)) is None:
            return []
        keys = [tuple(r) for r in whole.select(place, key).distinct().collect()]
        return halved(whole, keys, 0, 0, error)

    def halved(whole: DataFrame, keys: list[tuple], level: int, low: int, error: Exception | None) -> list[tuple]:
        """The documents among ``keys`` that raise; ``error`` is what they raise together, None where that was not run."""

        def part(level: int, low: int) -> DataFrame:
            return whole.filter(place.bitwiseAND(F.lit((1 << level) - 1)) == F.lit(low)) if level else whole

        if len(keys) == 1 or level == 63:
            error = error or raised(part(level, low))
            return [] if error is None else [(k, step, *described(error)) for _, k in keys]
        halves = [([x for x in keys if (x[0] >> level) & 1 == bit], low | (bit << level)) for bit in (0, 1)]
        if not all(mine for mine, _ in halves):
            return halved(whole, *next((mine, level + 1, at) for mine, at in halves if mine), error)
        (first, first_at), (second, second_at) = halves
        seen = raised(part(level + 1, first_at))
        if seen is None:
            # a document that raises must then be in the second half
            return halved(whole, second, level + 1, second_at, None)
        found = halved(whole, first, level + 1, first_at, seen)
        seen = raised(part(level + 1, second_at))
        return found if seen is None else found + halved(whole, second, level + 1, second_at, seen)

    numbers = [r[0] for r in stored.select("_bucket").distinct().collect()]
    # the buckets are runs of their own, some at a time
    with ThreadPoolExecutor(PARALLEL_RUNS) as pool:
        return [row for rows in pool.map(searched, numbers) for row in rows]


Tables = Callable[[DataFrame], Mapping[str, DataFrame]]


def poisoned_parts(docs: DataFrame, work: Tables, step: str, key: str = "document_id", bucket: int = BUCKET_DOCS) -> list[tuple] | None:
    """(key, step, error_type, message) of the documents on which a table of ``work`` raises; the first such table counts.

    None where a table is not made partition by partition (see ``_by_partition``). The documents are dealt into partitions of
    about ``bucket`` documents. Where the tables are projections, one pass tells the documents to be run by themselves
    (see ``_suspects``). If the others still raise, they are looked for by parts (see ``_searched``). An error that arises
    without documents is raised again.
    """

    def tried(part: DataFrame) -> None:
        for table in work(part).values():
            table.write.format("noop").mode("overwrite").save()

    tried(docs.limit(0))
    spark = docs.sparkSession
    # two at least, as a plan over one partition shows no shuffle
    n = docs.count() // bucket + 2
    placed, source = _placed(docs.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n)
    whole = placed.drop("_part")
    if any(_by_partition(table, source) is None for table in work(whole).values()):
        return None
    found: list[tuple] = []
    suspects = _suspects(whole, work, key)
    if suspects:
        kind = docs.schema[key].dataType
        numbered = local_table(spark, [(k, number) for number, k in enumerate(suspects)], StructType([StructField("_suspect", kind), StructField("_part", IntegerType())]))
        alone = whole.join(numbered, F.col(key).eqNullSafe(F.col("_suspect"))).drop("_suspect")
        found = _searched(alone, len(suspects), work, step, key)
        gone = local_table(spark, [r[:1] for r in found], StructType([StructField("_gone", kind)]))
        placed = placed.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
        try:
            tried(placed.drop("_part"))
            return found
        except AnalysisException:
            raise
        except Exception:  # noqa: BLE001  others raise as well
            pass
    return found + _searched(placed, n, work, step, key)


def _placed(dealt: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The rows in ``n`` partitions by ``_part``, shuffled once for all that is made of them, and the number of their RDD."""
    spark = dealt.sparkSession
    rows = dealt.repartitionById(n, "_part")._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, dealt._jdf.schema(), False), spark), rows.id()


def _searched(dealt: DataFrame, n: int, work: Tables, step: str, key: str) -> list[tuple]:
    """The documents that raise among those dealt into ``n`` parts by ``_part``.

    A part is a partition, and each partition of the tables is a job of one task. The parts that raise are cut into ``FAN_OUT``
    parts of equal size, which are the partitions of the next round, until a part is one document. So a round costs one
    shuffle and one plan, and a part one task.
    """
    spark = dealt.sparkSession
    gateway = spark.sparkContext._gateway
    columns = [c for c in dealt.columns if c != "_part"]
    while True:
        placed, source = _placed(dealt, n)
        tables = [_by_partition(table, source) for table in work(placed.select(columns)).values()]

        def raised(part: int) -> Exception | None:
            only = gateway.new_array(gateway.jvm.int, 1)
            only[0] = part
            try:
                for table in tables:
                    # an RDD of its own, as a job that fails takes those along that run on the same RDD
                    table.sample(False, NO_ROWS).collectPartitions(only)
            except Exception as error:  # noqa: BLE001  the documents that raise it are looked for
                return error
            return None

        with ThreadPoolExecutor(PARALLEL_RUNS) as pool:
            errors = {part: described(error) for part, error in enumerate(pool.map(raised, range(n))) if error is not None}
        if not errors:
            return []
        numbers = local_table(spark, [(part, k) for k, part in enumerate(errors)], "_part int, _number int")
        few = placed.coalesce(4 * spark.sparkContext.defaultParallelism)
        ranked = few.join(numbers, "_part").withColumn("_place", F.dense_rank().over(Window.partitionBy("_part").orderBy(key)))
        sizes = dict(ranked.groupBy("_number").agg(F.max("_place")).collect())
        most = max(sizes.values())
        if most == 1:
            return [(k, step, *errors[part]) for part, k in ranked.select("_part", key).distinct().collect()]
        # a part of up to twice the fan-out is cut into its documents
        cuts = most if most <= 2 * FAN_OUT else FAN_OUT
        ends = list(accumulate(min(sizes[k], cuts) for k in range(len(sizes))))
        starts = local_table(spark, [(k, end - min(sizes[k], cuts)) for k, end in enumerate(ends)], "_number int, _start int")
        n, within = ends[-1], (F.col("_place") - 1) % cuts
        dealt = ranked.join(starts, "_number").select(*columns, (F.col("_start") + within).cast("int").alias("_part"))


def _by_partition(table: DataFrame, source: int):
    """The table's rows as an RDD, or None unless each partition comes from the same partition of RDD ``source`` alone.

    Nothing that shuffles, unites or regroups partitions lies between them, and nothing else in the plan may read the documents.
    """
    execution = table._jdf.queryExecution()
    plan = execution.optimizedPlan().toString()
    if plan.count("LogicalRDD [") != 1 or "subquery" in plan.lower() or _SHUFFLE.search(execution.executedPlan().toString()):
        return None
    try:
        rows = execution.toRdd()
    except Exception:  # noqa: BLE001  what is broadcast raises
        return None
    below = rows
    while below.id() != source:
        lines = below.dependencies()
        if lines.size() != 1 or lines.apply(0).getClass().getSimpleName() != "OneToOneDependency":
            return None
        below = lines.apply(0).rdd()
    return rows.toJavaRDD()


def _suspects(docs: DataFrame, work: Tables, key: str) -> list | None:
    """Keys of the documents on which columns of a table raise, by one pass that catches errors row by row.

    Only where every table is a projection of the documents' rows, with a filter below it or not; else None. It is a hint: what
    a document raises is learned by running it.
    """
    sql = docs.sparkSession._jvm.org.apache.spark.sql
    of, fails = sql.classic.ExpressionUtils, F.lit(False)
    for table in work(docs).values():
        node, columns, kept = table._jdf.queryExecution().optimizedPlan(), [], F.lit(True)
        if node.getClass().getSimpleName() == "Project":
            listed = node.projectList()
            columns, node = [Column(of.column(listed.apply(k))) for k in range(listed.size())], node.child()
        if node.getClass().getSimpleName() == "Filter":
            kept, node = Column(of.column(node.condition())), node.child()
        if node.getClass().getSimpleName() != "LogicalRDD":
            return None
        given = F.struct(kept.alias("kept"), F.when(kept, F.struct(*columns, F.lit(1))))
        fails = fails | Column(of.column(sql.catalyst.expressions.TryEval(of.expression(given._jc)))).isNull()
    try:
        return [r[0] for r in docs.filter(fails).select(key).distinct().collect()]
    except Exception:  # noqa: BLE001  it is looked for by parts
        return None


_SHUFFLE = re.compile(r"(?<!Broadcast)Exchange")
_PYTHON = re.compile(r"^(?:\w+\.)*(\w*(?:Error|Exception)): (.*)$", re.M)
_CONDITION = re.compile(r"\[([A-Z][A-Z0-9_.]+)\] (.*)")
# Conditions that only say that a task or a write failed.
_OUTER = ("TASK_WRITE_FAILED", "WRITING_JOB_ABORTED", "FAILED_EXECUTE_UDF")


def described(error: Exception) -> tuple[str, str]:
    """Type and message of what a job raised: the last Python error in it, or the innermost condition."""
    text = str(error)
    if found := _PYTHON.findall(text.split("JVM stacktrace")[0]):
        kind, message = found[-1]
        if not kind.startswith(("Spark", "Py4J")):
            return kind, message.strip()
    inner = [m for m in _CONDITION.findall(text) if m[0] not in _OUTER]
    if inner:
        kind, message = inner[0]
        return kind, message.split(" SQLSTATE:")[0].strip()
    return type(error).__name__, text.splitlines()[0] if text else ""


def _text(error: Exception) -> str:
    return str(error.args[0]) if error.args else ""
