"""Session construction and the few plan-level helpers operators share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: The state store that streams with state of their own need: it has column families and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "carefold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        # Call sites cost two extra calls per column expression while a plan is built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session for streams with state of their own; the settings of ``spark`` itself stay as they are.

    ``spark`` is given back where it has the state store already. The new session has its shuffle partitions and time zone.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) == STATE_STORE:
        return spark
    other = spark.newSession()
    other.conf.set(name, STATE_STORE)
    for kept in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(kept, spark.conf.get(kept))
    return other


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="carefold-shared-"))
    return context.getCheckpointDir()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """Few rows as a local relation: the planner knows its exact size, where rows given as a list have none."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.table({f.name: [r[k] for r in rows] for k, f in enumerate(kind.fields)}), kind)


def spread(scan: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Gives a scan at least one partition per core before row-local text work.

    A table that comes in fewer splits than the cluster has cores would leave
    cores idle. Tables of ordinary size have more splits and pass unchanged, so
    no shuffle is added where it would cost anything. ``task_bytes`` bounds what one task is given by the optimizer's
    estimate, for narrow rows that stand for much work.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        wanted = max(wanted, -(-estimated_bytes(scan) // task_bytes))
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan
