"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: Files of ids and rings are many times smaller than their rows in memory. Spark takes the size of a file for that of its rows
#: unless told so, and would then broadcast tables of hundreds of MB through the driver.
SIZE_CONF = {"spark.sql.sources.fileCompressionFactor": "16.0"}
#: Adaptive execution gives a task up to 64 MB of a shuffle as compressed, which is a GB and more of rings or ids once sorted, and takes no hot key
#: apart below 256 MB; a task that reads files gets up to 128 MB of them. Smaller shares, and enough partitions to cut them from, keep a task's memory from growing with the input.
SHARE_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
              "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400", "spark.sql.files.maxPartitionBytes": "8m"}
SESSION_CONF.update(SIZE_CONF)
SESSION_CONF.update(SHARE_CONF)


def build_session(app: str = "parcelflow", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def with_true_sizes(spark: SparkSession) -> SparkSession:
    """Gives a session that the caller built the size estimate and the shares above, unless it has some of its own."""
    for key, value in SIZE_CONF.items():
        if float(spark.conf.get(key)) == 1.0:
            spark.conf.set(key, value)
    for key, value in SHARE_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="parcelflow-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once below the shared folder and reads it back, so loops neither grow the plan
    nor recompute it, and a lost executor costs nothing but its running tasks.

    A reliable checkpoint would compute the data twice, once to count it and once to save it.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(*steps):
    """The results of steps that do not need each other, run side by side.

    A chain of small jobs leaves most cores idle while the driver plans the next one.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(step)) for step in steps]]


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right)`` by shuffle and sort, whatever the sizes.

    A loop that joins small tables in every round would broadcast each of them through the driver, a few MB at a time.
    """
    return left.join(right.hint("merge"), on, how)
