"""Session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a running session can still take over. Shuffle partition counts and
# memory stay with the cluster; AQE coalesces what is too many.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Blocks are small in bytes and heavy in work: merge them only while every
    # core still has a task.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Rows with whole texts are large; ten thousand of them, the default, would be
    # held several times over on the way to Python and back.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # The JVM never compiles a method of more than 8,000 bytes. A step that would
    # generate one (twenty levels a side, wide projections) runs as split methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # State of streams by entry and outside the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Settings that must be there when the context starts.
STATIC_CONF = {
    # A full feature set compiles a few hundred small classes per executor; the
    # default cache of 100 would compile them again in every task.
    "spark.sql.codegen.cache.maxEntries": "4096",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tickloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Later jobs start from the files: they do not repeat what led to them, and a
    lost executor loses nothing.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared_folder(spark)}/tickloom-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    A session on one machine that names none, as in tests, gets a temporary
    folder; on a cluster executors would not see each other's files there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-ckpt-"))
    return context.getCheckpointDir()
