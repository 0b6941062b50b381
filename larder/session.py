"""Session defaults. On a cluster the submitter's settings win; these only fill gaps."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-k limits above the default of 1000 prune before the shuffle too
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; production code passes its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("larder")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names and all executors share; an own one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df):
    """Checkpoint an iterative frame to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A table above this size has splits enough, or is too large to deal out anew.
SPREAD_BYTES = 1 << 30


def spread(df):
    """Deal the rows of a small table out evenly when its scan has fewer splits than the cluster has cores.

    One row group cannot be split, so costly row work on it would run in one task. Only planned numbers are read; a table
    above SPREAD_BYTES is returned as it is, whatever the number of cores.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
