"""Append-only tables fed by micro-batches, safe to replay after a lost executor or driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_table(spark, path: str) -> DataFrame | None:
    """The rows of all finished micro-batches, None before the first."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":  # a broken table is not an empty one
            raise
        return None


def append_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch to its own folder; a replay of the batch replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_new(rows: DataFrame, batch_id: int, path: str, key: str) -> None:
    """Append the rows whose key no earlier micro-batch wrote."""
    earlier = read_table(rows.sparkSession, path)
    if earlier is not None:
        # only the few keys that come again leave the big table
        seen = earlier.where(F.col("batch_id") != batch_id).select(key)
        again = seen.join(rows.select(key).distinct(), key, "left_semi").distinct()
        rows = rows.join(again, key, "left_anti")
    append_batch(rows, batch_id, path)
