"""Collects the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans.views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so both engines print one number type."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else f.name for f in df.schema]
    )


def query(name: str, oracle: str | None = None):
    """Register a function of Views under ``name`` with its SQL."""

    def add(build):
        QUERIES[name] = lambda spark, folder: plain(build(Views(spark, folder)))
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return build

    return add
