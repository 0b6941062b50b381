"""Helpers of the operators: words, checked broadcasts, checkpoints."""

from __future__ import annotations

import string
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A frame of at most so many rows of a few numbers is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def array_of(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def durable(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder that spark.checkpoint.dir names; an own folder only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def small_or_shuffled(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpoint, marked for broadcast only when it was counted and is within the limit.

    Rows of a few numbers count as one each; for rows with arrays, weight is the number of their elements.
    """
    kept = durable(df)
    size = kept.count() if weight is None else kept.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(kept) if size <= limit else kept


def unit_hash(*columns) -> Column:
    """A number from 0 up to 1 that depends on the values alone; for samples that come out alike everywhere."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def share(held: Column, buckets: int, which: int) -> Column:
    """True where crc32 of the id as text, modulo buckets, is which; false for a null id."""
    return F.coalesce(F.crc32(held.cast("string").cast("binary")) % buckets == which, F.lit(False))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that are columns of the frame."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with place, their number from 0 in the order of keys, counted over ranges that many tasks sort."""
    spread = rows.withColumn("same", F.monotonically_increasing_id())  # equal rows can be split too
    ordered = durable(spread.repartitionByRange(*keys, "same").sortWithinPartitions(*keys, "same").drop("same"))
    at = ordered.withColumn("at", F.monotonically_increasing_id()).withColumns(
        {"range": F.shiftright("at", 33), "within": F.col("at").bitwiseAND((1 << 33) - 1)}
    )
    counts = at.groupBy("range").agg(F.count("*").alias("n_range"))  # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(counts.select("range", F.coalesce(F.sum("n_range").over(before), F.lit(0)).alias("first")))
    return at.join(F.broadcast(starts), "range").withColumn("place", F.col("first") + F.col("within")).drop("at", "range", "within", "first")
