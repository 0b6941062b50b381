"""A price-list load from raw rows to accepted products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.loading import PRODUCT_KEY, split_new_batches, split_new_rows
from larder.sources.price_lists import import_summary, write_products


@dataclass(frozen=True)
class ImportRun:
    """Lazy outputs of one load; ``checked`` holds every row with its status."""

    checked: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    summary: DataFrame


def import_products(
    load: DataFrame,
    target: DataFrame,
    suppliers: DataFrame,
    path: str | None = None,
    batch_atomic: bool = False,
    order: str = "line_no",
) -> ImportRun:
    """Split a cleaned load by its key conflicts and append what is new.

    Without a ``path`` this is a dry run: everything is planned and nothing is written.
    """
    split = split_new_batches if batch_atomic else split_new_rows
    checked = split(load, target, PRODUCT_KEY, order)
    accepted = checked.where(F.col("status") == "accepted").select(*load.columns)
    rejected = checked.where(F.col("status") != "accepted")
    if path is not None:
        write_products(accepted.drop(order), path)
    return ImportRun(checked, accepted, rejected, import_summary(load, suppliers))
