"""Loading products: key conflicts, upserts, disabling, category assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import cut_lineage
from larder.sources.price_lists import BATCH_SIZE

PRODUCT_KEY = ["price_list_id", "supplier_id", "supplier_code"]


def split_new_rows(load: DataFrame, target: DataFrame, key: list[str] = PRODUCT_KEY, order: str = "line_no"):
    """Add ``status`` to each row of a load: accepted, duplicate_in_load or exists_in_target.

    The first row of a key by ``order`` is accepted. First rows come from a partial aggregate, so a
    key that repeats a billion times reaches the shuffle as one row per input partition.
    """
    first = load.groupBy(*key).agg(F.min(order).alias("_first"))
    taken = target.select(*key).distinct().withColumn("_taken", F.lit(True))
    verdict = first.join(taken, key, "left")
    status = (
        F.when(F.col("_taken"), "exists_in_target")
        .when(F.col(order) == F.col("_first"), "accepted")
        .otherwise("duplicate_in_load")
    )
    return load.join(verdict, key).withColumn("status", status).drop("_first", "_taken")


def split_new_batches(
    load: DataFrame, target: DataFrame, key: list[str] = PRODUCT_KEY, order: str = "line_no", batch: int = BATCH_SIZE
) -> DataFrame:
    """The all-or-nothing form: a batch of rows is rejected whole if any of its rows conflicts.

    ``order`` numbers the rows from 0. Batches load in turn, so a batch conflicts with the target, with
    itself, or with an earlier batch that was accepted. Each round settles every batch whose keys are
    all first held by itself or by an accepted batch; the earliest open batch always settles.
    """
    rows = load.withColumn("batch_no", F.floor(F.col(order) / batch).cast("long"))
    held = cut_lineage(rows.groupBy(*key, "batch_no").agg(F.count("*").alias("n")))
    in_target = target.select(*key).distinct().withColumn("_taken", F.lit(True))
    flagged = held.join(in_target, key, "left")
    bad = F.max((F.coalesce("_taken", F.lit(False)) | (F.col("n") > 1)).cast("int"))
    state = flagged.groupBy("batch_no").agg(F.when(bad == 1, "rejected").otherwise("open").alias("status"))
    keys = held.select(*key, "batch_no")
    while True:
        state = cut_lineage(state)
        if state.where(F.col("status") == "open").isEmpty():
            break
        live = keys.join(state, "batch_no").where(F.col("status") != "rejected")
        holder = live.groupBy(*key).agg(F.min(F.struct("batch_no", "status")).alias("h"))
        seen = live.where(F.col("status") == "open").join(holder, key)
        earlier = F.col("h.batch_no") < F.col("batch_no")
        settled = seen.groupBy("batch_no").agg(
            F.max((earlier & (F.col("h.status") == "accepted")).cast("int")).alias("blocked"),
            F.max(earlier.cast("int")).alias("behind"),
        )
        now = (
            F.when(F.col("status") != "open", F.col("status"))
            .when(F.col("blocked") == 1, "rejected")
            .when(F.col("behind") == 0, "accepted")
            .otherwise("open")
        )
        state = state.join(settled, "batch_no", "left").select("batch_no", now.alias("status"))
    return rows.join(state, "batch_no")


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Merge a newer list into an older one; ``change`` says added, changed, same or kept.

    A NULL in the newer row keeps the older value.
    """
    o = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_in_old"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_in_new"))
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"_n_{c}").isNull() | F.col(f"_n_{c}").eqNullSafe(F.col(f"_o_{c}")))
    change = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "kept").when(same, "same").otherwise("changed")
    )
    merged = [F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns]
    return o.join(n, key, "full_outer").select(*key, *merged, change.alias("change"))


def disable_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Flag products of an older list that the newer list no longer has."""
    listed = new.select(*key).distinct().withColumn("_listed", F.lit(True))
    return old.join(listed, key, "left").withColumn("is_active", F.coalesce("_listed", F.lit(False))).drop("_listed")


def assign_category(products: DataFrame, assignments: DataFrame) -> DataFrame:
    """Bulk assignment from (id, category_id) rows; unlisted products keep theirs."""
    new = assignments.select("id", F.col("category_id").alias("_new"))
    return products.join(new, "id", "left").withColumn("category_id", F.coalesce("_new", "category_id")).drop("_new")


def price_history(products: DataFrame, price_lists: DataFrame) -> DataFrame:
    """Price of a supplier's product across price lists by validity date, with the change.

    The window partition is one product, at most one row per price list.
    """
    dated = products.join(price_lists.select(F.col("id").alias("price_list_id"), "price_valid_date"), "price_list_id")
    by_date = Window.partitionBy("supplier_id", "supplier_code").orderBy("price_valid_date", "price_list_id")
    return dated.select(
        "supplier_id", "supplier_code", "price_list_id", "price_valid_date", "price",
        F.lag("price").over(by_date).alias("previous_price"),
    ).withColumn("change", F.col("price") - F.col("previous_price"))
