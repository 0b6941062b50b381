"""Signup events to customers, exactly one per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.maintenance import PROFILE_FIELDS, customers_from_signups
from larder.streaming.sinks import append_batch, append_new


def write_customers(
    signups: DataFrame, path: str, rejects_path: str, checkpoint: str, fields: list[str] = PROFILE_FIELDS, **trigger
):
    """Start the stream: the first signup of a user becomes a customer, unusable events are kept aside.

    An event without a user or with a profile that is no JSON goes to ``rejects_path``; it does not
    stop the others.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        meta = F.col("raw_user_meta_data")
        broken = F.col("user_id").isNull() | (meta.isNotNull() & F.try_parse_json(meta).isNull())
        reason = F.when(F.col("user_id").isNull(), "user_missing").otherwise("profile_not_json")
        append_batch(batch.where(broken).withColumn("reason", reason), batch_id, rejects_path)
        append_new(customers_from_signups(batch.where(~broken), fields), batch_id, path, "auth_user_id")

    writer = signups.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
