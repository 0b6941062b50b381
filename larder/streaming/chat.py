"""Chat messages from a stream to the message and cart-action tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.cart import cart_actions
from larder.streaming.sinks import append_batch, append_new, read_table


def write_chat(messages: DataFrame, messages_path: str, actions_path: str, checkpoint: str, **trigger):
    """Start the stream: each message id is stored once; assistant replies also yield cart actions."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("id").agg(F.min(F.struct(*[c for c in batch.columns if c != "id"])).alias("m")).select("id", "m.*")
        append_new(first, batch_id, messages_path, "id")
        # actions come from what was stored, so a repeated message adds none
        stored = read_table(batch.sparkSession, messages_path).where(F.col("batch_id") == batch_id)
        replies = stored.where(F.col("role") == "assistant")
        append_batch(cart_actions(replies, keys=["id", "customer_id", "session_id", "created_at"]), batch_id, actions_path)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def cart_log(actions: DataFrame) -> DataFrame:
    """Stored actions as an ordered log for ``cart_state``: one cart per customer and session."""
    return actions.select(
        F.concat_ws("/", "customer_id", "session_id").alias("cart_id"),
        F.struct("created_at", "message_id", "block_no", "action_no").alias("seq"),
        "action",
        F.col("id").alias("item_id"),
        F.col("qty").cast("long").alias("qty"),
    )
