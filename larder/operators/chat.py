"""Stored conversations: history windows, message shapes, tool calls, token use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.seeds import TOOLS

MAX_HISTORY = 40
CALLS = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"


def history(
    messages: DataFrame,
    limit: int = MAX_HISTORY,
    keep: str = "oldest",
    session: list[str] = ("customer_id", "session_id"),
    order: list[str] = ("created_at", "id"),
) -> DataFrame:
    """At most ``limit`` messages per session, numbered in ``seq``.

    The default keeps the oldest ones; ``keep="latest"`` keeps the newest. The literal limit prunes
    every session inside each input partition, so one huge session does not reach one task whole.
    """
    cut = [F.asc(c) for c in order] if keep == "oldest" else [F.desc(c) for c in order]
    inside = Window.partitionBy(*session)
    kept = messages.withColumn("seq", F.row_number().over(inside.orderBy(*cut))).where(F.col("seq") <= limit)
    if keep == "oldest":
        return kept
    return kept.withColumn("seq", F.row_number().over(inside.orderBy(*[F.asc(c) for c in order])))


def shape_messages(messages: DataFrame) -> DataFrame:
    """Add ``shaped``: the fields a chat model takes for each kind of message."""
    has_calls = (F.col("role") == "assistant") & F.col("tool_calls").isNotNull()
    is_tool = F.col("role") == "tool"
    content = F.when(has_calls, F.nullif("content", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    return messages.withColumn(
        "shaped",
        F.struct(
            F.col("role"),
            content.alias("content"),
            F.when(has_calls, F.col("tool_calls")).alias("tool_calls"),
            F.when(is_tool, F.col("tool_call_id")).alias("tool_call_id"),
        ),
    )


def conversations(
    messages: DataFrame, new_messages: DataFrame | None = None, limit: int = MAX_HISTORY, keep: str = "oldest"
) -> DataFrame:
    """One ordered array per session: its history window and then the new user message, if any.

    ``new_messages``: customer_id, session_id, content. An array holds at most ``limit`` + 1 entries.
    """
    kept = shape_messages(history(messages, limit, keep)).select("customer_id", "session_id", "seq", "shaped")
    if new_messages is not None:
        asked = new_messages.withColumns({"role": F.lit("user"), "tool_calls": F.lit(None).cast("string"),
                                          "tool_call_id": F.lit(None).cast("string")})
        kept = kept.unionByName(
            shape_messages(asked).select("customer_id", "session_id", F.lit(limit + 1).alias("seq"), "shaped")
        )
    lists = kept.groupBy("customer_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "shaped"))).alias("m"))
    return lists.select("customer_id", "session_id", F.transform("m", lambda x: x["shaped"]).alias("messages"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call; arguments that are no JSON become an empty object."""
    calls = messages.where((F.col("role") == "assistant") & F.col("tool_calls").isNotNull())
    opened = calls.select("customer_id", "session_id", F.col("id").alias("message_id"),
                          F.explode(F.from_json("tool_calls", CALLS)).alias("call"))
    raw = F.col("call.function.arguments")
    valid = F.try_parse_json(raw).isNotNull()
    return opened.select(
        "customer_id", "session_id", "message_id",
        F.col("call.id").alias("tool_call_id"),
        F.col("call.function.name").alias("tool_name"),
        F.when(valid, raw).otherwise(F.lit("{}")).alias("arguments"),
    )


def paired_calls(messages: DataFrame, known: tuple[str, ...] = TOOLS) -> DataFrame:
    """Tool calls with their stored result; an unknown tool gets an error message."""
    results = messages.where(F.col("role") == "tool").select(
        "customer_id", "session_id", "tool_call_id", F.col("content").alias("result")
    )
    paired = tool_calls(messages).join(results, ["customer_id", "session_id", "tool_call_id"], "left")
    unknown = ~F.coalesce(F.col("tool_name").isin(*known), F.lit(False))
    return paired.withColumn("error", F.when(unknown, F.concat(F.lit("unknown tool: "), F.coalesce("tool_name", F.lit("")))))


def token_usage(messages: DataFrame) -> DataFrame:
    """Prompt and completion tokens per session and model; NULL counts as 0."""
    prompt = F.coalesce("tokens_prompt", F.lit(0)).cast("long")
    completion = F.coalesce("tokens_completion", F.lit(0)).cast("long")
    return (
        messages.groupBy("session_id", "model")
        .agg(F.sum(prompt).alias("prompt"), F.sum(completion).alias("completion"))
        .withColumn("total", F.col("prompt") + F.col("completion"))
    )
