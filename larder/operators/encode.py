"""Search results as JSON lines or as one document per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _hit_counts(queries: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id", "search_text").join(counts, "query_id", "left").na.fill(0, ["n"])


def result_lines(queries: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, seq, line): a metadata line, one line per hit in rank order, a closing line."""
    counts = _hit_counts(queries, results)
    head = counts.select(
        "query_id",
        F.lit(0).cast("long").alias("seq"),
        F.to_json(
            F.struct(F.lit("metadata").alias("type"), F.col("search_text").alias("query"), F.col("n").alias("count")),
            _KEEP_NULLS,
        ).alias("line"),
    )
    body = results.select(
        "query_id",
        F.col("rank_no").cast("long").alias("seq"),
        F.to_json(F.struct(F.lit("result").alias("type"), F.struct(*fields).alias("data")), _KEEP_NULLS).alias("line"),
    )
    tail = counts.select(
        "query_id",
        (F.col("n") + 1).alias("seq"),
        F.to_json(F.struct(F.lit("done").alias("type"), F.col("n").alias("count")), _KEEP_NULLS).alias("line"),
    )
    return head.unionByName(body).unionByName(tail)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the lines as text, every query's lines together and in order."""
    spread = lines.repartitionByRange("query_id", "seq").sortWithinPartitions("query_id", "seq")
    spread.select("line").write.mode("overwrite").text(path)


def result_documents(queries: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, document): {query, count, results}; a query without hits gets an empty list.

    A query's list is at most its result limit long.
    """
    hit = F.struct(F.col("rank_no"), F.struct(*fields).alias("data"))
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    out = queries.select("query_id", "search_text").join(lists, "query_id", "left")
    found = F.coalesce(F.transform("hits", lambda h: h["data"]), F.array())
    body = F.struct(F.col("search_text").alias("query"), F.size(found).alias("count"), found.alias("results"))
    return out.select("query_id", F.to_json(body, _KEEP_NULLS).alias("document"))
