"""The whole way from raw search requests to results."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.filters import FTS_WEIGHT, LIMIT_DEFAULT, SEMANTIC_WEIGHT, consumer_columns, normalise_queries, resolve_supplier
from larder.operators.hybrid import THRESHOLD, search_hybrid_batch
from larder.operators.maintenance import Embedder


@dataclass(frozen=True)
class SearchRun:
    queries: DataFrame
    results: DataFrame
    rejects: DataFrame


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Fill missing query vectors from the text."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    if "query_embedding" not in queries.columns:
        return queries.withColumn("query_embedding", embed("search_text"))
    return queries.withColumn("query_embedding", F.coalesce("query_embedding", embed("search_text")))


def search(
    raw_queries: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    embedder: Embedder | None = None,
    strict_supplier: bool = False,
    similarity_threshold: float = THRESHOLD,
    config: str = "simple",
) -> SearchRun:
    """Clean the requests, resolve suppliers, embed where needed and run the hybrid search."""
    cleaned = normalise_queries(raw_queries)
    rejects = cleaned.where(F.col("reject").isNotNull()).select("query_id", "reject")
    queries = cleaned.where(F.col("reject").isNull()).drop("reject")
    if "supplier" in queries.columns:
        queries = resolve_supplier(queries, suppliers, strict_supplier)
        if strict_supplier:
            queries = queries.where(~F.col("supplier_missing")).drop("supplier_missing")
    if embedder is not None:
        queries = embed_queries(queries, embedder)
    results = search_hybrid_batch(products, suppliers, queries, LIMIT_DEFAULT, similarity_threshold, config)
    return SearchRun(queries, results, rejects)


def assistant_search(
    queries: DataFrame, products: DataFrame, suppliers: DataFrame,
    similarity_threshold: float = THRESHOLD, config: str = "simple",
) -> DataFrame:
    """The assistant's search: fixed weights and limit, and only the fields it needs."""
    fixed = queries.withColumns(
        {"fts_weight": F.lit(FTS_WEIGHT), "semantic_weight": F.lit(SEMANTIC_WEIGHT), "result_limit": F.lit(LIMIT_DEFAULT)}
    )
    found = search_hybrid_batch(products, suppliers, fixed, LIMIT_DEFAULT, similarity_threshold, config)
    return consumer_columns(found, "query_id")


def search_messages(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Number of hits per query and a message where there are none."""
    n = results.groupBy("query_id").agg(F.count("*").alias("count"))
    out = queries.select("query_id", "search_text").join(n, "query_id", "left").na.fill(0, ["count"])
    # fixed value: the text shown for an empty result
    none = F.concat(F.lit('Nessun risultato per: "'), F.col("search_text"), F.lit('"'))
    return out.withColumn("message", F.when(F.col("count") == 0, none))
