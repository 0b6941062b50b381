"""Hybrid search: full-text and vector candidates fused into one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.vectors import cosine_similarity
from larder.operators import batches as bt
from larder.operators.filters import FTS_WEIGHT, SEMANTIC_WEIGHT, optional_filters
from larder.operators.fulltext import parse, parse_queries, ranked_matches, text_hits, with_rank, with_tokens
from larder.operators.vectors import semantic_top, single_query, vector_hits

THRESHOLD = 0.3
LEGACY_THRESHOLD = 0.5


def max_normalised(x: str, per: str = "query_id") -> Column:
    """Share of the largest value in the result set; 0 when that is 0."""
    top = F.max(x).over(Window.partitionBy(per))
    return F.when(top > 0, F.col(x) / top).otherwise(F.lit(0.0))


def weighted_sum(fts: Column, semantic: Column) -> Column:
    return bt.score(fts * F.col("fts_weight") + semantic * F.col("semantic_weight"))


def fuse(text: DataFrame, vector: DataFrame, queries: DataFrame, normalise: bool = True) -> DataFrame:
    """Full outer join of the two candidate lists, normalised and weighted.

    Both inputs hold at most k rows per query, so the per-query window is small by construction.
    """
    combined = text.select("query_id", "id", "fts_rank").join(
        vector.select("query_id", "id", F.col("similarity").alias("semantic_similarity")), ["query_id", "id"], "full_outer"
    ).na.fill(0.0, ["fts_rank", "semantic_similarity"])
    scaled = combined.withColumn("fts_norm", max_normalised("fts_rank") if normalise else F.col("fts_rank"))
    return scaled.join(_weights(queries), "query_id").withColumn(
        "combined_score", weighted_sum(F.col("fts_norm"), F.col("semantic_similarity"))
    )


SCORES = ["fts_rank", "semantic_similarity", "combined_score"]


def _finish(fused, products, suppliers, size, default_limit):
    best = bt.top_k(fused, [F.desc("combined_score"), F.asc("id")], size, default_limit)
    best = best.select("query_id", "id", "rank_no", *SCORES)
    return bt.attach(best, products, suppliers, bt.PRODUCT_COLUMNS, size.small_hits(size.max_limit))


def search_hybrid_batch(
    products: DataFrame,
    suppliers: DataFrame,
    queries: DataFrame,
    result_limit: int = 50,
    similarity_threshold: float = THRESHOLD,
    config: str = "simple",
    variant: str = "current",
    long_texts: bool = False,
) -> DataFrame:
    """Hybrid search for a table of queries.

    Each branch is cut to the query's limit before fusion; that cut is part of the result. Ranks are
    normalised by the largest rank of the fused list. ``variant`` keeps two earlier definitions for
    comparison: ``"unscaled"`` (no threshold, no normalising) and ``"single_scan"`` (one pass with OR,
    where the filters bind to the vector condition only).
    """
    queries = bt.complete(queries, bt.id_type(suppliers).simpleString())
    size = bt.measure(queries, result_limit)
    if variant == "single_scan":
        return _single_scan(products, suppliers, queries, size, result_limit, config, long_texts)
    if variant not in ("current", "unscaled"):
        raise ValueError(f"unknown variant {variant!r}")
    scaled = variant == "current"
    text = bt.top_k(
        text_hits(products, queries, size, config, long_texts), [F.desc("fts_rank"), F.asc("id")], size, result_limit
    )
    vector = semantic_top(products, queries, size, similarity_threshold if scaled else None, result_limit)
    return _finish(fuse(text, vector, queries, scaled), products, suppliers, size, result_limit)


def _single_scan(products, suppliers, queries, size, result_limit, config, long_texts):
    """Text matches ignore the filters; vector matches above 0.5 obey them; nothing is normalised.

    Both row sets are kept whole until the final top-k, as either score can lift a row.
    """
    open_filters = ("supplier_filter", "price_min", "price_max")
    unfiltered = queries.withColumns({c: F.lit(None).cast(queries.schema[c].dataType) for c in open_filters})
    text = text_hits(products, unfiltered, size, config).select("query_id", "id")
    near = vector_hits(products, queries, size, LEGACY_THRESHOLD, result_limit, prune=False).select("query_id", "id")
    either = text.unionByName(near).distinct()
    asks = parse_queries(queries, config).select("query_id", "query_embedding", "parsed")
    met = with_tokens(products, config).select("id", "embedding", "tokens").join(either, "id").join(asks, "query_id")
    ranked = with_rank(met, F.col("parsed.lexemes"), F.col("parsed.together"), "fts_rank", long_texts)
    sim = F.coalesce(cosine_similarity(F.col("embedding"), F.col("query_embedding")), F.lit(0.0))
    scored = ranked.select("query_id", "id", "fts_rank", bt.cosine_score(sim).alias("semantic_similarity"))
    fused = scored.join(_weights(queries), "query_id").withColumn(
        "combined_score", weighted_sum(F.col("fts_rank"), F.col("semantic_similarity"))
    )
    return _finish(fused, products, suppliers, size, result_limit)


def _weights(queries: DataFrame) -> DataFrame:
    """Weights per query; NULL and NaN fall back to the defaults."""

    def weight(name, default):
        return F.coalesce(F.when(~F.isnan(name), F.col(name)), F.lit(default)).alias(name)

    return queries.select(
        "query_id", "result_limit", weight("fts_weight", FTS_WEIGHT), weight("semantic_weight", SEMANTIC_WEIGHT)
    )


def search_hybrid(
    products: DataFrame,
    suppliers: DataFrame,
    search_text: str,
    query_embedding: list[float] | None = None,
    supplier_filter=None,
    price_min=None,
    price_max=None,
    fts_weight: float = FTS_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT,
    result_limit: int = 50,
    similarity_threshold: float = THRESHOLD,
    config: str = "simple",
    long_texts: bool = False,
) -> DataFrame:
    """Hybrid search for one query. Filters push to the scan; each branch ends in a k-row top list."""
    rows = optional_filters(products, supplier_filter, price_min, price_max)
    vector = None if query_embedding is None else [float(x) for x in query_embedding]
    one = bt.complete(single_query(products.sparkSession, search_text, vector), bt.id_type(suppliers).simpleString())
    one = one.withColumns({"fts_weight": F.lit(float(fts_weight)), "semantic_weight": F.lit(float(semantic_weight))})
    size = bt.BatchSize(1, 0, result_limit)
    query = parse(products.sparkSession, search_text, config)
    text = (
        ranked_matches(with_tokens(rows, config), query, "fts_rank", long_texts)
        .select(F.lit(0).cast("long").alias("query_id"), "id", "fts_rank")
        .orderBy(F.desc("fts_rank"), F.asc("id"))
        .limit(result_limit)
    )
    near = semantic_top(rows, one, size, similarity_threshold, result_limit)
    out = _finish(fuse(text, near, one), products, suppliers, size, result_limit)
    return out.drop("query_id", "rank_no").orderBy(F.desc("combined_score"), F.asc("id"))
