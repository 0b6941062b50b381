"""Typo-tolerant search by trigram set similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import letters_in, set_similarity, trigram_codes
from larder.operators import batches as bt

THRESHOLD = 0.2


def search_fuzzy(
    products: DataFrame,
    suppliers: DataFrame,
    search_query: str,
    similarity_threshold: float = THRESHOLD,
    result_limit: int = 50,
) -> DataFrame:
    """Products whose whole description is more similar than the threshold, for one query."""
    near = set_similarity(F.col("_grams"), trigram_codes(F.lit(search_query)))
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    rows = products.withColumn("_grams", trigram_codes(F.col("description")))
    return (
        bt.keep_above(rows, near, "similarity", similarity_threshold)
        .join(names, "supplier_id")
        .select("id", "supplier_name", *bt.PRODUCT_COLUMNS, "similarity")
        .orderBy(F.desc("similarity"), F.asc("id"))
        .limit(result_limit)
    )


def trigram_frequencies(products: DataFrame, text: str = "description") -> DataFrame:
    """Texts per trigram, counted on the map side first; optional input of the batch search."""
    return products.select(F.explode(trigram_codes(F.col(text))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def lookup_grams(queries: DataFrame, threshold: float, frequencies: DataFrame | None) -> DataFrame:
    """The rarest trigrams of each query that a similar text cannot avoid sharing.

    Similarity above t means more than t * n shared trigrams of the query's n, so every result holds
    at least one of any n - floor(t * n) of them. Looking up only the rarest ones is exact and skips
    the commonest. Without ``frequencies``, word starts and ends count as the commoner trigrams.
    """
    asks = queries.withColumn("grams", trigram_codes(F.col("search_text"))).where(F.size("grams") > 0)
    if frequencies is None:
        order = F.transform(
            "grams", lambda g: F.struct(letters_in(g).alias("w"), g.alias("gram"))
        )
        rare = F.transform(F.reverse(F.array_sort(order)), lambda s: s["gram"])
        asks = asks.withColumn("ordered", rare)
    else:
        weighed = (
            asks.select("query_id", F.explode("grams").alias("gram"))
            .join(frequencies, "gram", "left")
            .groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("w"))
            .select("query_id", F.transform("w", lambda s: s["gram"]).alias("ordered"))
        )
        asks = asks.join(weighed, "query_id")
    n = F.size("grams")
    # the small allowance keeps a product such as 0.2 * 15 from rounding up past its true floor
    need = n - F.floor(F.lit(threshold) * n + 1e-9).cast("int")
    return asks.withColumn("probe", F.slice("ordered", F.lit(1), need)).drop("ordered")


def fuzzy_hits(
    products: DataFrame, queries: DataFrame, size: bt.BatchSize, threshold: float, frequencies: DataFrame | None
) -> DataFrame:
    """(query_id, id, similarity) of every product above the threshold."""
    asks = lookup_grams(queries, threshold, frequencies).select(
        "query_id", "result_limit", F.col("grams").alias("q_grams"), "probe", F.explode("probe").alias("gram")
    )
    rows = products.select("id", trigram_codes(F.col("description")).alias("p_grams"))
    # the outer form: for a plain explode Spark infers a filter that computes the trigrams again
    opened = rows.select("*", F.explode_outer("p_grams").alias("gram"))
    n_p, n_q = F.size("p_grams"), F.size("q_grams")
    # sizes too far apart cannot reach the threshold
    fits = (n_p >= threshold * n_q - 1e-9) & (n_q >= threshold * n_p - 1e-9)
    if size.small_fan:
        met = opened.join(F.broadcast(asks), "gram").where(fits)
    else:
        keys = asks.select("query_id", "gram")
        pairs = opened.select("id", "gram").join(keys, "gram")
        met = rows.join(pairs, "id").join(asks, ["query_id", "gram"]).where(fits)
    # a pair meets at every shared lookup trigram: keep it at one of them, the smallest
    first = F.array_min(F.array_intersect("probe", "p_grams"))
    near = set_similarity(F.col("p_grams"), F.col("q_grams"))
    met = bt.keep_above(bt.keep_rows(met, F.col("gram") == first), near, "similarity", threshold)
    return met.select("query_id", "id", "result_limit", "similarity")


def search_fuzzy_batch(
    products: DataFrame,
    suppliers: DataFrame,
    queries: DataFrame,
    similarity_threshold: float = THRESHOLD,
    result_limit: int = 50,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Trigram search for a table of queries; needs a threshold of 0 or more."""
    if similarity_threshold < 0:
        raise ValueError("similarity_threshold must not be negative for a table of queries")
    queries = bt.complete(queries)
    size = bt.measure(queries, result_limit)
    hits = fuzzy_hits(products, queries, size, similarity_threshold, frequencies)
    best = bt.top_k(hits, [F.desc("similarity"), F.asc("id")], size, result_limit).select(
        "query_id", "id", "rank_no", "similarity"
    )
    return bt.attach(best, products, suppliers, bt.PRODUCT_COLUMNS, size.small_hits(size.max_limit))
