"""Full-text search: text index, match, rank and top-k for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as tx
from larder.functions.postings import posting_batches
from larder.functions.websearch import PARSED, WebQuery, read_query
from larder.operators import batches as bt
from larder.operators.filters import optional_filters

EVERY_TEXT = ""


def with_tokens(products: DataFrame, config: str = "simple") -> DataFrame:
    """Add the text index column, unless the table already stores it."""
    if "tokens" in products.columns:
        return products
    return products.withColumn("tokens", tx.tokens(F.col("description"), config))


def located(products: DataFrame, config: str = "simple", limits: bool = False) -> DataFrame:
    """lexeme, id and positions of every lexeme of every text; see ``posting_batches`` for ``limits``.

    ``id`` is the key of the table, so a (lexeme, id) group is one product text and is found where the text is read:
    no word is shuffled.
    """
    id_type = products.schema["id"].dataType.simpleString()
    return with_tokens(products, config).select("id", "tokens").mapInArrow(posting_batches(limits), f"lexeme string, id {id_type}, at array<int>")


def postings(products: DataFrame, config: str = "simple") -> DataFrame:
    """The inverted index in long form: one row per (lexeme, id) with its positions, without a shuffle."""
    return located(products, config, limits=True).withColumnRenamed("at", "positions")


def lexeme_stats(products: DataFrame, config: str = "simple") -> DataFrame:
    """Texts and occurrences per lexeme.

    Every text opens its tokens and then once more its distinct ones, so both counts come from one
    aggregate whose map side shrinks the rows to the vocabulary of a partition.
    """
    n = F.size("tokens").alias("n")
    both = F.posexplode(F.concat(F.col("tokens"), F.array_distinct("tokens"))).alias("i", "lexeme")
    opened = with_tokens(products, config).select(n, both).where(F.col("lexeme") != "")
    again = (F.col("i") >= F.col("n")).cast("long")
    return opened.groupBy("lexeme").agg(F.sum(again).alias("n_texts"), F.sum(1 - again).alias("n_occurrences"))


def parse(spark: SparkSession, text: str | None, config: str = "simple") -> WebQuery:
    stops = tx.italian_stop_words(spark) if config == "italian" else frozenset()
    return read_query(text, config, stops)


def parse_queries(queries: DataFrame, config: str = "simple") -> DataFrame:
    """Add ``parsed`` to a query table: its clauses, distinct lexemes and top operator."""
    stops = tx.italian_stop_words(queries.sparkSession) if config == "italian" else frozenset()
    reader = F.udf(lambda t: read_query(t, config, stops).as_row(), PARSED)
    return queries.withColumn("parsed", reader("search_text"))


def match_column(query: WebQuery, toks: Column | str = "tokens") -> Column:
    """One parsed query as a plain predicate over the token array."""
    toks = F.col(toks) if isinstance(toks, str) else toks

    def hit(phrase):
        if len(phrase) == 1:
            return F.array_contains(toks, F.lit(phrase[0][0]))
        words = F.array(*[F.struct(F.lit(w).alias("lexeme"), F.lit(i).alias("offset")) for w, i in phrase])
        return tx.phrase_match(toks, words)

    found = F.lit(False)
    for clause in query.clauses:
        both = F.lit(True)
        for p in clause.required:
            both = both & hit(p)
        for p in clause.excluded:
            both = both & ~hit(p)
        found = found | both
    return found


def with_rank(
    hits: DataFrame, lexemes: Column, together: Column, name: str, long_texts: bool = False
) -> DataFrame:
    """Add the relevance rank of ``tokens``; positions become a column first, as the rank reuses them.

    Short texts are ranked by expressions in the JVM. Set ``long_texts`` where a lexeme occurs hundreds
    of times per text: the pairs of positions are then counted on Arrow batches.
    """
    located = hits.withColumn("_spots", F.transform(lexemes, lambda w: tx.positions(F.col("tokens"), w)))
    rank = tx.rank_long_texts if long_texts else tx.rank_from_positions
    # the count reads the new column too: used twice, it stays a column and is not inlined
    rank = rank(F.col("_spots"), F.size("_spots"), together)
    return located.withColumn(name, bt.score(rank)).drop("_spots")


def ranked_matches(products: DataFrame, query: WebQuery, name: str = "rank", long_texts: bool = False) -> DataFrame:
    """Products matching one query, ranked row by row: no join and no shuffle."""
    hits = bt.keep_rows(products, match_column(query))
    lexemes = F.array(*[F.lit(w) for w in query.lexemes]) if query.lexemes else F.array(F.lit(""))
    return with_rank(hits, lexemes, F.lit(query.together), name, long_texts)


def search_fts(
    products: DataFrame,
    suppliers: DataFrame,
    search_query: str,
    supplier_filter=None,
    price_min=None,
    price_max=None,
    result_limit: int = 50,
    config: str = "simple",
    long_texts: bool = False,
) -> DataFrame:
    """Full-text search for one query, best rank first, ties by id."""
    query = parse(products.sparkSession, search_query, config)
    rows = optional_filters(products, supplier_filter, price_min, price_max)
    hits = ranked_matches(with_tokens(rows, config), query, "rank", long_texts).select(
        "id", "supplier_id", *bt.PRODUCT_COLUMNS, "rank"
    )
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    return (
        hits.join(names, "supplier_id")
        .select("id", "supplier_name", *bt.PRODUCT_COLUMNS, "rank")
        .orderBy(F.desc("rank"), F.asc("id"))
        .limit(result_limit)
    )


def text_hits(
    products: DataFrame, queries: DataFrame, size: bt.BatchSize, config: str, long_texts: bool = False
) -> DataFrame:
    """(query_id, id, fts_rank) of every match of every query.

    Each clause is looked up by one anchor lexeme only; the rest of the clause, the filters and the
    rank are evaluated inside the product row. A small query table is broadcast and products never
    move. A large one first finds (query, clause, id) from narrow rows, where AQE splits a hot
    lexeme, and then meets the product rows again by id.
    """
    asks = parse_queries(queries, config).select(
        "query_id", "result_limit", "supplier_filter", "price_min", "price_max", "parsed",
        F.posexplode("parsed.clauses").alias("clause_no", "clause"),
    ).withColumn("anchor", F.col("clause.anchor"))
    rows = with_tokens(products, config).select("id", "supplier_id", "price", "tokens")
    anchors = F.explode(F.array_union(F.col("tokens"), F.array(F.lit(EVERY_TEXT)))).alias("anchor")
    if size.small_fan:
        met = rows.select("*", anchors).join(F.broadcast(asks), "anchor")
    else:
        keys = asks.select("anchor", "query_id", "clause_no")
        found = rows.select("id", anchors).join(keys, "anchor").drop("anchor")
        met = rows.join(found, "id").join(asks.drop("anchor"), ["query_id", "clause_no"])
    matched = F.transform("parsed.clauses", lambda c: tx.clause_match(F.col("tokens"), c))
    # several clauses of one query may match a row: keep it at the first only
    first = F.array_position(matched, F.lit(True)) == F.col("clause_no") + 1
    hits = bt.keep_rows(met.where(bt.query_filter()), first)
    ranked = with_rank(hits, F.col("parsed.lexemes"), F.col("parsed.together"), "fts_rank", long_texts)
    return ranked.select("query_id", "id", "fts_rank", "result_limit")


def search_fts_batch(
    products: DataFrame,
    suppliers: DataFrame,
    queries: DataFrame,
    result_limit: int = 50,
    config: str = "simple",
    long_texts: bool = False,
) -> DataFrame:
    """Full-text search for a table of queries (query_id, search_text and optional filters, limits)."""
    queries = bt.complete(queries, bt.id_type(suppliers).simpleString())
    size = bt.measure(queries, result_limit)
    best = bt.top_k(
        text_hits(products, queries, size, config, long_texts), [F.desc("fts_rank"), F.asc("id")], size, result_limit
    ).select("query_id", "id", "rank_no", F.col("fts_rank").alias("rank"))
    return bt.attach(best, products, suppliers, bt.PRODUCT_COLUMNS, size.small_hits(size.max_limit))
