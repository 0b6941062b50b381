"""Optional filters, supplier lookup by name and clean-up of request parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import number, strip


# Parameter, product column and comparison of every optional filter.
FILTERS = [
    ("supplier_filter", "supplier_id", "="),
    ("category_filter", "category_id", "="),
    ("price_min", "price", ">="),
    ("price_max", "price", "<="),
]


def compared(column: Column, sign: str, value: Column) -> Column:
    return {"=": column == value, ">=": column >= value, "<=": column <= value}[sign]


def optional_filters(products: DataFrame, supplier=None, price_min=None, price_max=None, category=None) -> DataFrame:
    """Equality and inclusive price filters; only the given ones enter the plan, so they push down."""
    given = {"supplier_filter": supplier, "category_filter": category, "price_min": price_min, "price_max": price_max}
    for name, column, sign in FILTERS:
        if given[name] is not None:
            products = products.where(compared(F.col(column), sign, F.lit(given[name])))
    return products


def filters_of_row(names: list[str]) -> Column:
    """The named filters as a condition on rows that carry their parameters; a NULL parameter filters nothing."""
    kept = F.lit(True)
    for name, column, sign in FILTERS:
        if name in names:
            kept = kept & (F.col(name).isNull() | compared(F.col(column), sign, F.col(name)))
    return kept


def filters_as_sql(table: str) -> str:
    """All filters as a SQL condition on a table's alias."""
    return " AND ".join(f"({name} IS NULL OR {table}.{column} {sign} {name})" for name, column, sign in FILTERS)


def with_embedding(products: DataFrame) -> DataFrame:
    return products.where(F.col("embedding").isNotNull())


def consumer_columns(results: DataFrame, *extra: str) -> DataFrame:
    """The seven fields an assistant needs from a search result."""
    return results.select(
        *extra, "id", "description", "supplier_name", "supplier_code", "price", "selling_uom", "combined_score"
    )


_GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))

    def runs(n):
        return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, _GRAM + 1)]))


def resolve_supplier(queries: DataFrame, suppliers: DataFrame, strict: bool = False) -> DataFrame:
    """Turn the free ``supplier`` text of each query into ``supplier_filter``.

    The text is a literal, case-insensitive part of the name. Of several matches the first by name
    and id wins. No match leaves the query unfiltered, as a search should still answer; with
    ``strict`` such queries get ``supplier_missing = true`` and are meant to return nothing.

    The last letters of the text are looked up in the short substrings of the names, so this is an
    equi-join and not a scan of every supplier per query.
    """
    id_type = suppliers.schema["id"].dataType
    asked = (
        queries.where(F.length("supplier") > 0)
        .select(F.lower("supplier").alias("wanted"))
        .distinct()
        .withColumn("gram", F.substring("wanted", F.greatest(F.length("wanted") - (_GRAM - 1), F.lit(1)), F.lit(_GRAM)))
    )
    named = suppliers.select("id", "name", F.explode(_grams(F.col("name"))).alias("gram"))
    found = (
        named.join(asked, "gram")
        .where(F.contains(F.lower("name"), F.col("wanted")))
        .groupBy("wanted")
        .agg(F.min(F.struct("name", "id"))["id"].alias("supplier_filter"))
    )
    out = (
        queries.drop("supplier_filter")
        .withColumn("wanted", F.lower("supplier"))
        .join(found, "wanted", "left")
        .drop("wanted")
        .withColumn("supplier_filter", F.col("supplier_filter").cast(id_type))
    )
    if strict:
        asked_for = F.coalesce(F.length("supplier") > 0, F.lit(False))
        out = out.withColumn("supplier_missing", asked_for & F.col("supplier_filter").isNull())
    return out


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _number(c: Column) -> Column:
    """A finite or infinite number, else NULL (text and NaN)."""
    d = number(c.cast("string"))
    return F.when(~F.isnan(d), d)


# Request defaults and limits.
LIMIT_DEFAULT, LIMIT_MAX, QUERY_MAX, CHAT_MAX = 20, 100, 500, 2000
FTS_WEIGHT, SEMANTIC_WEIGHT = 0.4, 0.6


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalise_queries(raw: DataFrame) -> DataFrame:
    """Clean a table of search requests whose fields arrive as text.

    Adds ``reject`` (NULL when the request is fine). Limits clamp to 1..100 with 20 for 0, text and
    NaN; weights clamp to 0..1 with the defaults for NULL and NaN; prices must be numbers.
    """
    limit, fts, sem = _number(F.col("limit")), _number(F.col("fts_weight")), _number(F.col("semantic_weight"))

    def not_number(name):
        text = F.col(name).cast("string")
        return text.isNotNull() & (F.lower(strip(text)) != "nan") & _number(F.col(name)).isNull()

    reject = (
        F.when(F.coalesce(F.length("query"), F.lit(0)) == 0, "query_missing")
        .when(utf16_length(F.col("query")) > QUERY_MAX, "query_too_long")
        .when(F.col("price_min").isNotNull() & _number(F.col("price_min")).isNull(), "price_min_not_number")
        .when(F.col("price_max").isNotNull() & _number(F.col("price_max")).isNull(), "price_max_not_number")
        .when(not_number("fts_weight") | not_number("semantic_weight"), "weight_not_number")
    )
    return raw.select(
        "query_id",
        F.col("query").alias("search_text"),
        *[c for c in ("supplier", "query_embedding") if c in raw.columns],
        _number(F.col("price_min")).alias("price_min"),
        _number(F.col("price_max")).alias("price_max"),
        clamp(F.coalesce(F.nullif(limit, F.lit(0.0)), F.lit(float(LIMIT_DEFAULT))), 1.0, float(LIMIT_MAX))
        .cast("int")
        .alias("result_limit"),
        clamp(F.coalesce(fts, F.lit(FTS_WEIGHT)), 0.0, 1.0).alias("fts_weight"),
        clamp(F.coalesce(sem, F.lit(SEMANTIC_WEIGHT)), 0.0, 1.0).alias("semantic_weight"),
        reject.alias("reject"),
    )


def normalise_chat_requests(raw: DataFrame) -> DataFrame:
    """Trim chat input and session id; blank or over-long requests get a ``reject`` reason."""
    text, session = F.trim("chat_input"), F.trim("session_id")
    reject = (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "input_missing")
        .when(utf16_length(F.col("chat_input")) > CHAT_MAX, "input_too_long")
        .when(F.coalesce(F.length(session), F.lit(0)) == 0, "session_missing")
    )
    return raw.withColumns({"chat_input": text, "session_id": session, "reject": reject})
