"""Query tables: defaults, size checks, per-query filters and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.filters import filters_of_row

DIGITS, COSINE_SCALE = 10, 1e10
MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 16 << 20
MAX_FAN_BYTES = 128 << 20
MAX_BROADCAST_HITS = 1_000_000

_DEFAULTS = {
    "search_text": "string",
    "query_embedding": "array<float>",
    "price_min": "double",
    "price_max": "double",
    "fts_weight": "double",
    "semantic_weight": "double",
    "result_limit": "int",
}


def complete(queries: DataFrame, supplier_type: str = "string") -> DataFrame:
    """Add the optional columns a query table may leave out, as NULL."""
    missing = {k: F.lit(None).cast(v) for k, v in _DEFAULTS.items() if k not in queries.columns}
    if "supplier_filter" not in queries.columns:
        missing["supplier_filter"] = F.lit(None).cast(supplier_type)
    return queries.withColumns(missing) if missing else queries


@dataclass(frozen=True)
class BatchSize:
    """Measured size of a query table; decides between broadcast and shuffle plans."""

    n: int
    text_bytes: int
    max_limit: int
    fan_bytes: int = 0
    vector_bytes: int = 0

    @property
    def small(self) -> bool:
        return self.n <= MAX_BROADCAST_QUERIES and self.text_bytes <= MAX_BROADCAST_BYTES

    @property
    def small_fan(self) -> bool:
        """Whether rows per word or trigram that each carry their whole query are small enough to broadcast."""
        return self.small and self.fan_bytes <= MAX_FAN_BYTES

    def small_hits(self, per_query: int) -> bool:
        return self.n * per_query <= MAX_BROADCAST_HITS


def measure(queries: DataFrame, default_limit: int) -> BatchSize:
    """One small aggregate over the query table: five numbers reach the driver."""
    length = F.octet_length(F.coalesce("search_text", F.lit(""))).cast("long")
    row = queries.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(length), F.lit(0)).alias("b"),
        F.coalesce(F.sum(length * length * 8), F.lit(0)).alias("f"),
        F.max(F.coalesce("result_limit", F.lit(default_limit))).alias("k"),
        F.coalesce(F.sum(F.when(F.col("query_embedding").isNotNull(), F.size("query_embedding").cast("long") * 8)), F.lit(0)).alias("v"),
    ).first()
    return BatchSize(row["n"], row["b"], row["k"] if row["k"] is not None else default_limit, row["f"], row["v"])


def score(c: Column) -> Column:
    """A rank or fused score at ten significant digits, however small it is.

    Sums in another order differ in the last bits; at ten digits such scores still tie and the id decides, while a rank
    of 1e-20 stays what it is. The lambda computes ``c`` once.
    """

    def digits(x):
        power = F.pow(F.lit(10.0), DIGITS - 1 - F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, x).otherwise(F.floor(x * power + 0.5) / power)

    return F.transform(F.array(c.cast("double")), digits)[0]


def cosine_score(c: Column) -> Column:
    """A cosine at ten decimals: its error does not shrink with its size."""
    return F.floor(c * COSINE_SCALE + 0.5) / COSINE_SCALE


def top_k(hits: DataFrame, order: list[Column], size: BatchSize, default_limit: int) -> DataFrame:
    """Best rows of every query, with the place in ``rank_no``.

    The literal bound lets Spark prune to k rows per query inside each input partition, before the
    shuffle, so a query that matches most of the table does not move its hits.
    """
    best = Window.partitionBy("query_id").orderBy(*order)
    ranked = hits.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= size.max_limit)
    if "result_limit" in hits.columns:
        ranked = ranked.where(F.col("rank_no") <= F.coalesce("result_limit", F.lit(default_limit)))
    return ranked


def keep_rows(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter by a condition with lambdas, kept above the step that made its columns.

    The optimizer would push such a condition into a join, which takes the join and the explode below
    it out of generated code, or through a projection, which repeats the projected expression inside
    the lambdas. As a generator of zero or one rows it stays where it is.
    """
    return rows.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def keep_above(rows: DataFrame, value: Column, name: str, threshold: float) -> DataFrame:
    """Add a costly score once and keep the rows where it is above the threshold."""
    return rows.select("*", F.explode(F.filter(F.array(value), lambda s: s > threshold)).alias(name))


def query_filter() -> Column:
    """Supplier and price filters of a query row; NULL parameter means no filter."""
    return filters_of_row(["supplier_filter", "price_min", "price_max"])


def attach(hits: DataFrame, products: DataFrame, suppliers: DataFrame, columns: list[str], bounded: bool):
    """Join the wide product columns to the few surviving hits, then the supplier name.

    ``bounded`` says the hit count was checked against MAX_BROADCAST_HITS; otherwise Spark shuffles.
    """
    wide = products.select("id", "supplier_id", *columns)
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    few = F.broadcast(hits) if bounded else hits
    return wide.join(few, "id").join(names, "supplier_id").drop("supplier_id")


PRODUCT_COLUMNS = ["supplier_code", "description", "selling_uom", "pricing_uom", "price"]


def id_type(products: DataFrame, column: str = "id") -> T.DataType:
    return products.schema[column].dataType
