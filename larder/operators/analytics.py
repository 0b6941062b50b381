"""Back-office figures. The source system only plans these; the definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import set_similarity, trigram_codes
from larder.operators.batches import keep_above, keep_rows

# The order status path.
STATUS_PATH = [("pending", "confirmed"), ("confirmed", "shipped"), ("shipped", "delivered")]


def orders_per(orders: DataFrame, period: str) -> DataFrame:
    """Orders and value per day, week or month."""
    if period not in ("day", "week", "month"):
        raise ValueError("period must be day, week or month")
    return orders.groupBy(F.date_trunc(period, "created_at").alias("period")).agg(
        F.count("*").alias("n_orders"), F.sum("total").alias("value")
    )


def top_products(order_items: DataFrame, k: int = 10) -> DataFrame:
    sold = order_items.groupBy("product_id").agg(F.sum("qty").alias("qty"))
    return sold.orderBy(F.desc("qty"), F.asc("product_id")).limit(k)


def top_suppliers(order_items: DataFrame, k: int = 10) -> DataFrame:
    value = F.sum(F.col("unit_price") * F.col("qty"))
    sold = order_items.groupBy("supplier_name").agg(value.alias("value"))
    return sold.orderBy(F.desc("value"), F.asc("supplier_name")).limit(k)


def average_order_value(orders: DataFrame) -> DataFrame:
    return orders.agg(F.avg("total").alias("average_value"))


def kpi_row(orders: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """One row: orders, order value, users, products."""
    figures = orders.agg(F.count("*").alias("n_orders"), F.sum("total").alias("order_value"))
    return figures.withColumn("n_users", customers.agg(F.count("*")).scalar()).withColumn(
        "n_products", products.agg(F.count("*")).scalar()
    )


def recent_orders(orders: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Orders of the last ``days`` up to ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    return orders.where((F.col("created_at") > end - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= end))


def order_list(orders: DataFrame, order_items: DataFrame, status=None, since=None, until=None, hotel=None, supplier=None):
    """Orders by optional status, dates, hotel and supplier (any item of that supplier)."""
    if status is not None:
        orders = orders.where(F.col("status") == status)
    if since is not None:
        orders = orders.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        orders = orders.where(F.col("created_at") < F.lit(until).cast("timestamp"))
    if hotel is not None:
        orders = orders.where(F.col("delivery_hotel") == hotel)
    if supplier is not None:
        with_it = order_items.where(F.col("supplier_name") == supplier).select(F.col("order_id").alias("id"))
        orders = orders.join(with_it, "id", "left_semi")
    return orders


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def change_status(orders: DataFrame, changes: DataFrame, path=STATUS_PATH) -> DataFrame:
    """Requested changes (id, new_status) with ``accepted``: only steps along the path."""
    current = orders.select("id", F.col("status").alias("old_status"))
    step = F.array(*[F.lit(f"{a}>{b}") for a, b in path])
    wanted = F.concat_ws(">", "old_status", "new_status")
    return changes.join(current, "id", "left").withColumn("accepted", F.array_contains(step, wanted))


def supplier_product_counts(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """Every supplier with its number of products, zero included."""
    counts = products.groupBy("supplier_id").agg(F.count("*").alias("n"))
    named = suppliers.select(F.col("id").alias("supplier_id"), "name")
    return named.join(counts, "supplier_id", "left").select(
        "supplier_id", "name", F.coalesce("n", F.lit(0)).alias("n_products")
    )


def _bounded_members(products: DataFrame, k: int) -> DataFrame:
    """Per text, the products that can appear in anyone's list: k per supplier, then 2k over all.

    Leaving out any one supplier still leaves that text's first k other products among them.
    """
    per_supplier = Window.partitionBy("description", "supplier_id").orderBy("id")
    per_text = Window.partitionBy("description").orderBy("id")
    rows = products.select("description", "supplier_id", "id")
    few = rows.withColumn("n", F.row_number().over(per_supplier)).where(F.col("n") <= k)
    return few.withColumn("n", F.row_number().over(per_text)).where(F.col("n") <= 2 * k).drop("n")


def similar_texts(products: DataFrame, threshold: float) -> DataFrame:
    """(text_a, text_b, similarity) over distinct descriptions above the threshold, itself included.

    Both sides are reduced to their rarest trigrams first: two texts above the threshold must share
    one of them. Copies of a text were folded before, so they make no pairs.
    """
    texts = products.select("description").distinct().withColumn("grams", trigram_codes(F.col("description")))
    # outer explodes, as plain ones make Spark infer filters that compute the trigrams again
    df = texts.select(F.explode_outer("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    weighed = (
        texts.select("description", F.explode_outer("grams").alias("gram"))
        .join(df, "gram")
        .groupBy("description")
        .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("w"))
        .select("description", F.transform("w", lambda s: s["gram"]).alias("ordered"))
    )
    n = F.size("ordered")
    lead = weighed.withColumn("lead", F.slice("ordered", F.lit(1), n - F.floor(F.lit(threshold) * n + 1e-9).cast("int")))
    opened = lead.select("description", "ordered", "lead", n.alias("n"), F.posexplode("lead").alias("i", "gram"))
    columns = ("description", "ordered", "lead", "n", "i")
    a = opened.select("gram", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = opened.select("gram", *[F.col(c).alias(f"{c}_b") for c in columns])
    na, nb = F.col("n_a"), F.col("n_b")
    # from the first shared trigram on, no more can be shared than what is left of the shorter rest
    left = F.least(na - F.col("i_a"), nb - F.col("i_b"))
    enough = left >= (na + nb) * (threshold / (1 + threshold)) - 1e-9
    first = F.get(F.filter("lead_a", lambda g: F.array_contains(F.col("lead_b"), g)), F.lit(0))
    near = set_similarity(F.col("ordered_a"), F.col("ordered_b"))
    met = a.join(b, "gram").where((na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9)).where(enough)
    kept = keep_above(keep_rows(met, F.col("gram") == first), near, "similarity", threshold)
    return kept.select(F.col("description_a").alias("text_a"), F.col("description_b").alias("text_b"), "similarity")


def compare_suppliers(products: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """For every product, its k most similar products of other suppliers.

    Works on distinct texts: each text gets one list of at most 2k candidates, and a product takes
    the first k of its text's list that another supplier sells.
    """
    members = _bounded_members(products, k)
    pairs = similar_texts(products, threshold)
    reach = pairs.join(members.withColumnRenamed("description", "text_b"), "text_b")
    order = [F.desc("similarity"), F.asc("id")]
    per_supplier = Window.partitionBy("text_a", "supplier_id").orderBy(*order)
    per_text = Window.partitionBy("text_a").orderBy(*order)
    lists = (
        reach.withColumn("n", F.row_number().over(per_supplier))
        .where(F.col("n") <= k)
        .withColumn("n", F.row_number().over(per_text))
        .where(F.col("n") <= 2 * k)
        .groupBy(F.col("text_a").alias("description"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "id", "supplier_id", "similarity"))).alias("candidates"))
    )
    own = F.col("supplier_id")
    chosen = F.slice(F.filter("candidates", lambda c: c["supplier_id"] != own), 1, k)
    return (
        products.select("id", "supplier_id", "description")
        .join(lists, "description")
        .select("id", F.posexplode(chosen).alias("place", "c"))
        .select("id", (F.col("place") + 1).alias("place"), F.col("c.id").alias("other_id"), F.col("c.similarity").alias("similarity"))
    )


def users_overview(customers: DataFrame, last_access: DataFrame) -> DataFrame:
    """Customers with hotel, registration and last access (auth_user_id, ts rows)."""
    seen = last_access.groupBy("auth_user_id").agg(F.max("ts").alias("last_access"))
    return customers.join(seen, "auth_user_id", "left").select(
        F.col("id").alias("customer_id"), "hotel_name", F.col("created_at").alias("registered"), "last_access"
    )


def inactive_accounts(overview: DataFrame, cutoff) -> DataFrame:
    """Accounts whose last access, or registration if never seen, lies before the cutoff."""
    return overview.where(F.coalesce("last_access", "registered") < F.lit(cutoff).cast("timestamp"))


def export_customer(customer_id, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Everything stored about one customer, per table."""
    own = {"customers": tables["customers"].where(F.col("id") == F.lit(customer_id))}
    for name in ("orders", "cart_sessions", "chat_messages"):
        if name in tables:
            own[name] = tables[name].where(F.col("customer_id") == F.lit(customer_id))
    if "orders" in own and "order_items" in tables:
        ids = own["orders"].select(F.col("id").alias("order_id"))
        own["order_items"] = tables["order_items"].join(ids, "order_id", "left_semi")
    return own
