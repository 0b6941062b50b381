"""Order pricing: validate requests, price them from the product table, split accepted and rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 100
FIRST_STATUS = "pending"
ITEMS = "array<struct<product_id: string, qty: string>>"

# Reject reasons, item reasons in the order they are checked.
ITEM_REASONS = ["qty_not_integer", "qty_invalid", "product_not_found", "product_without_price"]


@dataclass(frozen=True)
class OrderBatch:
    """Lazy outputs of one pricing run."""

    orders: DataFrame
    order_items: DataFrame
    rejects: DataFrame
    summary: DataFrame


def item_lines(requests: DataFrame) -> DataFrame:
    """One row per requested item, in order; only for requests of an acceptable length."""
    items = F.from_json("items", ITEMS)
    fit = requests.select("request_id", items.alias("parsed")).where(F.size("parsed").between(1, MAX_ITEMS))
    return fit.select("request_id", F.posexplode("parsed").alias("pos", "item")).select(
        "request_id", "pos", F.col("item.product_id").alias("product_ref"), F.col("item.qty").alias("qty_text")
    )


def checked_lines(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Item lines with their product and the number of the first failed check (0 = fine).

    Products are unique on the join side, so a product in a third of all lines is a skewed probe
    side, which AQE splits.
    """
    ref_type = products.schema["id"].dataType
    lines = item_lines(requests).withColumn("product_id", F.col("product_ref").try_cast(ref_type))
    goods = products.select(
        F.col("id").alias("product_id"), "supplier_id", "supplier_code", "description", "selling_uom", "price",
        F.lit(True).alias("_known"),
    )
    qty = F.col("qty_text").try_cast("int")
    failed = (
        F.when(F.col("qty_text").isNotNull() & qty.isNull(), 1)
        .when(qty.isNull() | (qty < 1), 2)
        .when(F.col("_known").isNull(), 3)
        .when(F.col("price").isNull(), 4)
        .otherwise(0)
    )
    return lines.join(goods, "product_id", "left").withColumns({"qty": qty, "failed": failed}).drop("_known")


def _reason(check: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in ITEM_REASONS]), check)


def priced_requests(requests: DataFrame, customers: DataFrame, lines: DataFrame) -> DataFrame:
    """Every request with its customer, total and reject reason (NULL = accepted)."""
    amount = F.col("price").cast("decimal(10,2)") * F.col("qty")
    totals = lines.groupBy("request_id").agg(
        F.sum(F.when(F.col("failed") == 0, amount)).alias("sum"),
        F.min(F.when(F.col("failed") > 0, F.struct("pos", "failed"))).alias("bad"),
    )
    buyers = customers.select(
        F.col("id").alias("customer_id"), "auth_user_id", "hotel_name", "hotel_address", "company_name",
        "vat_number", "contact_person", "phone",
    )
    known = requests.join(buyers, "auth_user_id", "left").join(totals, "request_id", "left")
    n = F.coalesce(F.size(F.from_json("items", ITEMS)), F.lit(0))
    total = F.col("sum").try_cast("decimal(10,2)")
    reason = (
        F.when(F.col("customer_id").isNull(), "customer_not_found")
        .when(n <= 0, "no_items")
        .when(n > MAX_ITEMS, "too_many_items")
        .when(F.col("bad").isNotNull(), _reason(F.col("bad.failed")))
        .when(total.isNull(), "total_overflow")
    )
    return known.withColumns({"total": total, "reason": reason})


def price_orders(
    requests: DataFrame,
    products: DataFrame,
    suppliers: DataFrame,
    customers: DataFrame,
    order_number: Column | None = None,
) -> OrderBatch:
    """Price a table of order requests (request_id, auth_user_id, items as JSON).

    Prices always come from ``products``. The first failing check rejects a whole request. The order
    id is the request id; pass ``order_number`` to choose a number format.
    """
    number = order_number if order_number is not None else F.col("request_id").cast("string")
    lines = checked_lines(requests, products)
    priced = priced_requests(requests, customers, lines)
    accepted = priced.where(F.col("reason").isNull())

    def text(name, alias):
        return F.coalesce(F.col(name), F.lit("")).alias(alias)

    orders = accepted.select(
        F.col("request_id").alias("id"),
        number.alias("order_number"),
        "customer_id",
        "total",
        text("hotel_name", "delivery_hotel"),
        text("hotel_address", "delivery_address"),
        text("company_name", "billing_company"),
        text("vat_number", "billing_vat"),
        text("contact_person", "contact_person"),
        text("phone", "contact_phone"),
        F.lit(FIRST_STATUS).alias("status"),
    )
    names = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    items = (
        lines.join(accepted.select("request_id"), "request_id", "left_semi")
        .join(names, "supplier_id")
        .select(
            F.col("request_id").alias("order_id"), "pos", "product_id", "supplier_code", "description",
            "supplier_name", "selling_uom", F.col("price").cast("decimal(10,2)").alias("unit_price"), "qty",
        )
    )
    rejects = priced.where(F.col("reason").isNotNull()).select("request_id", "reason")
    summary = orders.select(F.col("id").alias("order_id"), "order_number", "total")
    return OrderBatch(orders, items, rejects, summary)
