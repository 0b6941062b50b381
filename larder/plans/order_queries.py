"""Registered queries over order pricing and row visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.access import contracted_products, visible_counts, visible_rows, visible_to, write_check
from larder.operators.orders import OrderBatch, price_orders
from larder.plans.registry import query
from larder.plans.views import Views


def batch(v: Views) -> OrderBatch:
    return price_orders(v.order_requests(), v.products(), v.suppliers(), v.customers())


@query("order_pricing", """
SELECT request_id AS id, CAST(request_id AS VARCHAR) AS order_number, customer_id, CAST(total AS DOUBLE) AS total,
  hotel_name AS delivery_hotel, hotel_address AS delivery_address, company_name AS billing_company,
  coalesce(vat_number, '') AS billing_vat, contact_person, coalesce(phone, '') AS contact_phone, 'pending' AS status
FROM v_priced WHERE reason IS NULL""")
def order_pricing(v: Views) -> DataFrame:
    return batch(v).orders


@query("order_items", """
SELECT c.request_id AS order_id, pos, c.product_id, supplier_code, description, s.name AS supplier_name, selling_uom,
  CAST(price AS DOUBLE) AS unit_price, qty
FROM v_checked c JOIN v_priced p ON p.request_id = c.request_id AND p.reason IS NULL JOIN v_suppliers s ON s.id = c.supplier_id""")
def order_items(v: Views) -> DataFrame:
    return batch(v).order_items


@query("order_rejects", "SELECT request_id, reason FROM v_priced WHERE reason IS NOT NULL")
def order_rejects(v: Views) -> DataFrame:
    return batch(v).rejects


@query("order_summary", """SELECT request_id AS order_id, CAST(request_id AS VARCHAR) AS order_number, CAST(total AS DOUBLE) AS total
FROM v_priced WHERE reason IS NULL""")
def order_summary(v: Views) -> DataFrame:
    return batch(v).summary


def tables(v: Views) -> dict[str, DataFrame]:
    return {"customers": v.customers(), "orders": v.orders(), "order_items": v.order_items(),
            "chat_messages": v.chat(), "products": v.products(), "suppliers": v.suppliers()}


@query("visible_orders", """
SELECT p.auth_user_id AS principal, o.id FROM v_principals p JOIN v_customers c ON c.auth_user_id = p.auth_user_id
JOIN v_orders o ON o.customer_id = c.id WHERE p.role IS DISTINCT FROM 'admin'""")
def visible_orders(v: Views) -> DataFrame:
    return visible_rows("orders", tables(v), v.principals()).select("principal", "id")


@query("visible_order_items", """
SELECT p.auth_user_id AS principal, o.id AS order_id, i.line, i.product_id FROM v_principals p
JOIN v_customers c ON c.auth_user_id = p.auth_user_id JOIN v_orders o ON o.customer_id = c.id
JOIN v_order_items i ON i.order_id = o.id WHERE p.role IS DISTINCT FROM 'admin'""")
def visible_order_items(v: Views) -> DataFrame:
    out = visible_rows("order_items", tables(v), v.principals())
    return out.select("principal", "order_id", "line", "product_id")


@query("visible_to_one", "SELECT i.order_id, i.line, i.product_id FROM v_order_items i JOIN v_orders o ON o.id = i.order_id WHERE o.customer_id = 7")
def visible_to_one(v: Views) -> DataFrame:
    return visible_to("order_items", tables(v), 7, None).select("order_id", "line", "product_id")


@query("visible_to_admin", "SELECT id, customer_id FROM v_orders")
def visible_to_admin(v: Views) -> DataFrame:
    return visible_to("orders", tables(v), 7, "admin").select("id", "customer_id")


@query("visible_counts", """
SELECT p.auth_user_id, p.role, CASE WHEN p.role = 'admin' THEN (SELECT count(*) FROM v_orders) ELSE count(o.id) END AS n_visible
FROM v_principals p LEFT JOIN v_orders o ON o.customer_id = p.auth_user_id GROUP BY p.auth_user_id, p.role""")
def count_visible(v: Views) -> DataFrame:
    return visible_counts("orders", tables(v), v.principals())


@query("write_check", """
SELECT o.id, CASE WHEN delivery_hotel = '1-URGENT' THEN 3 ELSE o.customer_id END AS principal,
  coalesce(p.role = 'admin', false) OR coalesce(o.customer_id = CASE WHEN delivery_hotel = '1-URGENT' THEN 3 ELSE o.customer_id END, false) AS allowed
FROM v_orders o LEFT JOIN v_principals p ON p.auth_user_id = CASE WHEN delivery_hotel = '1-URGENT' THEN 3 ELSE o.customer_id END""")
def check_writes(v: Views) -> DataFrame:
    """Urgent orders are proposed by one other user, all others by their owner."""
    who = F.when(F.col("delivery_hotel") == "1-URGENT", F.lit(3).cast("long")).otherwise(F.col("customer_id"))
    out = write_check("orders", v.orders().withColumn("principal", who), tables(v), v.principals())
    return out.select("id", "principal", "allowed")


@query("write_check_update", "SELECT id, coalesce(role = 'admin', false) AS allowed FROM v_orders LEFT JOIN v_principals ON auth_user_id = customer_id")
def check_updates(v: Views) -> DataFrame:
    """Owners may not change an order once it is placed."""
    out = write_check("orders", v.orders().withColumn("principal", F.col("customer_id")), tables(v), v.principals(), "update")
    return out.select("id", "allowed")


@query("write_check_chat", """
asks AS (SELECT *, CASE WHEN created_at % 3 = 0 THEN 3 ELSE customer_id END AS principal FROM v_chat)
SELECT a.id, a.role, a.principal, coalesce(p.role = 'admin', false) OR coalesce(c.auth_user_id = a.principal, false) AS allowed
FROM asks a LEFT JOIN v_customers c ON c.id = a.customer_id LEFT JOIN v_principals p ON p.auth_user_id = a.principal""")
def check_chat(v: Views) -> DataFrame:
    """Messages of users and assistants, some proposed by another user; their role is not the writer's."""
    who = F.when(F.col("created_at") % 3 == 0, F.lit(3).cast("long")).otherwise(F.col("customer_id"))
    out = write_check("chat_messages", v.chat().withColumn("principal", who), tables(v), v.principals())
    return out.select("id", "role", "principal", "allowed")


@query("visible_catalogue", """
SELECT auth_user_id, role, (SELECT count(*) FROM v_products) AS n_visible FROM v_principals""")
def catalogue_counts(v: Views) -> DataFrame:
    """Everyone sees every product."""
    return visible_counts("products", {"products": v.products()}, v.principals())


TAKEOVER = """
asks AS (SELECT id, auth_user_id AS old, CASE WHEN id % 3 = 0 THEN auth_user_id ELSE auth_user_id + 1 END AS new,
    CASE WHEN id % 2 = 0 THEN auth_user_id ELSE auth_user_id + 1 END AS principal FROM v_customers)"""


def takeovers(v: Views) -> DataFrame:
    """Customers whose user is changed, by the user before or by the one after."""
    user = F.col("auth_user_id")
    return v.customers().withColumns({
        "auth_user_id": F.when(F.col("id") % 3 == 0, user).otherwise(user + 1),
        "principal": F.when(F.col("id") % 2 == 0, user).otherwise(user + 1),
    })


@query("write_check_takeover", TAKEOVER + """
SELECT a.id, coalesce(p.role = 'admin', false) OR (a.old = a.principal AND a.new = a.principal) AS allowed
FROM asks a LEFT JOIN v_principals p ON p.auth_user_id = a.principal""")
def check_takeovers(v: Views) -> DataFrame:
    return write_check("customers", takeovers(v), tables(v), v.principals(), "update").select("id", "allowed")


@query("write_check_delete", TAKEOVER + """
SELECT a.id, coalesce(p.role = 'admin', false) OR a.old = a.principal AS allowed
FROM asks a LEFT JOIN v_principals p ON p.auth_user_id = a.principal""")
def check_deletes(v: Views) -> DataFrame:
    """Carts, one per customer, deleted by their owner or by somebody else."""
    carts = v.customers().select(F.col("id"), F.col("id").alias("customer_id"))
    asked = takeovers(v).select("id", F.col("id").alias("customer_id"), "principal")
    return write_check("cart_sessions", asked, {**tables(v), "cart_sessions": carts}, v.principals(), "delete").select("id", "allowed")


@query("contracted_products", """
deal AS (SELECT DISTINCT c_nationkey AS hotel_id, s_suppkey AS supplier_id FROM customer JOIN supplier ON s_nationkey = c_nationkey)
SELECT hotel_id, p.id FROM v_products p JOIN deal USING (supplier_id)""")
def contracts(v: Views) -> DataFrame:
    """A hotel, here a nation with customers, sees the suppliers of its nation."""
    deals = v.table("supplier").select(F.col("s_nationkey").alias("hotel_id"), F.col("s_suppkey").alias("supplier_id"))
    hotels = v.table("customer").select(F.col("c_nationkey").alias("id")).distinct()
    return contracted_products(v.products(), deals, hotels).select("hotel_id", "id")
