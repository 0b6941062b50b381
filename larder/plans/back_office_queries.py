"""Registered back-office queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import analytics
from larder.plans.registry import query
from larder.plans.search_queries import grams_sql
from larder.plans.views import Views


@query("orders_per_month", """SELECT CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month, count(*) AS n_orders,
  CAST(sum(total) AS DOUBLE) AS value FROM v_orders GROUP BY 1""")
def orders_per_month(v: Views) -> DataFrame:
    out = analytics.orders_per(v.orders(), "month")
    return out.select(F.to_date("period").cast("string").alias("month"), "n_orders", "value")


@query("orders_per_week", """SELECT CAST(CAST(date_trunc('week', created_at) AS DATE) AS VARCHAR) AS week, count(*) AS n_orders,
  CAST(sum(total) AS DOUBLE) AS value FROM v_orders GROUP BY 1""")
def orders_per_week(v: Views) -> DataFrame:
    out = analytics.orders_per(v.orders(), "week")
    return out.select(F.to_date("period").cast("string").alias("week"), "n_orders", "value")


@query("top_products", """SELECT product_id, CAST(sum(qty) AS BIGINT) AS qty FROM v_order_items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_products(v: Views) -> DataFrame:
    return analytics.top_products(v.order_items())


@query("top_suppliers", """SELECT supplier_name, CAST(sum(unit_price * qty) AS DOUBLE) AS value FROM v_order_items GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")
def top_suppliers(v: Views) -> DataFrame:
    return analytics.top_suppliers(v.order_items())


@query("average_order_value", "SELECT round(CAST(avg(total) AS DOUBLE), 4) AS average_value FROM v_orders")
def average_order_value(v: Views) -> DataFrame:
    return analytics.average_order_value(v.orders()).select(F.round(F.col("average_value").cast("double"), 4).alias("average_value"))


@query("kpi_row", """SELECT count(*) AS n_orders, CAST(sum(total) AS DOUBLE) AS order_value, (SELECT count(*) FROM v_customers) AS n_users,
  (SELECT count(*) FROM v_products) AS n_products FROM v_orders""")
def kpi_row(v: Views) -> DataFrame:
    return analytics.kpi_row(v.orders(), v.customers(), v.products())


@query("recent_orders", """SELECT id, status FROM v_orders
WHERE created_at > TIMESTAMP '1998-07-01' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '1998-07-01'""")
def recent_orders(v: Views) -> DataFrame:
    return analytics.recent_orders(v.orders(), "1998-07-01").select("id", "status")


@query("order_list", """SELECT id, status, delivery_hotel FROM v_orders o WHERE status = 'confirmed' AND delivery_hotel = '2-HIGH'
AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'
AND EXISTS (SELECT 1 FROM v_order_items i WHERE i.order_id = o.id AND i.supplier_name = 'Supplier#000000003')""")
def order_list(v: Views) -> DataFrame:
    out = analytics.order_list(
        v.orders(), v.order_items(), status="confirmed", since="1996-01-01", until="1999-01-01", hotel="2-HIGH",
        supplier="Supplier#000000003",
    )
    return out.select("id", "status", "delivery_hotel")


@query("status_changes", """SELECT id, status AS old_status, CASE WHEN total > 100000 THEN 'shipped' ELSE 'confirmed' END AS new_status,
  (status = 'confirmed' AND total > 100000) OR (status = 'pending' AND total <= 100000) AS accepted FROM v_orders""")
def status_changes(v: Views) -> DataFrame:
    wanted = v.orders().select("id", F.when(F.col("total") > 100000, "shipped").otherwise("confirmed").alias("new_status"))
    return analytics.change_status(v.orders(), wanted)


@query("supplier_product_counts", """SELECT s.id AS supplier_id, s.name, count(p.id) AS n_products FROM v_suppliers s
LEFT JOIN (SELECT * FROM v_products WHERE pricing_uom = 'PROMO') p ON p.supplier_id = s.id GROUP BY ALL""")
def supplier_product_counts(v: Views) -> DataFrame:
    return analytics.supplier_product_counts(v.suppliers(), v.products().where(F.col("pricing_uom") == "PROMO"))


@query("supplier_comparison", f"""
p AS (SELECT id, supplier_id, name AS description FROM v_products),
t AS (SELECT DISTINCT description, {grams_sql('description')} AS g FROM p),
sims AS (SELECT a.description AS da, b.description AS db, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s
  FROM t a, t b),
few AS (SELECT *, row_number() OVER (PARTITION BY description, supplier_id ORDER BY id) AS k FROM p QUALIFY k <= 3),
best AS (SELECT p.id, o.id AS other_id, s AS similarity,
    row_number() OVER (PARTITION BY p.id ORDER BY s DESC, o.id) AS place
  FROM p JOIN sims ON da = p.description AND s > 0.5 JOIN few o ON o.description = db AND o.supplier_id <> p.supplier_id QUALIFY place <= 3)
SELECT id, place, other_id, similarity FROM best""")
def supplier_comparison(v: Views) -> DataFrame:
    goods = v.products().select("id", "supplier_id", F.col("name").alias("description"))
    return analytics.compare_suppliers(goods, k=3, threshold=0.5)


@query("users_overview", """SELECT c.id AS customer_id, c.hotel_name, epoch_us(max(e.ts)) AS last_us FROM v_customers c
LEFT JOIN events e ON e.user_id = c.auth_user_id GROUP BY ALL""")
def users_overview(v: Views) -> DataFrame:
    seen = v.table("events").select(F.col("user_id").alias("auth_user_id"), "ts")
    out = analytics.users_overview(v.customers().withColumn("created_at", F.lit(None).cast("timestamp_ntz")), seen)
    return out.select("customer_id", "hotel_name", F.unix_micros(F.col("last_access").cast("timestamp")).alias("last_us"))


@query("inactive_accounts", """SELECT c.id AS customer_id FROM v_customers c JOIN v_orders o ON o.customer_id = c.id
GROUP BY c.id HAVING max(o.created_at) < TIMESTAMP '2001-05-01'""")
def inactive_accounts(v: Views) -> DataFrame:
    seen = v.orders().select(F.col("customer_id").alias("auth_user_id"), F.col("created_at").alias("ts"))
    users = v.customers().withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return analytics.inactive_accounts(analytics.users_overview(users, seen), "2001-05-01").select("customer_id")


@query("export_customer", """SELECT 'customers' AS "table", count(*) AS n FROM v_customers WHERE id = 5
UNION ALL SELECT 'orders', count(*) FROM v_orders WHERE customer_id = 5
UNION ALL SELECT 'order_items', count(*) FROM v_order_items JOIN v_orders o ON o.id = order_id WHERE o.customer_id = 5
UNION ALL SELECT 'chat_messages', count(*) FROM v_chat WHERE customer_id = 5""")
def export_customer(v: Views) -> DataFrame:
    tables = {"customers": v.customers(), "orders": v.orders(), "order_items": v.order_items(), "chat_messages": v.chat()}
    parts = [df.agg(F.count("*").alias("n")).withColumn("table", F.lit(name)) for name, df in analytics.export_customer(5, tables).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
