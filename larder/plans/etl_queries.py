"""Registered queries over imports, classification and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import loading
from larder.operators.classify import category_counts, classify, coverage, fill_categories
from larder.operators.filters import normalise_queries, resolve_supplier
from larder.operators.maintenance import (
    customers_from_signups, embed_missing, embed_report, erase, erased_counts, hashing_embedder, invalidate_changed,
    text_hash, touch, violations,
)
from larder.plans.importing import import_products
from larder.plans.registry import query
from larder.plans.views import RULES, Views
from larder.sources.price_lists import clean_rows, import_summary

RAW = """
raw AS (SELECT CASE WHEN p_size = 44 THEN 'nobody' ELSE s_name END AS sheet, p_partkey AS line_no,
    CASE WHEN p_size = 1 THEN '  ' ELSE ' ' || p_brand || '-' || p_partkey END AS c0,
    CASE WHEN p_size <> 2 THEN p_name || '  ' END AS c1, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS c2, p_type AS c3,
    CASE WHEN p_size = 3 THEN 'abc' WHEN p_size = 4 THEN '' ELSE ' ' || p_retailprice || ' ' END AS c4
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
clean AS (SELECT s.id AS supplier_id, trim(c0) AS supplier_code, trim(c1) AS description, nullif(trim(c2), '') AS selling_uom,
    nullif(trim(c3), '') AS pricing_uom, CAST(TRY_CAST(trim(c4) AS DOUBLE) AS DECIMAL(10,2)) AS price, line_no
  FROM raw JOIN v_suppliers s ON s.name = sheet WHERE trim(c0) <> '' AND trim(c1) <> '')"""


def raw_rows(v: Views) -> DataFrame:
    n = v.table("supplier").agg(F.count("*")).scalar()
    names = v.suppliers().select(F.col("id").alias("_s"), "name")
    p = v.table("part").withColumn("_s", F.pmod("p_partkey", n)).join(names, "_s")
    size = F.col("p_size")
    return p.select(
        F.when(size == 44, "nobody").otherwise(F.col("name")).alias("sheet"),
        F.col("p_partkey").alias("line_no"),
        F.when(size == 1, "  ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).alias("c0"),
        F.when(size != 2, F.concat("p_name", F.lit("  "))).alias("c1"),
        F.when(size > 20, F.col("p_type")).otherwise("").alias("c2"),
        F.col("p_type").alias("c3"),
        F.when(size == 3, "abc").when(size == 4, "").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))).alias("c4"),
    )


@query("import_clean", RAW + """
SELECT supplier_id, supplier_code, description, selling_uom, pricing_uom, CAST(price AS DOUBLE) AS price, line_no FROM clean""")
def import_clean(v: Views) -> DataFrame:
    return clean_rows(raw_rows(v), v.suppliers(), "list-1").drop("price_list_id", "currency")


@query("import_summary", RAW + """
SELECT coalesce(s.name, CAST(c.supplier_id AS VARCHAR)) AS supplier, count(*) AS n_products
FROM clean c LEFT JOIN v_suppliers s ON s.id = c.supplier_id AND s.name NOT LIKE '%7' GROUP BY ALL""")
def import_totals(v: Views) -> DataFrame:
    named = v.suppliers().where(~F.col("name").like("%7"))
    return import_summary(clean_rows(raw_rows(v), v.suppliers(), "list-1"), named)


KEY = ["price_list_id", "supplier_id", "supplier_code"]
LOAD = """
load AS (SELECT event_type AS price_list_id, user_id AS supplier_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS supplier_code,
    event_id FROM events),
target AS (SELECT DISTINCT 'signup' AS price_list_id, c_custkey AS supplier_id, CAST(c_nationkey AS BIGINT) AS supplier_code FROM customer)"""


def load_rows(v: Views) -> DataFrame:
    return v.table("events").select(
        F.col("event_type").alias("price_list_id"), F.col("user_id").alias("supplier_id"),
        F.get_json_object("props", "$.k").cast("long").alias("supplier_code"), "event_id",
    )


def target_rows(v: Views) -> DataFrame:
    return v.table("customer").select(
        F.lit("signup").alias("price_list_id"), F.col("c_custkey").alias("supplier_id"),
        F.col("c_nationkey").cast("long").alias("supplier_code"),
    )


@query("key_conflicts", LOAD + """
SELECT event_id, CASE WHEN t.supplier_id IS NOT NULL THEN 'exists_in_target'
  WHEN event_id = min(event_id) OVER (PARTITION BY l.price_list_id, l.supplier_id, l.supplier_code) THEN 'accepted'
  ELSE 'duplicate_in_load' END AS status
FROM load l LEFT JOIN target t ON t.price_list_id = l.price_list_id AND t.supplier_id = l.supplier_id
  AND t.supplier_code = l.supplier_code""")
def key_conflicts(v: Views) -> DataFrame:
    return loading.split_new_rows(load_rows(v), target_rows(v), KEY, "event_id").select("event_id", "status")


@query("key_conflict_batches", LOAD + """,
rows AS (SELECT l.*, event_id // 20 AS batch_no, l.price_list_id || '/' || l.supplier_id || '/' || l.supplier_code AS k FROM load l),
held AS (SELECT batch_no, k, price_list_id, supplier_id, supplier_code, count(*) AS n FROM rows GROUP BY ALL),
batches AS (SELECT batch_no, row_number() OVER (ORDER BY batch_no) AS turn, max(n) > 1 OR bool_or(t.supplier_id IS NOT NULL) AS bad,
    list(k) FILTER (k IS NOT NULL) AS ks
  FROM held h LEFT JOIN target t ON t.price_list_id = h.price_list_id AND t.supplier_id = h.supplier_id AND t.supplier_code = h.supplier_code
  GROUP BY batch_no),
verdicts AS (
  WITH RECURSIVE played AS (
    SELECT 0::BIGINT AS turn, -1::BIGINT AS batch_no, []::VARCHAR[] AS taken, false AS ok
    UNION ALL
    SELECT b.turn, b.batch_no, CASE WHEN b.bad OR list_has_any(p.taken, coalesce(b.ks, [])) THEN p.taken ELSE list_concat(p.taken, coalesce(b.ks, [])) END,
      NOT (b.bad OR list_has_any(p.taken, coalesce(b.ks, [])))
    FROM played p JOIN batches b ON b.turn = p.turn + 1)
  SELECT batch_no, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS status FROM played WHERE turn > 0)
SELECT event_id, CAST(batch_no AS BIGINT) AS batch_no, status FROM rows JOIN verdicts USING (batch_no)""")
def key_conflict_batches(v: Views) -> DataFrame:
    """All-or-nothing batches; each depends on the verdict of every earlier one."""
    out = loading.split_new_batches(load_rows(v), target_rows(v), KEY, "event_id", batch=20)
    return out.select("event_id", "batch_no", "status")


@query("import_dry_run", RAW + """,
load AS (SELECT *, left(description, 3) AS short FROM clean),
target AS (SELECT DISTINCT supplier_id, supplier_code FROM clean WHERE line_no % 5 = 0)
SELECT line_no, CASE WHEN t.supplier_id IS NOT NULL THEN 'exists_in_target'
  WHEN line_no = min(line_no) OVER (PARTITION BY l.supplier_id, l.supplier_code) THEN 'accepted' ELSE 'duplicate_in_load' END AS status
FROM load l LEFT JOIN target t ON t.supplier_id = l.supplier_id AND t.supplier_code = l.supplier_code""")
def import_dry_run(v: Views) -> DataFrame:
    """A whole load, planned against a target that holds every fifth row, with nothing written."""
    load = clean_rows(raw_rows(v), v.suppliers(), "list-1")
    run = import_products(load, load.where(F.col("line_no") % 5 == 0), v.suppliers())
    return run.checked.select("line_no", "status")


@query("supplier_resolve", """
asked AS (SELECT c_custkey AS query_id, 'R#' || right(c_name, 9) AS supplier FROM customer
  UNION ALL SELECT -1 - c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer),
texts AS (SELECT supplier, min_by(id, (name, id)) AS sid FROM (SELECT DISTINCT supplier FROM asked)
  JOIN v_suppliers ON contains(lower(name), lower(supplier)) GROUP BY supplier)
SELECT query_id, a.supplier, sid AS supplier_filter, sid IS NULL AS supplier_missing FROM asked a LEFT JOIN texts USING (supplier)""")
def supplier_resolve(v: Views) -> DataFrame:
    c = v.table("customer")
    full = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("R#"), F.right("c_name", F.lit(9))).alias("supplier"))
    short = c.select((-1 - F.col("c_custkey")).alias("query_id"), F.col("c_nationkey").cast("string").alias("supplier"))
    out = resolve_supplier(full.unionByName(short), v.suppliers(), strict=True)
    return out.select("query_id", "supplier", "supplier_filter", "supplier_missing")


@query("query_normalise", """
raw AS (SELECT o_orderkey AS query_id, CASE WHEN o_totalprice < 3000 THEN '' WHEN o_totalprice < 6000 THEN repeat('x', 501)
    ELSE o_orderpriority END AS query,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey - 50 AS DOUBLE) WHEN o_orderstatus = 'O' THEN 0 END AS lim,
    CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS bad_price, o_totalprice / 250000.0 - 0.5 AS fw, o_orderstatus AS st FROM orders)
SELECT query_id, query AS search_text, CASE WHEN bad_price = 0 THEN 5.5e0 END AS price_min,
  CAST(greatest(least(coalesce(nullif(lim, 0), 20), 100), 1) AS INTEGER) AS result_limit,
  CASE WHEN st = 'P' THEN 0.4e0 ELSE greatest(least(fw, 1), 0) END AS fts_weight, 0.6e0 AS semantic_weight,
  CASE WHEN query = '' THEN 'query_missing' WHEN length(query) > 500 THEN 'query_too_long'
    WHEN bad_price = 1 THEN 'price_min_not_number' WHEN st = 'O' AND bad_price = 2 THEN 'x' END AS reject
FROM raw""")
def query_normalise(v: Views) -> DataFrame:
    o = v.table("orders")
    total, status = F.col("o_totalprice"), F.col("o_orderstatus")
    raw = o.select(
        F.col("o_orderkey").alias("query_id"),
        F.when(total < 3000, "").when(total < 6000, F.repeat(F.lit("x"), 501)).otherwise(F.col("o_orderpriority")).alias("query"),
        F.when(total > 450000, "cheap").otherwise("5.5").alias("price_min"),
        F.lit(None).cast("string").alias("price_max"),
        F.when(status == "F", (F.col("o_custkey") - 50).cast("string")).when(status == "O", "many").alias("limit"),
        F.when(status == "P", "NaN").otherwise((total / 250000.0 - 0.5).cast("string")).alias("fts_weight"),
        F.lit(None).cast("string").alias("semantic_weight"),
    )
    return normalise_queries(raw).drop("price_max")


@query("classify", "SELECT id, category_slug FROM v_classified")
def classify_products(v: Views) -> DataFrame:
    return classify(v.products(), RULES).select("id", "category_slug")


@query("category_counts", "SELECT category_slug, count(*) AS n_products FROM v_classified GROUP BY 1")
def count_categories(v: Views) -> DataFrame:
    return category_counts(classify(v.products(), RULES))


@query("category_coverage", """SELECT count(*) AS n_products,
  round(avg(CASE WHEN category_slug <> 'altro' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM v_classified""")
def category_coverage(v: Views) -> DataFrame:
    return coverage(classify(v.products(), RULES))


@query("category_refill", """
old AS (SELECT *, CASE WHEN supplier_id < 5 THEN 4 END AS category_id FROM v_classified)
SELECT o.id, CASE WHEN o.category_id IS NULL OR regexp_matches(description, 'bolt|rod', 'i') THEN c.id ELSE o.category_id END AS category_id
FROM old o JOIN v_categories c ON c.slug = o.category_slug""")
def category_refill(v: Views) -> DataFrame:
    """Products of the first suppliers are labelled already; only the first rule overrides them."""
    old = v.products().withColumn("category_id", F.when(F.col("supplier_id") < 5, 4))
    return fill_categories(old, v.categories(), RULES).select("id", "category_id")


@query("embed_missing", """SELECT count(*) FILTER (embedding IS NULL) AS processed, 0 AS remaining, 0 AS errors FROM v_docs""")
def embed_all(v: Views) -> DataFrame:
    before = v.docs(True)
    return embed_report(before, embed_missing(before, hashing_embedder()))


@query("embed_vectors", """
SELECT id, embedding IS NULL AS filled, 64 AS n_dims, CASE WHEN embedding IS NOT NULL THEN round(embedding[1]::DOUBLE, 6) END AS kept_first,
  CASE WHEN embedding IS NULL AND trim(description) <> '' THEN 1.0 END::DOUBLE AS norm FROM v_docs""")
def embed_vectors(v: Views) -> DataFrame:
    """Old vectors stay as they are, new ones have the model's length and unit norm."""
    before = v.docs(True)
    old = before.select("id", F.col("embedding").isNull().alias("filled"))
    after = embed_missing(before, hashing_embedder()).join(old, "id")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return after.select(
        "id", "filled", F.size("embedding").alias("n_dims"),
        F.when(~F.col("filled"), F.round(F.col("embedding")[0].cast("double"), 6)).alias("kept_first"),
        F.when(F.col("filled") & (F.trim("description") != ""), F.round(norm, 5)).alias("norm"),
    )


@query("reembed_changed", """
SELECT id, supplier_id = 'src3' OR embedding IS NULL AS missing FROM v_docs""")
def reembed_changed(v: Views) -> DataFrame:
    """Texts of one source were edited after their vectors were made."""
    old = v.docs(True).withColumn("embedded_hash", text_hash(F.col("description")))
    edited = F.when(F.col("supplier_id") == "src3", F.concat("description", F.lit("!"))).otherwise(F.col("description"))
    return invalidate_changed(old.withColumn("description", edited)).select("id", F.col("embedding").isNull().alias("missing"))


def shop_tables(v: Views) -> dict[str, DataFrame]:
    users = v.customers().select(F.col("id"))
    chat = v.chat().select("id", "customer_id", "role")
    return {"users": users, "customers": v.customers().select("id", "auth_user_id"), "chat_messages": chat,
            "suppliers": v.suppliers(), "products": v.products().select("id", "supplier_id", "price_list_id", "supplier_code")}


@query("cascade_delete", """
gone AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'users' AS "table", count(*) AS n_before, count(*) FILTER (id NOT IN (FROM gone)) AS n_after FROM v_customers
UNION ALL SELECT 'customers', count(*), count(*) FILTER (auth_user_id NOT IN (FROM gone)) FROM v_customers
UNION ALL SELECT 'chat_messages', count(*), count(*) FILTER (customer_id NOT IN (FROM gone)) FROM v_chat
UNION ALL SELECT 'suppliers', count(*), count(*) FROM v_suppliers
UNION ALL SELECT 'products', count(*), count(*) FROM v_products""")
def cascade_delete(v: Views) -> DataFrame:
    before = shop_tables(v)
    gone = v.table("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    return erased_counts(before, erase(before, "users", gone))


@query("cascade_supplier", """
SELECT 'suppliers' AS "table", count(*) AS n_before, count(*) FILTER (id % 3 <> 0) AS n_after FROM v_suppliers
UNION ALL SELECT 'products', count(*), count(*) FILTER (supplier_id % 3 <> 0) FROM v_products""")
def cascade_supplier(v: Views) -> DataFrame:
    before = {k: shop_tables(v)[k] for k in ("suppliers", "products")}
    return erased_counts(before, erase(before, "suppliers", v.suppliers().where(F.col("id") % 3 == 0)))


@query("cascade_price_list", """
SELECT id, price_list_id FROM v_products WHERE price_list_id NOT LIKE 'PROMO%'""")
def cascade_price_list(v: Views) -> DataFrame:
    """The products that are left when some price lists go."""
    gone = v.products().where(F.col("price_list_id").like("PROMO%")).select(F.col("price_list_id").alias("id"))
    return erase(shop_tables(v), "price_lists", gone)["products"].select("id", "price_list_id")


@query("integrity", """
SELECT 'products' AS "table", 'not_null:price' AS rule, CAST(id AS VARCHAR) AS key FROM v_products WHERE price IS NULL
UNION ALL SELECT 'products', 'unique:description', description FROM v_products GROUP BY description HAVING count(*) > 1
UNION ALL SELECT 'chat_messages', 'references:customer_id->small_customers', id FROM v_chat
  WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)
UNION ALL SELECT 'turns', 'allowed:role', conv_id || '-' || turn FROM conversations WHERE role NOT IN ('user', 'assistant', 'tool')""")
def integrity(v: Views) -> DataFrame:
    tables = shop_tables(v) | {
        "products": v.products(),
        "small_customers": v.table("customer").where(F.col("c_acctbal") < 5000).select(F.col("c_custkey").alias("id")),
        "turns": v.table("conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))),
    }
    return violations(
        tables,
        not_null=[("products", "id", "price")],
        unique=[("products", ["description"])],
        references=[("chat_messages", "id", "customer_id", "small_customers")],
        allowed=[("turns", "key", "role", ["user", "assistant", "tool"])],
    )


@query("signup_customers", """
first AS (SELECT user_id, min(ts) AS ts, arg_min(props, (ts, props)) AS meta FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id AS auth_user_id, coalesce(json_extract_string(meta, '$.k'), '') AS k, '' AS hotel_name,
  epoch_us(ts) AS created_us FROM first""")
def signup_customers(v: Views) -> DataFrame:
    out = customers_from_signups(v.signups(), ["k", "hotel_name"])
    return out.select("auth_user_id", "k", "hotel_name", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@query("touch_customers", """
SELECT c.id, CASE WHEN c_acctbal < 0 THEN 'moved' ELSE c.hotel_name END AS hotel_name,
  CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS updated_at FROM v_customers c JOIN customer ON c_custkey = c.id""")
def touch_customers(v: Views) -> DataFrame:
    old = v.customers().withColumn("updated_at", F.lit(1))
    moved = v.table("customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"), F.lit("moved").alias("hotel_name"))
    return touch(old, moved, "id", ["hotel_name"], F.lit(2)).select("id", "hotel_name", "updated_at")


LISTS = """
old AS (SELECT p_name, p_brand, min(p_retailprice) AS price, max(p_size) AS size FROM part WHERE p_type <> 'PROMO' GROUP BY ALL),
new AS (SELECT p_name, p_brand, max(CASE WHEN p_size < 45 THEN p_retailprice END) AS price, max(p_size) AS size
  FROM part WHERE p_type <> 'SMALL' GROUP BY ALL)"""


def two_lists(v: Views) -> tuple[DataFrame, DataFrame]:
    p = v.table("part")
    old = p.where(F.col("p_type") != "PROMO").groupBy("p_name", "p_brand").agg(F.min("p_retailprice").alias("price"), F.max("p_size").alias("size"))
    new = p.where(F.col("p_type") != "SMALL").groupBy("p_name", "p_brand").agg(
        F.max(F.when(F.col("p_size") < 45, F.col("p_retailprice"))).alias("price"), F.max("p_size").alias("size")
    )
    return old, new


@query("price_list_upsert", LISTS + """
SELECT coalesce(n.p_name, o.p_name) AS p_name, coalesce(n.p_brand, o.p_brand) AS p_brand, coalesce(n.price, o.price) AS price,
  coalesce(n.size, o.size) AS size, CASE WHEN o.p_name IS NULL THEN 'added' WHEN n.p_name IS NULL THEN 'kept'
    WHEN (n.price IS NULL OR n.price = o.price) AND n.size = o.size THEN 'same' ELSE 'changed' END AS change
FROM old o FULL JOIN new n ON n.p_name = o.p_name AND n.p_brand = o.p_brand""")
def price_list_upsert(v: Views) -> DataFrame:
    old, new = two_lists(v)
    return loading.upsert(old, new, ["p_name", "p_brand"], ["price", "size"])


@query("disable_missing", LISTS + """
SELECT o.p_name, o.p_brand, n.p_name IS NOT NULL AS is_active FROM old o LEFT JOIN new n ON n.p_name = o.p_name AND n.p_brand = o.p_brand""")
def disable_missing(v: Views) -> DataFrame:
    old, new = two_lists(v)
    return loading.disable_missing(old, new, ["p_name", "p_brand"]).select("p_name", "p_brand", "is_active")


@query("assign_category", """SELECT id, CASE WHEN price > 1000 THEN 9 ELSE 5 END AS category_id FROM v_products""")
def assign_category(v: Views) -> DataFrame:
    p = v.products().withColumn("category_id", F.lit(5))
    wanted = v.products().where(F.col("price") > 1000).select("id", F.lit(9).alias("category_id"))
    return loading.assign_category(p, wanted).select("id", "category_id")


@query("price_list_history", """
o AS (SELECT l_suppkey AS supplier_id, l_partkey AS supplier_code, CAST(l_shipdate AS DATE) AS d, CAST(max(l_extendedprice) AS DECIMAL(10,2)) AS price
  FROM lineitem GROUP BY ALL)
SELECT supplier_id, supplier_code, CAST(d AS VARCHAR) AS valid, CAST(price AS DOUBLE) AS price,
  CAST(price - lag(price) OVER (PARTITION BY supplier_id, supplier_code ORDER BY d) AS DOUBLE) AS change FROM o""")
def price_list_history(v: Views) -> DataFrame:
    """Every ship date is taken as a price list."""
    day = F.to_date("l_shipdate")
    l = v.table("lineitem").select(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("supplier_code"),
                                   day.cast("string").alias("price_list_id"), F.col("l_extendedprice").alias("p"))
    goods = l.groupBy("supplier_id", "supplier_code", "price_list_id").agg(F.max("p").cast("decimal(10,2)").alias("price"))
    lists = v.table("lineitem").select(day.cast("string").alias("id"), day.alias("price_valid_date")).distinct()
    out = loading.price_history(goods, lists)
    return out.select("supplier_id", "supplier_code", F.col("price_list_id").alias("valid"), "price", "change")
