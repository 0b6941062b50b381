"""Catalogue tables as views over a star-schema test folder, in Spark and as SQL text.

Every view covers its whole source table. Attributes that the source lacks (missing prices, bad
quantities, unknown customers) are tied to ordinary column values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import spread

RULES = [
    (1, "fasteners", "bolt|rod"),
    (2, "tools", "gear|widget|gizmo"),
    (3, "hot-goods", "^hot "),
    (4, "tableware", "plate"),
]
ADMIN_SEGMENT = "MACHINERY"


class Views:
    """Lazily read views of one test folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # the files carry times without a zone; the SQL side reads them as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    def products(self, embedding: bool = False) -> DataFrame:
        n = self.table("supplier").agg(F.count("*")).scalar()
        rows = spread(self.table("part")).select(
            F.col("p_partkey").alias("id"),
            F.col("p_type").alias("price_list_id"),
            F.pmod("p_partkey", n).alias("supplier_id"),
            F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("supplier_code"),
            F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("description"),
            F.concat(F.col("p_size").cast("string"), F.lit("X1,5 L")).alias("selling_uom"),
            F.col("p_type").alias("pricing_uom"),
            F.when(F.col("p_size") < 48, F.col("p_retailprice").cast("decimal(10,2)")).alias("price"),
            F.col("p_name").alias("name"),
        )
        if not embedding:
            return rows
        vectors = self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return rows.join(vectors, "id", "left")

    def doc_suppliers(self) -> DataFrame:
        return self.table("documents").select(F.col("source").alias("id"), F.upper("source").alias("name")).distinct()

    def docs(self, embedding: bool = False) -> DataFrame:
        rows = spread(self.table("documents")).select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("supplier_id"),
            F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("supplier_code"),
            F.col("text").alias("description"),
            F.col("lang").alias("selling_uom"),
            F.col("lang").alias("pricing_uom"),
            F.col("n_chars").cast("decimal(10,2)").alias("price"),
        )
        if not embedding:
            return rows
        vectors = self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return rows.join(vectors, "id", "left")

    def categories(self) -> DataFrame:
        slugs = [r[1] for r in RULES] + ["altro"]
        rows = [(i, s.upper(), s) for i, s in enumerate(slugs, start=1)]
        return self.spark.createDataFrame(rows, "id int, name string, slug string")

    def customers(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("auth_user_id"),
            F.col("c_name").alias("company_name"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("IT"), F.col("c_custkey").cast("string"))).alias("vat_number"),
            F.concat(F.lit("Hotel "), F.col("c_nationkey").cast("string")).alias("hotel_name"),
            F.col("c_mktsegment").alias("hotel_address"),
            F.col("c_name").alias("contact_person"),
            F.lit(None).cast("string").alias("phone"),
        )

    def principals(self) -> DataFrame:
        role = F.when(F.col("c_mktsegment") == ADMIN_SEGMENT, F.lit("admin"))
        return self.table("customer").select(F.col("c_custkey").alias("auth_user_id"), role.alias("role"))

    def orders(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "confirmed").otherwise("pending")
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("total"),
            status.alias("status"),
            F.col("o_orderpriority").alias("delivery_hotel"),
            F.col("o_orderdate").alias("created_at"),
        )

    def order_items(self) -> DataFrame:
        l = self.table("lineitem")
        names = self.suppliers().select(F.col("id").alias("l_suppkey"), F.col("name").alias("supplier_name"))
        return l.join(names, "l_suppkey").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("product_id"),
            "supplier_name",
            F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
            F.col("l_quantity").cast("int").alias("qty"),
        )

    def order_requests(self) -> DataFrame:
        """One request per order, its items as JSON text; bad values follow discount and tax codes."""
        ref = F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), -1).otherwise(F.col("l_partkey"))
        n = F.col("l_quantity").cast("int").cast("string")
        qty = (
            F.when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.0), F.concat(n, F.lit(".5")))
            .when((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.08), F.lit("0"))
            .when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.0), F.lit(None).cast("string"))
            .otherwise(n)
        )
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                        ref.cast("string").alias("product_id"), qty.alias("qty"))
        lists = self.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))
        text = F.to_json(F.transform("ls", lambda x: F.struct(x["product_id"].alias("product_id"), x["qty"].alias("qty"))))
        empty = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 20000)
        user = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 480000), F.lit(-1)).otherwise(F.col("o_custkey"))
        return self.table("orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.col("o_orderkey").alias("request_id"),
            user.alias("auth_user_id"),
            F.when(empty, F.lit("[]")).otherwise(text).alias("items"),
        )

    def signups(self) -> DataFrame:
        e = self.table("events").where(F.col("event_type") == "signup")
        return e.select("user_id", F.col("props").alias("raw_user_meta_data"), "ts")

    def requests(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("client"), "ts", "event_id")

    def chat(self) -> DataFrame:
        """Conversation turns without system rows; some answers carry a tool call."""
        c = self.table("conversations").where(F.col("role") != "system")
        call = F.concat(
            F.lit('[{"id":"call-'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
            F.lit('","type":"function","function":{"name":"'),
            F.when(F.col("turn") == 1, "search_products").otherwise("make_coffee"),
            F.lit('","arguments":"'),
            F.when(F.col("turn") <= 3, r'{\"turn\":1}').otherwise(r"{broken"),
            F.lit('"}}]'),
        )
        asks = (F.col("role") == "assistant") & (F.length("text") < 600)
        return c.select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.col("conv_id").alias("customer_id"),
            F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
            "role",
            F.when(asks, "").otherwise(F.col("text")).alias("content"),
            F.when(asks, call).alias("tool_calls"),
            F.lit(None).cast("string").alias("tool_call_id"),
            F.lit(None).cast("string").alias("tool_name"),
            F.when(F.col("role") == "assistant", F.when(F.col("turn") < 4, "m1").otherwise("m2")).alias("model"),
            F.when(F.col("role") == "assistant", F.length("text")).alias("tokens_prompt"),
            F.when(asks, F.col("turn").cast("int")).alias("tokens_completion"),
            F.col("turn").alias("created_at"),
        )

    def cart_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        action = (
            F.when(F.col("event_type") == "click", "add")
            .when(F.col("event_type") == "view", "update_qty")
            .when(F.col("event_type") == "error", "remove")
            .when((F.col("event_type") == "purchase") & (F.col("value") > 20), "clear")
            .otherwise("add")
        )
        return self.table("events").select(
            F.col("user_id").alias("cart_id"),
            F.struct("ts", "event_id").alias("seq"),
            action.alias("action"),
            (k % 5).alias("item_id"),
            (k % 9 + 1).alias("qty"),
        )


# The same views as SQL; a query uses the ones it names.
SQL_VIEWS = """WITH RECURSIVE
v_suppliers AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
v_products AS (
  SELECT p_partkey AS id, p_type AS price_list_id, p_partkey % (SELECT count(*) FROM supplier) AS supplier_id,
    p_brand || '-' || p_partkey AS supplier_code, p_name || ' ' || p_type || ' ' || p_brand AS description,
    p_size || 'X1,5 L' AS selling_uom, p_type AS pricing_uom,
    CASE WHEN p_size < 48 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS price, p_name AS name,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM part LEFT JOIN embeddings e ON e.vec_id = p_partkey),
v_docs AS (
  SELECT doc_id AS id, source AS supplier_id, source || '-' || doc_id AS supplier_code, text AS description,
    lang AS selling_uom, lang AS pricing_uom, CAST(n_chars AS DECIMAL(10,2)) AS price,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id),
v_doc_suppliers AS (SELECT DISTINCT source AS id, upper(source) AS name FROM documents),
v_categories AS (
  SELECT * FROM (VALUES (1, 'FASTENERS', 'fasteners'), (2, 'TOOLS', 'tools'), (3, 'HOT-GOODS', 'hot-goods'),
    (4, 'TABLEWARE', 'tableware'), (5, 'ALTRO', 'altro')) t(id, name, slug)),
v_classified AS (
  SELECT *, CASE WHEN regexp_matches(description, 'bolt|rod', 'i') THEN 'fasteners'
    WHEN regexp_matches(description, 'gear|widget|gizmo', 'i') THEN 'tools'
    WHEN regexp_matches(description, '^hot ', 'i') THEN 'hot-goods'
    WHEN regexp_matches(description, 'plate', 'i') THEN 'tableware' ELSE 'altro' END AS category_slug
  FROM v_products),
v_customers AS (
  SELECT c_custkey AS id, c_custkey AS auth_user_id, c_name AS company_name,
    CASE WHEN c_acctbal > 0 THEN 'IT' || c_custkey END AS vat_number, 'Hotel ' || c_nationkey AS hotel_name,
    c_mktsegment AS hotel_address, c_name AS contact_person, CAST(NULL AS VARCHAR) AS phone
  FROM customer),
v_principals AS (
  SELECT c_custkey AS auth_user_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' END AS role FROM customer),
v_orders AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'confirmed' ELSE 'pending' END AS status,
    o_orderpriority AS delivery_hotel, o_orderdate AS created_at
  FROM orders),
v_order_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product_id, s_name AS supplier_name,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price, CAST(l_quantity AS INTEGER) AS qty
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
v_request_lines AS (
  SELECT l_orderkey AS request_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax) - 1 AS pos,
    CASE WHEN l_discount = 0.1 AND l_tax = 0.08 THEN -1 ELSE l_partkey END AS product_id,
    CASE WHEN l_discount = 0.0 AND l_tax = 0.0 THEN CAST(l_quantity AS INTEGER) || '.5'
      WHEN l_discount = 0.0 AND l_tax = 0.08 THEN '0'
      WHEN l_discount = 0.1 AND l_tax = 0.0 THEN NULL
      ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty_text
  FROM lineitem),
v_requests_head AS (
  SELECT o_orderkey AS request_id,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 480000 THEN -1 ELSE o_custkey END AS auth_user_id,
    o_orderpriority = '5-LOW' AND o_totalprice < 20000 AS emptied
  FROM orders),
v_checked AS (
  SELECT l.request_id, l.pos, l.product_id, p.supplier_id, p.supplier_code, p.description, p.selling_uom, p.price,
    CASE WHEN qty_text NOT LIKE '%.5' THEN CAST(CASE WHEN qty_text NOT LIKE '%.5' THEN qty_text END AS INTEGER) END AS qty,
    CASE WHEN qty_text LIKE '%.5' THEN 1 WHEN qty_text IS NULL OR qty_text = '0' THEN 2
      WHEN p.id IS NULL THEN 3 WHEN p.price IS NULL THEN 4 ELSE 0 END AS failed
  FROM v_request_lines l JOIN v_requests_head h ON h.request_id = l.request_id AND NOT h.emptied
  LEFT JOIN v_products p ON p.id = l.product_id),
v_priced AS (
  SELECT h.request_id, c.id AS customer_id, t.total, c.*,
    CASE WHEN c.id IS NULL THEN 'customer_not_found' WHEN t.request_id IS NULL THEN 'no_items'
      WHEN t.bad IS NOT NULL THEN ['qty_not_integer', 'qty_invalid', 'product_not_found', 'product_without_price'][t.bad]
    END AS reason
  FROM v_requests_head h LEFT JOIN v_customers c ON c.auth_user_id = h.auth_user_id
  LEFT JOIN (
    SELECT request_id, sum(CASE WHEN failed = 0 THEN price * qty END) AS total,
      min_by(failed, pos) FILTER (failed > 0) AS bad
    FROM v_checked GROUP BY request_id) t ON t.request_id = h.request_id),
v_chat AS (
  SELECT conv_id || '-' || turn AS id, conv_id AS customer_id, 's' || conv_id AS session_id, role,
    CASE WHEN role = 'assistant' AND length(text) < 600 THEN '' ELSE text END AS content,
    CASE WHEN role = 'assistant' AND length(text) < 600 THEN
      '[{"id":"call-' || conv_id || '-' || turn || '","type":"function","function":{"name":"' ||
      CASE WHEN turn = 1 THEN 'search_products' ELSE 'make_coffee' END || '","arguments":"' ||
      CASE WHEN turn <= 3 THEN '{\\"turn\\":1}' ELSE '{broken' END || '"}}]' END AS tool_calls,
    CASE WHEN role = 'assistant' THEN CASE WHEN turn < 4 THEN 'm1' ELSE 'm2' END END AS model,
    CASE WHEN role = 'assistant' THEN length(text) END AS tokens_prompt,
    CASE WHEN role = 'assistant' AND length(text) < 600 THEN turn END AS tokens_completion,
    turn AS created_at
  FROM conversations WHERE role <> 'system'),
v_cart_log AS (
  SELECT user_id AS cart_id, row_number() OVER (ORDER BY ts, event_id) AS seq,
    CASE WHEN event_type = 'click' THEN 'add' WHEN event_type = 'view' THEN 'update_qty'
      WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'purchase' AND value > 20 THEN 'clear' ELSE 'add' END AS action,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS item_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 + 1 AS qty
  FROM events),
"""


def sql(text: str) -> str:
    """A query text that may start with further WITH parts (``name AS (...), ... SELECT``)."""
    body = text.strip()
    if body.upper().startswith("SELECT"):
        return SQL_VIEWS.rstrip().rstrip(",") + "\n" + body
    return SQL_VIEWS + body
