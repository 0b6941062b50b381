"""Registered queries over conversations, carts and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import chat
from larder.operators.cart import cart_actions, cart_state, read_carts, read_customers, unit_price
from larder.operators.ratelimit import limit_requests
from larder.plans.registry import query
from larder.plans.views import Views


@query("chat_history", """
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS seq FROM v_chat QUALIFY seq <= 3""")
def chat_history(v: Views) -> DataFrame:
    return chat.history(v.chat(), 3).select("session_id", "id", "seq")


@query("chat_history_latest", """
l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM v_chat QUALIFY n <= 3)
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS seq FROM l""")
def chat_history_latest(v: Views) -> DataFrame:
    return chat.history(v.chat(), 3, keep="latest").select("session_id", "id", "seq")


@query("chat_messages_shaped", """
SELECT id, role, CASE WHEN tool_calls IS NOT NULL THEN nullif(content, '') ELSE coalesce(content, '') END AS content, tool_calls FROM v_chat""")
def chat_messages_shaped(v: Views) -> DataFrame:
    s = chat.shape_messages(v.chat())
    return s.select("id", "shaped.role", "shaped.content", "shaped.tool_calls")


@query("chat_conversations", """
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS seq FROM v_chat QUALIFY seq <= 3),
m AS (SELECT session_id, seq, role, coalesce(content, '') AS content FROM k UNION ALL SELECT DISTINCT session_id, 4, 'user', 'and now?' FROM v_chat)
SELECT session_id, string_agg(role || ':' || content, ',' ORDER BY seq) AS messages FROM m GROUP BY session_id""")
def chat_conversations(v: Views) -> DataFrame:
    asked = v.chat().select("customer_id", "session_id").distinct().withColumn("content", F.lit("and now?"))
    out = chat.conversations(v.chat(), asked, 3)
    part = F.transform(
        "messages",
        lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit(""))),
    )
    return out.select("session_id", F.array_join(part, ",").alias("messages"))


@query("tool_calls", """
SELECT id AS message_id, json_extract_string(tool_calls, '$[0].id') AS tool_call_id,
  json_extract_string(tool_calls, '$[0].function.name') AS tool_name,
  CASE WHEN json_valid(json_extract_string(tool_calls, '$[0].function.arguments'))
    THEN json_extract_string(tool_calls, '$[0].function.arguments') ELSE '{}' END AS arguments
FROM v_chat WHERE tool_calls IS NOT NULL""")
def tool_calls(v: Views) -> DataFrame:
    return chat.tool_calls(v.chat()).select("message_id", "tool_call_id", "tool_name", "arguments")


@query("tool_call_pairs", """
c AS (SELECT session_id, created_at, json_extract_string(tool_calls, '$[0].id') AS tool_call_id,
  json_extract_string(tool_calls, '$[0].function.name') AS tool_name FROM v_chat WHERE tool_calls IS NOT NULL)
SELECT session_id, tool_call_id, CASE WHEN created_at < 4 THEN 'done' END AS result,
  CASE WHEN tool_name = 'make_coffee' THEN 'unknown tool: make_coffee' END AS error FROM c""")
def tool_call_pairs(v: Views) -> DataFrame:
    """Early calls have a stored result."""
    m = v.chat()
    calls = chat.tool_calls(m).select("message_id", "tool_call_id")
    answered = m.where(F.col("created_at") < 4).withColumnRenamed("id", "message_id").join(calls.withColumnRenamed("tool_call_id", "_c"), "message_id")
    results = answered.select(
        F.concat("message_id", F.lit("-r")).alias("id"), "customer_id", "session_id", F.lit("tool").alias("role"),
        F.lit("done").alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.col("_c").alias("tool_call_id"),
    )
    rows = m.select(*results.columns).unionByName(results)
    return chat.paired_calls(rows).select("session_id", "tool_call_id", "result", "error")


@query("token_usage", """
SELECT session_id, model, CAST(sum(coalesce(tokens_prompt, 0)) AS BIGINT) AS prompt, CAST(sum(coalesce(tokens_completion, 0)) AS BIGINT) AS completion,
  CAST(sum(coalesce(tokens_prompt, 0) + coalesce(tokens_completion, 0)) AS BIGINT) AS total FROM v_chat GROUP BY ALL""")
def token_usage(v: Views) -> DataFrame:
    return chat.token_usage(v.chat())


def replies(v: Views) -> DataFrame:
    """Replies that carry cart actions in hidden blocks, one per event."""
    body = F.concat(
        F.lit('Fatto. <!--CART_ACTION[{"action":"add","id":"'), F.col("event_id").cast("string"), F.lit('","price":'),
        F.col("value").cast("decimal(10,2)").cast("string"), F.lit(',"qty":2},{"action":"remove","id":"x"}]--> altro '),
        F.lit('<!--CART_ACTION[{"action":"clear"}]-->'),
    )
    quiet = F.lit("nessuna azione <!--CART_ACTION-->")
    return v.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", quiet).otherwise(body).alias("content"))


@query("cart_actions", """
e AS (SELECT event_id, CAST(value AS DECIMAL(10,2)) AS price FROM events WHERE event_type <> 'view')
SELECT event_id AS message_id, 0 AS block_no, 0 AS action_no, 'add' AS action, CAST(event_id AS VARCHAR) AS id, CAST(price AS DOUBLE) AS price, 2 AS qty FROM e
UNION ALL SELECT event_id, 0, 1, 'remove', 'x', NULL, NULL FROM e
UNION ALL SELECT event_id, 1, 0, 'clear', NULL, NULL, NULL FROM e""")
def hidden_actions(v: Views) -> DataFrame:
    out = cart_actions(replies(v))
    return out.select("message_id", "block_no", "action_no", "action", "id", "price", "qty")


@query("cart_state", """
steps AS (SELECT *, max(seq) FILTER (action = 'clear') OVER (PARTITION BY cart_id) AS cleared FROM v_cart_log),
a AS (SELECT * FROM steps WHERE action <> 'clear' AND seq > coalesce(cleared, -1)),
n AS (SELECT *, row_number() OVER (PARTITION BY cart_id, item_id ORDER BY seq) AS n FROM a),
walk AS (
  SELECT cart_id, item_id, n, CASE WHEN action = 'add' THEN qty END AS q FROM n WHERE n = 1
  UNION ALL
  SELECT n.cart_id, n.item_id, n.n, CASE n.action WHEN 'add' THEN coalesce(w.q, 0) + n.qty
    WHEN 'update_qty' THEN CASE WHEN w.q IS NOT NULL THEN n.qty END END
  FROM walk w JOIN n ON n.cart_id = w.cart_id AND n.item_id = w.item_id AND n.n = w.n + 1)
SELECT cart_id, item_id, arg_max(coalesce(q, -1), n) AS qty FROM walk GROUP BY ALL HAVING arg_max(coalesce(q, -1), n) >= 0""")
def carts(v: Views) -> DataFrame:
    return cart_state(v.cart_log())


@query("read_carts", """
c AS (SELECT o_custkey AS customer_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT c_custkey AS customer_id, coalesce(n, 0) AS n_items FROM customer LEFT JOIN c ON c.customer_id = c_custkey""")
def carts_read(v: Views) -> DataFrame:
    """Open carts are the pending orders of a customer."""
    lines = v.table("orders").where(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.collect_list("o_orderkey").alias("items")
    )
    asked = v.customers().select(F.col("id").alias("customer_id"), F.lit("s").alias("session_id"))
    out = read_carts(asked, lines.withColumn("session_id", F.lit("s")))
    return out.select("customer_id", F.size("items").cast("long").alias("n_items"))


@query("read_customers", """
SELECT user_id AS customer_id, c.company_name, CASE WHEN c.id IS NULL THEN 'customer_not_found' END AS error
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM v_customers WHERE vat_number IS NOT NULL) c ON c.id = user_id""")
def customers_read(v: Views) -> DataFrame:
    asked = v.table("events").select(F.col("user_id").alias("customer_id")).distinct()
    out = read_customers(asked, v.customers().where(F.col("vat_number").isNotNull()))
    return out.select("customer_id", "company_name", "error")


@query("rate_limiter", """
e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT user_id, n, ts, event_id, ts AS opened, 1 AS c FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.ts, e.event_id, CASE WHEN e.ts > w.opened + INTERVAL 1 DAY THEN e.ts ELSE w.opened END,
    CASE WHEN e.ts > w.opened + INTERVAL 1 DAY THEN 1 ELSE w.c + 1 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id AS client, event_id, epoch_us(opened) AS window_us, c AS n_in_window, c > 2 AS limited FROM walk""")
def rate_limiter(v: Views) -> DataFrame:
    out = limit_requests(v.requests(), max_events=2, window_s=86400, slice_windows=4)
    return out.select("client", "event_id", F.unix_micros("window_start").alias("window_us"), "n_in_window", "limited")


@query("unit_prices", """
n AS (SELECT id, CAST(price * 100 AS BIGINT) AS cents, CAST(regexp_extract(selling_uom, '^(\\d+)X', 1) AS INTEGER) AS pieces FROM v_products)
SELECT id, (2 * cents + pieces) // (2 * pieces) / 100 AS unit_price FROM n""")
def unit_prices(v: Views) -> DataFrame:
    return v.products().select("id", unit_price(F.col("price"), F.col("selling_uom")).alias("unit_price"))
