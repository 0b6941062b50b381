"""Declared schemas of the catalogue tables (DDL strings accepted by every Spark reader)."""

SUPPLIERS = "id STRING, name STRING, account_number STRING, depot STRING, telesales STRING"
PRICE_LISTS = (
    "id STRING, hotel_name STRING, price_valid_date DATE, import_date TIMESTAMP, "
    "source_file STRING, notes STRING"
)
PRODUCTS = (
    "id STRING, price_list_id STRING, supplier_id STRING, supplier_code STRING, description STRING, "
    "selling_uom STRING, pricing_uom STRING, price DECIMAL(10,2), currency STRING, "
    "category_id STRING, embedding ARRAY<FLOAT>"
)
CATEGORIES = "id STRING, name STRING, slug STRING, icon STRING, sort_order INT"
CUSTOMERS = (
    "id STRING, auth_user_id STRING, company_name STRING, vat_number STRING, hotel_name STRING, "
    "hotel_address STRING, contact_person STRING, contact_role STRING, phone STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
SIGNUPS = "user_id STRING, raw_user_meta_data STRING, ts TIMESTAMP"
ORDERS = (
    "id STRING, order_number STRING, customer_id STRING, total DECIMAL(10,2), delivery_hotel STRING, "
    "delivery_address STRING, billing_company STRING, billing_vat STRING, contact_person STRING, "
    "contact_phone STRING, status STRING"
)
ORDER_ITEMS = (
    "order_id STRING, product_id STRING, supplier_code STRING, description STRING, "
    "supplier_name STRING, selling_uom STRING, unit_price DECIMAL(10,2), qty INT"
)
ORDER_REQUESTS = "request_id STRING, auth_user_id STRING, items STRING"
CART_ITEM = (
    "STRUCT<id: STRING, description: STRING, supplier_name: STRING, price: DECIMAL(10,2), "
    "selling_uom: STRING, qty: INT>"
)
CART_SESSIONS = f"customer_id STRING, session_id STRING, items ARRAY<{CART_ITEM}>"
CHAT_MESSAGES = (
    "id STRING, customer_id STRING, session_id STRING, role STRING, content STRING, tool_calls STRING, "
    "tool_call_id STRING, tool_name STRING, model STRING, tokens_prompt INT, tokens_completion INT, "
    "created_at TIMESTAMP"
)
PRINCIPALS = "auth_user_id STRING, role STRING"
QUERIES = (
    "query_id LONG, search_text STRING, query_embedding ARRAY<FLOAT>, supplier STRING, "
    "supplier_filter STRING, price_min DOUBLE, price_max DOUBLE, fts_weight DOUBLE, "
    "semantic_weight DOUBLE, result_limit INT"
)
REQUESTS = "client STRING, ts TIMESTAMP, event_id LONG"
RULES = "priority INT, slug STRING, pattern STRING"
RAW_ROWS = "sheet STRING, line_no LONG, c0 STRING, c1 STRING, c2 STRING, c3 STRING, c4 STRING"

# The columns an imported price list carries in its JSON form.
IMPORT_JSON = (
    "price_list_id STRING, supplier_id STRING, supplier_code STRING, description STRING, "
    "selling_uom STRING, pricing_uom STRING, price STRING"
)
