import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import access, chat
from larder.operators.cart import cart_actions, cart_state, read_carts, read_customers
from larder.operators.ratelimit import client_key, limit_requests
from larder.streaming.chat import cart_log, write_chat
from larder.streaming.ratelimit import limit_stream
from larder.streaming.signups import write_customers
from larder.streaming.sinks import append_new, read_table

MESSAGE = ("id string, customer_id string, session_id string, role string, content string, tool_calls string, "
           "tool_call_id string, tool_name string, model string, tokens_prompt int, tokens_completion int, created_at timestamp")
T0 = datetime(2024, 1, 1)


def message(i, session="s", role="user", content="x", **more):
    row = {"id": f"m{i:03d}", "customer_id": "c1", "session_id": session, "role": role, "content": content, "tool_calls": None,
           "tool_call_id": None, "tool_name": None, "model": None, "tokens_prompt": None, "tokens_completion": None,
           "created_at": T0 + timedelta(seconds=i)}
    return tuple((row | more).values())


def test_history_keeps_the_oldest(spark):
    df = spark.createDataFrame([message(i) for i in range(41)] + [message(99, "other")], MESSAGE)
    got = chat.history(df).where("session_id = 's'").orderBy("seq").collect()
    assert [r["id"] for r in got] == [f"m{i:03d}" for i in range(40)]
    latest = chat.history(df, keep="latest").where("session_id = 's'").orderBy("seq").collect()
    assert [r["id"] for r in latest] == [f"m{i:03d}" for i in range(1, 41)]


CALLS = '[{"id":"t1","type":"function","function":{"name":"search_products","arguments":"{\\"query\\":\\"x\\"}"}},{"id":"t2","type":"function","function":{"name":"dance","arguments":"{oops"}}]'


def test_shapes_and_tool_calls(spark):
    df = spark.createDataFrame(
        [message(1, content="hi"), message(2, role="assistant", content="", tool_calls=CALLS),
         message(3, role="tool", content=None, tool_call_id="t1", tool_name="search_products"), message(4, role="assistant", content=None)],
        MESSAGE)
    new = spark.createDataFrame([("c1", "s", "more")], "customer_id string, session_id string, content string")
    msgs = chat.conversations(df, new).first()["messages"]
    assert [(m["role"], m["content"]) for m in msgs] == [("user", "hi"), ("assistant", None), ("tool", ""), ("assistant", ""), ("user", "more")]
    assert msgs[1]["tool_calls"] == CALLS and msgs[2]["tool_call_id"] == "t1"
    pairs = {r["tool_call_id"]: (r["arguments"], r["result"], r["error"]) for r in chat.paired_calls(df).collect()}
    assert pairs == {"t1": ('{"query":"x"}', None, None), "t2": ("{}", None, "unknown tool: dance")}


def test_cart_actions_and_state(spark):
    text = ('ok <!--CART_ACTION[{"action":"add","id":"a","description":"VINO","supplier_name":"ALPI","price":4.30,"selling_uom":"PZ","qty":2},'
            '{"action":"add","id":"b","qty":1}]--> e <!--CART_ACTION[{"action":"remove","id":"b"}]-->')
    df = spark.createDataFrame([("m1", text), ("m2", "nothing"), ("m3", "<!--CART_ACTION[oops]-->")], "id string, content string")
    got = [(r["message_id"], r["block_no"], r["action_no"], r["action"], r["id"], r["qty"]) for r in cart_actions(df).orderBy("block_no", "action_no").collect() if r["action"]]
    assert got == [("m1", 0, 0, "add", "a", 2), ("m1", 0, 1, "add", "b", 1), ("m1", 1, 0, "remove", "b", None)]


def replay(log):
    carts = {}
    for cart, _, action, item, qty in log:
        items = carts.setdefault(cart, {})
        if action == "clear":
            items.clear()
        elif action == "remove":
            items.pop(item, None)
        elif action == "add":
            items[item] = items.get(item, 0) + qty
        elif item in items:
            items[item] = qty
    return {(c, i): q for c, items in carts.items() for i, q in items.items()}


@pytest.mark.parametrize("seed", range(4))
def test_cart_state_equals_replay(spark, seed):
    rng = random.Random(seed)
    log = [(rng.choice("xyz") if rng.random() < 0.6 else "hot", n, rng.choices(["add", "update_qty", "remove", "clear"], [5, 4, 2, 0.3])[0],
            rng.choice("abcd"), rng.randrange(1, 9)) for n in range(400)]
    df = spark.createDataFrame(log, "cart_id string, seq int, action string, item_id string, qty int").repartition(3)
    got = {(r["cart_id"], r["item_id"]): r["qty"] for r in cart_state(df).collect()}
    assert got == replay(log)


def test_lookups(spark):
    asks = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("c3", "s")], "customer_id string, session_id string")
    carts = spark.createDataFrame([("c1", "s", ["a"]), ("c2", "s", None)], "customer_id string, session_id string, items array<string>")
    assert {r["customer_id"]: r["items"] for r in read_carts(asks, carts).collect()} == {"c1": ["a"], "c2": [], "c3": []}
    who = spark.createDataFrame([("c1", "ACME")], "id string, company_name string")
    assert {r["customer_id"]: r["error"] for r in read_customers(asks, who).collect()} == {
        "c1": None, "c2": "customer_not_found", "c3": "customer_not_found"}
    heads = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8",), (None,)], "x string")
    assert [r[0] for r in heads.select(client_key(F.col("x"))).collect()] == ["1.2.3.4", "unknown"]


def simulate(events, limit, w):
    state, out = {}, {}
    for client, us, eid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        opened, n = state.get(client, (None, 0))
        if opened is None or us > opened + w:
            opened, n = us, 0
        state[client] = (opened, n + 1)
        out[eid] = (opened, n + 1, n + 1 > limit)
    return out


def events_for(seed, n=600):
    rng = random.Random(seed)
    base = int(T0.timestamp()) * 1_000_000
    out = []
    for eid in range(n):
        client = "hot" if rng.random() < 0.5 else rng.choice("abc")
        step = rng.choice([0, 60_000_000, 60_000_001]) if rng.random() < 0.2 else rng.randrange(0, 40 * 60_000_000)
        out.append((client, base + step * (1 if client == "hot" else 3), eid))
    return out


def as_requests(spark, events):
    df = spark.createDataFrame(events, "client string, us long, event_id long")
    return df.select("client", F.timestamp_micros("us").alias("ts"), "event_id")


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_limiter_equals_simulation(spark, slices):
    events = events_for(slices)
    got = limit_requests(as_requests(spark, events).repartition(3), 3, 60, slices)
    got = {r["event_id"]: (r["us"], r["n_in_window"], r["limited"]) for r in got.withColumn("us", F.unix_micros("window_start")).collect()}
    assert got == simulate(events, 3, 60_000_000)


def test_limiter_borders(spark):
    base = int(T0.timestamp()) * 1_000_000
    events = [("a", base + i, i) for i in range(31)] + [("a", base + 60_000_000, 40), ("a", base + 60_001_000, 41), ("b", base, 50), ("b", base, 51)]
    got = {r["event_id"]: r for r in limit_requests(as_requests(spark, events)).collect()}
    assert not got[29]["limited"] and got[30]["limited"] and got[40]["limited"]
    assert not got[41]["limited"] and got[41]["n_in_window"] == 1
    assert [got[i]["n_in_window"] for i in (50, 51)] == [1, 2]


def test_limiter_stream_equals_batch(spark, tmp_path):
    events = sorted(events_for(11, 200), key=lambda e: e[1])
    for i in range(2):
        part = events[i * 100 : (i + 1) * 100]
        as_requests(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("client string, ts timestamp, event_id long").parquet(str(tmp_path / "in"))
    stream = limit_stream(source, 3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("us", F.unix_micros("window_start"))
    got = {r["event_id"]: (r["us"], r["n_in_window"], r["limited"]) for r in got.collect()}
    assert got == simulate(events, 3, 60_000_000)


def test_signup_stream(spark, tmp_path):
    schema = "user_id string, raw_user_meta_data string, ts timestamp"
    first = [("u1", '{"company_name":"A"}', T0), ("u1", '{"company_name":"B"}', T0 + timedelta(1)), ("u2", "{oops", T0), (None, "{}", T0)]
    second = [("u1", '{"company_name":"C"}', T0 + timedelta(2)), ("u3", None, T0)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_customers(source, str(tmp_path / "c"), str(tmp_path / "r"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["auth_user_id"]: (r["company_name"], r["phone"]) for r in read_table(spark, str(tmp_path / "c")).collect()}
    assert got == {"u1": ("A", ""), "u3": ("", "")}
    assert {r["reason"] for r in read_table(spark, str(tmp_path / "r")).collect()} == {"user_missing", "profile_not_json"}


def test_chat_stream_to_cart(spark, tmp_path):
    def reply(i, actions):
        return message(i, role="assistant", content=f"<!--CART_ACTION{actions}-->")

    rows = [reply(1, '[{"action":"add","id":"a","qty":2}]'), message(2), reply(3, '[{"action":"update_qty","id":"a","qty":5}]')]
    for part in (rows, rows[2:] + [reply(4, '[{"action":"add","id":"b","qty":1}]')]):  # the second part repeats a message
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))
        write_chat(source, str(tmp_path / "m"), str(tmp_path / "a"), str(tmp_path / "cp")).awaitTermination(120)
    assert read_table(spark, str(tmp_path / "m")).count() == 4
    state = cart_state(cart_log(read_table(spark, str(tmp_path / "a"))))
    assert {r["item_id"]: r["qty"] for r in state.collect()} == {"a": 5, "b": 1}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for batch_id in (0, 0, 1):
        append_new(rows, batch_id, str(tmp_path / "t"), "k")
    assert read_table(spark, str(tmp_path / "t")).count() == 2


def shop(spark):
    return {
        "customers": spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "id string, auth_user_id string"),
        "orders": spark.createDataFrame([("o1", "c1"), ("o2", "c2"), ("o3", "c1")], "id string, customer_id string"),
        "order_items": spark.createDataFrame([("i1", "o1"), ("i2", "o2"), ("i3", "o9")], "id string, order_id string"),
        "cart_sessions": spark.createDataFrame([("k1", "c1")], "id string, customer_id string"),
        "products": spark.createDataFrame([("p1",)], "id string"),
    }


PEOPLE = [("u1", None), ("u2", "buyer"), ("u3", None), ("boss", "admin")]


def test_visibility(spark):
    tables, people = shop(spark), spark.createDataFrame(PEOPLE, "auth_user_id string, role string")

    def seen(table, who, role=None):
        return sorted(r["id"] for r in access.visible_to(table, tables, who, role).collect())

    assert seen("orders", "u1") == ["o1", "o3"] and seen("order_items", "u1") == ["i1"]
    assert seen("orders", "u3") == [] and seen("products", "u3") == ["p1"] and seen("customers", "u2") == ["c2"]
    assert seen("order_items", "boss", "admin") == ["i1", "i2", "i3"]
    counts = {r["auth_user_id"]: r["n_visible"] for r in access.visible_counts("orders", tables, people).collect()}
    assert counts == {"u1": 2, "u2": 1, "u3": 0, "boss": 3}
    whole = {r["auth_user_id"]: r["n_visible"] for r in access.visible_counts("products", tables, people).collect()}
    assert set(whole.values()) == {tables["products"].count()} and len(whole) == 4
    with pytest.raises(ValueError):
        access.visible_rows("products", tables, people)
    assert {r["auth_user_id"] for r in access.sees_all("orders", people).where("sees_all").collect()} == {"boss"}
    for table in ("orders", "order_items", "customers"):
        rows = access.visible_rows(table, tables, people).collect()
        for who, role in PEOPLE[:3]:
            assert sorted(r["id"] for r in rows if r["principal"] == who) == seen(table, who, role)


def test_write_checks(spark):
    tables, people = shop(spark), spark.createDataFrame(PEOPLE, "auth_user_id string, role string")
    new = spark.createDataFrame([("n1", "c1", "u1"), ("n2", "c2", "u1"), ("n3", "c2", "boss"), ("n4", "c9", "u1"), ("n5", "c1", "ghost")],
                                "id string, customer_id string, principal string")

    def allowed(table, rows, action):
        return {r["id"] for r in access.write_check(table, rows, tables, people, action).collect() if r["allowed"]}

    assert allowed("orders", new, "insert") == {"n1", "n3"}
    assert allowed("orders", new, "update") == {"n3"}
    carts = spark.createDataFrame([("n1", "c1"), ("n2", "c1"), ("n4", "c2")], "id string, customer_id string")
    tables["cart_sessions"] = carts
    assert allowed("cart_sessions", new, "delete") == {"n1", "n2", "n3"}  # the stored owner counts
    assert allowed("cart_sessions", new, "update") == {"n1", "n3"}
    taken = spark.createDataFrame([("c1", "u2", "u2"), ("c2", "u2", "u2"), ("c2", "u1", "u2"), ("c7", "u2", "u2")], "id string, auth_user_id string, principal string")
    checked = access.write_check("customers", taken, tables, people, "update").where("allowed").collect()
    assert [(r["id"], r["auth_user_id"]) for r in checked] == [("c2", "u2")]
    assert allowed("products", new.drop("customer_id"), "insert") == {"n3"}
    items = spark.createDataFrame([("x1", "o1", "u1"), ("x2", "o2", "u1")], "id string, order_id string, principal string")
    assert allowed("order_items", items, "insert") == {"x1"}
    said = spark.createDataFrame([("m1", "c1", "user", "x", "u1"), ("m2", "c1", "admin", "x", "u2"), ("m3", "c2", "assistant", None, "boss"), ("m4", "c2", None, "u2", "u2")],
                                 "id string, customer_id string, role string, owner string, principal string")
    checked = access.write_check("chat_messages", said, tables, people, "insert")
    assert set(checked.columns) == {*said.columns, "allowed"}
    assert {(r["id"], r["role"], r["owner"]) for r in checked.where("allowed").collect()} == {("m1", "user", "x"), ("m3", "assistant", None), ("m4", None, "u2")}
